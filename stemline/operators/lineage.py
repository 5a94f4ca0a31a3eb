"""The lineage graph: detections, links, and the relational operators on them.

Detections are one row for each node with dataset, frame and finite position; links join two detections of a dataset
from a frame to the next one. ``edge_id`` is the position of a link in its list and settles ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, clean_probability, distance, written
from stemline.skew import hot_ends, lookup

MAX_LINK_UM = 14.0


def detections(nodes: DataFrame) -> DataFrame:
    """(dataset, node_id, t, z, y, x, gap_synthetic, readmitted), repeated deliveries once."""
    d = nodes.select("dataset", "node_id", "t", *AXES, "gap_synthetic", "readmitted")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("dataset", "node_id", "t", *AXES)])
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in AXES])  # NaN is above infinity
    return d.where(known & finite).distinct()


def deliveries(edges: DataFrame) -> DataFrame:
    """Links as delivered, repeated deliveries once."""
    columns = ("edge_id", "source_id", "target_id", "edge_prob", "distance_um", "motion_pass", "gap_closed", "safe_division")
    return edges.select(*columns).distinct()


def place(det: DataFrame, prefix: str, key: str) -> DataFrame:
    """Detections with their columns prefixed, to join on a key."""
    return det.select(F.col("node_id").alias(key), F.col("dataset").alias(f"{prefix}dataset"), F.col("t").alias(f"{prefix}t"), *[F.col(c).alias(f"{prefix}{c}") for c in AXES])


def with_ends(edges: DataFrame) -> tuple[DataFrame, dict[str, list]]:
    """Deliveries with two ends that can be nodes (ids are not negative, -1 is filler), and the ends that are frequent."""
    both = edges.where("source_id >= 0 and target_id >= 0")
    return deliveries(both), hot_ends(both, ["source_id", "target_id"])


def links(edges: DataFrame, det: DataFrame, most_um: float | None = MAX_LINK_UM) -> DataFrame:
    """Links between detections of one dataset in neighbouring frames, no longer than most_um (None: any length)."""
    once, hot = with_ends(edges)
    both = lookup(once, place(det, "s_", "source_id"), "source_id", F.col("edge_id"), "inner", hot["source_id"], merge=False)
    both = lookup(both, place(det, "g_", "target_id"), "target_id", F.col("edge_id"), "inner", hot["target_id"], merge=False)
    both = both.where("s_dataset = g_dataset and g_t = s_t + 1").withColumn("um", distance("s_", "g_"))
    if most_um is not None:
        both = both.where(F.col("um") <= most_um)
    return both.withColumnsRenamed({"s_dataset": "dataset", "s_t": "t"}).drop("g_dataset")


def strength() -> list[Column]:
    """The order in which links compete: higher probability, shorter, earlier."""
    return [F.coalesce("edge_prob", F.lit(0.0)).desc(), F.col("um"), F.col("edge_id")]


def best_per(rows: DataFrame, key: str, n: int = 1, order: list[Column] | None = None) -> DataFrame:
    """The n best links of each source or target."""
    w = W.partitionBy(key).orderBy(*(order or strength()))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def best_parent(rows: DataFrame) -> DataFrame:
    """The best link of each target; an aggregate, so that a target with very many links is combined before the shuffle."""
    keep = [c for c in rows.columns if c != "target_id"]
    order = F.struct(-F.coalesce("edge_prob", F.lit(0.0)), F.col("um"), F.col("edge_id"))
    best = rows.groupBy("target_id").agg(F.min_by(F.struct(*keep), order).alias("best"))
    return best.select("target_id", "best.*")


def forest(rows: DataFrame) -> DataFrame:
    """At most one parent and two children each: what the fallback keeps."""
    return best_per(best_parent(rows), "source_id", 2)


def bare_forest(edges: DataFrame, det: DataFrame, most_um: float = MAX_LINK_UM) -> DataFrame:
    """(dataset, t, source_id, target_id, um, only) of the forest of all links; only: whether it is its source's only one.

    No column goes along that the choice does not need. A target keeps one link, so repeated deliveries, unless an end is
    frequent, leave there and not in a shuffle of their own. Dataset and frame are compared so that they are no keys of the
    join: both ends then read one shuffle of the detections, and the links of a target stay where they are.
    """
    both = edges.where("source_id >= 0 and target_id >= 0")
    hot = hot_ends(both, ["source_id", "target_id"])
    rows = both.select("edge_id", "source_id", "target_id", "edge_prob")
    rows = rows.distinct() if any(hot.values()) else rows
    for p, key in (("s_", "source_id"), ("g_", "target_id")):
        rows = lookup(rows, place(det, p, key), key, F.col("edge_id"), "inner", hot[key], merge=False)
    rows = rows.where("s_dataset <= g_dataset and s_dataset >= g_dataset and cast(g_t as long) - cast(s_t as long) = 1").withColumn("um", distance("s_", "g_")).where(F.col("um") <= most_um)
    rows = forest(rows.select("edge_id", "source_id", "target_id", "edge_prob", F.col("s_dataset").alias("dataset"), F.col("s_t").alias("t"), "um"))
    only = F.count("*").over(W.partitionBy("source_id")) == 1
    return rows.select("dataset", "t", "source_id", "target_id", "um", only.alias("only"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, field, node_id) of ends that are no node at all."""
    once = deliveries(edges)
    ends = once.select("edge_id", F.explode(F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("target_id"), F.col("target_id"))).alias("field", "node_id"))
    return ends.where("node_id >= 0").join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("edge_id", "field", "node_id")


def ends_of_tracks(det: DataFrame, rows: DataFrame) -> DataFrame:
    """(node_id, dataset, t, kind) with kind start (nobody's target), end (nobody's source) or isolated (neither)."""
    seen = rows.select(F.col("source_id").alias("node_id"), F.lit(1).alias("s"), F.lit(0).alias("g")).unionByName(rows.select(F.col("target_id").alias("node_id"), F.lit(0).alias("s"), F.lit(1).alias("g")))
    role = det.select("node_id", "dataset", "t").join(seen.groupBy("node_id").agg(F.max("s").alias("s"), F.max("g").alias("g")), "node_id", "left").fillna(0, ["s", "g"])
    kind = F.when((F.col("s") == 0) & (F.col("g") == 0), "isolated").when(F.col("g") == 0, "start").when(F.col("s") == 0, "end")
    return role.withColumn("kind", kind).where("kind is not null").select("node_id", "dataset", "t", "kind")


def prune_isolated(det: DataFrame, rows: DataFrame) -> DataFrame:
    """Detections with a link."""
    used = rows.select(F.col("source_id").alias("node_id")).union(rows.select("target_id"))
    return det.join(used.distinct(), "node_id", "left_semi")


def degrees(rows: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out)."""
    out = rows.select(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return out.unionByName(rows.select(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))).groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def violations(edges: DataFrame, det: DataFrame) -> DataFrame:
    """(kind, id) of what a forest must not have: merge, multi_branch (node), dt, self_loop, dangling (edge)."""
    once = deliveries(edges).where("source_id is not null and target_id is not null").select("edge_id", "source_id", "target_id")
    real, hot = with_ends(edges)
    known = real.select("edge_id", "source_id", "target_id")
    for key, name in (("source_id", "s_t"), ("target_id", "g_t")):
        known = lookup(known, det.select(F.col("node_id").alias(key), F.col("t").alias(name)), key, F.col("edge_id"), "left", hot[key], merge=False)
    none = F.lit(None).cast("int")
    filler = once.where("source_id < 0 or target_id < 0").withColumns({"s_t": none, "g_t": none})
    loop, lost = F.col("source_id") == F.col("target_id"), F.col("s_t").isNull() | F.col("g_t").isNull()
    found = F.array_compact(F.array(F.when(loop, "self_loop"), F.when(lost, "dangling"), F.when(~lost & ~loop & (F.col("g_t") != F.col("s_t") + 1), "dt")))
    per_edge = known.unionByName(filler).select(F.explode(found).alias("kind"), F.col("edge_id").alias("id"))
    count = degrees(once.select("source_id", "target_id").distinct())
    per_node = count.select(F.explode(F.array_compact(F.array(F.when(F.col("n_in") > 1, "merge"), F.when(F.col("n_out") > 2, "multi_branch")))).alias("kind"), F.col("node_id").alias("id"))
    return per_edge.unionByName(per_node)


def probabilities(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """For pairs(source_id, target_id): the highest probability of a link between them, and whether there is one."""
    best = deliveries(edges).where("edge_prob is not null").groupBy("source_id", "target_id").agg(F.max(clean_probability(F.col("edge_prob"))).alias("prob"), F.lit(1).alias("observed"))
    return pairs.join(best, ["source_id", "target_id"], "left").fillna({"prob": 0.0, "observed": 0})


def keep_and_fill(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first links, and of the second those whose source and target are both free in the first."""
    free = second.join(first.select("source_id").distinct(), "source_id", "left_anti").join(first.select("target_id").distinct(), "target_id", "left_anti")
    return first.unionByName(free)


def single_links(rows: DataFrame) -> DataFrame:
    """Links that are the only one of their source and of their target; counts are combined before the shuffle."""
    alone = lambda key: rows.groupBy(key).agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id")).where("n = 1").select("edge_id")
    return rows.join(alone("source_id").join(alone("target_id"), "edge_id"), "edge_id", "left_semi")


def next_free_id(det: DataFrame, start: int = 0) -> DataFrame:
    """(next_id): one more than the largest node id, at least start; start where there are no nodes."""
    return det.agg(F.greatest(F.lit(start).cast("long"), F.coalesce(F.max("node_id") + 1, F.lit(start).cast("long"))).alias("next_id"))


def aligned(det: DataFrame, cache: DataFrame, most: int = 200) -> DataFrame:
    """(dataset, aligned): whether the first nodes of each dataset (by id) lie where a cache of detections has them.

    Ids count as positions in the cache (dataset, row, t, z, y, x). Negative ids and ids behind the end of the cache pass;
    others must agree in t and, within 1e-8 + 1e-5 of the cached value, in position.
    """
    first = det.where("node_id >= 0").withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy("node_id"))).where(F.col("k") <= most)
    kept = cache.select("dataset", F.col("row").alias("node_id"), *[F.col(c).alias(f"c_{c}") for c in ("t", *AXES)])
    near = [F.abs(F.col(c) - F.col(f"c_{c}")) <= 1e-8 + 1e-5 * F.abs(F.col(f"c_{c}")) for c in ("t", *AXES)]
    checked = first.join(kept, ["dataset", "node_id"], "left").withColumn("ok", F.col("c_t").isNull() | reduce(lambda a, b: a & b, near))
    return det.select("dataset").distinct().join(checked.groupBy("dataset").agg(F.bool_and("ok").alias("aligned")), "dataset", "left").fillna({"aligned": True})


def track_lengths(rows: DataFrame, most: int = 10) -> DataFrame:
    """(node_id, back, forward): how many single links lead up to a node and away from it, counted up to most.

    Back goes over nodes with one parent, forward over nodes with one child. Four rounds of doubled steps reach ten.
    """
    def chain(start: str, end: str, name: str) -> DataFrame:
        one = rows.groupBy(start).agg(F.count("*").alias("n"), F.min(end).alias("to")).where("n = 1").select(F.col(start).alias("at"), "to", F.lit(1).alias("steps"))
        reach = 1
        while reach < most:
            further = one.select(F.col("at").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
            one = one.join(further, "to", "left").select("at", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
            reach *= 2
        return one.select(F.col("at").alias("node_id"), F.least("steps", F.lit(most)).cast("int").alias(name))

    nodes = rows.select(F.col("source_id").alias("node_id")).union(rows.select("target_id")).distinct()
    both = nodes.join(chain("target_id", "source_id", "back"), "node_id", "left").join(chain("source_id", "target_id", "forward"), "node_id", "left")
    return both.fillna(0, ["back", "forward"])


def submission(det: DataFrame, rows: DataFrame) -> DataFrame:
    """Tagged rows of nodes and edges as they are written: whole coordinates, -1 as filler."""
    none = F.lit(-1).cast("long")
    nodes = det.select("dataset", F.lit("node").alias("row_type"), "node_id", F.col("t").cast("long").alias("t"), *[written(F.col(c)).alias(c) for c in AXES], none.alias("source_id"), none.alias("target_id"))
    edges = rows.select("dataset", F.lit("edge").alias("row_type"), none.alias("node_id"), none.alias("t"), *[none.alias(c) for c in AXES], "source_id", "target_id")
    return nodes.unionByName(edges)
