"""Divisions: fork candidates, gates, budgets and greedy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, SCALE, angle, distance, mirror_distance
from stemline.operators.spatial import nearest, radius_pairs
from stemline.store import Scratch


def only_children(links: DataFrame) -> DataFrame:
    """(source_id, target_id, um, ...) of nodes with exactly one child."""
    one = links.groupBy("source_id").agg(F.count("*").alias("n"), F.first("target_id").alias("target_id"), F.first("um").alias("um"))
    return one.where("n = 1").drop("n")


def orphans_of_frames(det: DataFrame, links: DataFrame) -> DataFrame:
    """Detections that are nobody's target."""
    return det.join(links.select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_anti")


def _at(det: DataFrame, key: str, prefix: str) -> DataFrame:
    return det.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in AXES])


def _grandchildren(pairs: DataFrame, det: DataFrame, children: DataFrame) -> DataFrame:
    """With t2_um: the distance of the only children of d1_id and d2_id, null where there are none."""
    a = children.select(F.col("source_id").alias("d1_id"), F.col("target_id").alias("c1")).join(_at(det, "c1", "c1_"), "c1")
    b = children.select(F.col("source_id").alias("d2_id"), F.col("target_id").alias("c2")).join(_at(det, "c2", "c2_"), "c2")
    both = pairs.join(a, "d1_id", "left").join(b, "d2_id", "left").withColumn("t2_um", distance("c1_", "c2_"))
    return both.drop("c1", "c2", *[f"{p}{c}" for p in ("c1_", "c2_") for c in AXES])


def fork_candidates(det: DataFrame, links: DataFrame, most_pd1: float = 12.0, most_pd2: float = 12.0, most_sister: float = 16.0) -> DataFrame:
    """Parents p with one child d1 in the next frame, and parentless detections d2 near both: one row with geometry for each d2."""
    children = only_children(links)
    parents = det.join(children.where(F.col("um") <= most_pd1).select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
    near = radius_pairs(parents, orphans_of_frames(det, links), most_pd2)
    near = near.select("dataset", "t", F.col("a_id").alias("p_id"), F.col("b_id").alias("d2_id"), F.col("um").alias("p_d2_um"), *[F.col(f"a_{c}").alias(f"p_{c}") for c in AXES], *[F.col(f"b_{c}").alias(f"d2_{c}") for c in AXES])
    rows = near.join(children.select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d1_id"), F.col("um").alias("p_d1_um")), "p_id").join(_at(det, "d1_id", "d1_"), "d1_id")
    rows = rows.withColumn("sister_um", distance("d1_", "d2_")).where(F.col("sister_um") <= most_sister)
    rows = _grandchildren(rows, det, children)
    rank = F.row_number().over(W.partitionBy("p_id").orderBy("mirror_um", "d2_id")) - 1
    return (
        rows.withColumn("angle_deg", angle("d1_", "p_", "d2_"))
        .withColumn("mirror_um", mirror_distance("p_", "d1_", "d2_"))
        .withColumn("len_ratio", F.least("p_d1_um", "p_d2_um") / F.greatest("p_d1_um", "p_d2_um", F.lit(1e-6)))
        .withColumn("t2_gain_um", F.col("t2_um") - F.col("sister_um"))
        .withColumn("mirror_rank", rank)
        .select("dataset", "t", "p_id", "d1_id", "d2_id", "p_d1_um", "p_d2_um", "sister_um", "angle_deg", "mirror_um", "len_ratio", "t2_gain_um", "mirror_rank", *[f"p_{c}" for c in AXES])
    )


def safe_divisions(det: DataFrame, links: DataFrame, most_child=10.0, most_new=9.0, most_sister=14.0, least_gain=2.25, asymmetry=0.6, children: DataFrame | None = None) -> DataFrame:
    """(dataset, t, p_id, d1_id, d2_id, score) of rule-based divisions; a lower score is better.

    A fork can only be that of an only child d1 and the parentless d2 nearest to it, so one search in frames finds all of
    them; whether they have children is asked before places are looked up. children: only_children(links), if they are known.
    """
    children = only_children(links) if children is None else children
    near = children.where(F.col("um") <= most_child)
    mark = lambda rows, kid: rows.select(F.col("target_id").alias("node_id"), F.lit(kid).alias("kid"))
    marks = mark(links, False).unionByName(mark(near, True)).groupBy("node_id").agg(F.max("kid").alias("kid"))
    # neither side of the search has to be shuffled by id again
    places = Scratch(det.sparkSession, "safe", tidy=True).keep(det.select("dataset", "t", "node_id", *AXES).join(marks, "node_id", "left").where("coalesce(kid, true)"), "places")
    free, kids = places.where("kid is null"), places.where("kid")
    # the fewer ones are copied into the cells around theirs
    closest = nearest(radius_pairs(free, kids, most_sister, 0, width=4), "b_id", "a_id").select("dataset", (F.col("t") - 1).alias("t"), F.col("b_id").alias("d1_id"), F.col("a_id").alias("d2_id"), F.col("um").alias("sister_um"))
    child = lambda of, to: children.select(F.col("source_id").alias(of), F.col("target_id").alias(to))
    rows = closest.join(child("d2_id", "c2"), "d2_id").join(child("d1_id", "c1"), "d1_id")
    rows = rows.join(near.select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d1_id"), F.col("um").alias("p_d1_um")), "d1_id")
    rows = rows.join(_at(det, "d2_id", "d2_"), "d2_id").join(_at(det, "p_id", "p_"), "p_id").withColumn("p_d2_um", distance("p_", "d2_")).where(F.col("p_d2_um") <= most_new)
    # daughters that both lie where the parent does have no asymmetry, and are none
    rows = rows.where(F.try_divide(F.abs(F.col("p_d1_um") - F.col("p_d2_um")), (F.col("p_d1_um") + F.col("p_d2_um")) / 2) <= asymmetry)
    rows = rows.join(_at(det, "c1", "c1_"), "c1").join(_at(det, "c2", "c2_"), "c2").where(distance("c1_", "c2_") - F.col("sister_um") >= least_gain)
    return rows.select("dataset", "t", "p_id", "d1_id", "d2_id", (F.col("p_d2_um") + 0.15 * F.col("sister_um")).alias("score"))


def geometry_filter(cands: DataFrame, most_mirror: float, least_pd2: float, most_pd2: float, least_angle: float) -> DataFrame:
    """Candidates within bounds; a null or NaN measure fails."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return cands.where(ok("mirror_um") & ok("p_d2_um") & ok("angle_deg") & (F.col("mirror_um") <= most_mirror) & F.col("p_d2_um").between(least_pd2, most_pd2) & (F.col("angle_deg") >= least_angle))


def add_gate(cands: DataFrame, edges_with_prob: DataFrame) -> DataFrame:
    """Candidates whose new link was seen by the model, with a wide angle and daughters that move apart."""
    seen = edges_with_prob.select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d2_id")).distinct()
    gain = F.coalesce("t2_gain_um", F.lit(-1.0))
    return cands.join(seen, ["p_id", "d2_id"], "left_semi").where((F.col("angle_deg") >= 90) & ~F.isnan("angle_deg") & (F.when(F.isnan(gain), -1.0).otherwise(gain) > 0))


def top_within(rows: DataFrame, caps: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first rows of each key, up to its cap; caps(keys.., cap) holds each key once.

    The largest cap comes to the driver first (one number), so that each partition passes on no more rows of a key than that.
    """
    most = caps.agg(F.max("cap")).first()[0]
    if most is None or most < 1:
        return rows.limit(0)
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= int(most))
    return ranked.join(caps, keys).where(F.col("_k") <= F.col("cap")).drop("_k", "cap")


def capped(adds: DataFrame, sources: DataFrame, links: DataFrame, score: str = "score", frame_part: float = 0.0076, edge_part: float = 0.00375) -> DataFrame:
    """Additions within a budget for each frame and then for each dataset, the best first.

    The budgets are max(1, part of the frame's sources) and max(1, part of the dataset's links), rounded half to even.
    """
    budget = lambda n, part: F.greatest(F.lit(1), F.bround(n * part)).alias("cap")
    one = lambda keys: adds.select(*keys, F.lit(1.0).alias("least")).distinct()
    per_frame = sources.groupBy("dataset", "t").agg(budget(F.countDistinct("source_id"), frame_part))
    per_set = links.groupBy("dataset").agg(budget(F.count("*"), edge_part))
    order = [F.col(score).desc(), F.col("p_id"), F.col("d2_id")]
    for keys, caps in ((["dataset", "t"], per_frame), (["dataset"], per_set)):
        adds = top_within(adds, one(keys).join(caps, keys, "left").select(*keys, F.coalesce("cap", "least").alias("cap")), keys, order)
    return adds


def choose_forks(cands: DataFrame, tau: float, frames: int = 1, radius_um: float = 10.0, score: str = "score", safe: DataFrame | None = None) -> DataFrame:
    """The greedy selection of forks, as rounds over all datasets at once.

    In the greedy order (parents by score, then id) a parent takes the free d2 with the least mirror distance, unless an
    accepted parent lies within so many frames and so near. A parent can be settled as soon as no unsettled better parent
    is near it or wants one of its d2; each round settles all such parents, with the same result as one by one.
    cands: dataset, t, p_id, d2_id, mirror_um, score, p_z, p_y, p_x. safe (dataset, t, p_id, d2_id, p_z, p_y, p_x): forks that
    are there already; their parents and daughters are used, and none is added near them.
    """
    scratch = Scratch(cands.sparkSession, "forks")
    keep = scratch.keep
    pool = keep(cands.where(F.col(score) >= tau).select("dataset", "t", "p_id", "d2_id", "mirror_um", F.col(score).alias("s"), *[f"p_{c}" for c in AXES]).distinct(), "pool")
    if safe is not None:
        place = lambda rows: rows.select("dataset", "t", F.col("p_id").alias("node_id"), *[F.col(f"p_{c}").alias(c) for c in AXES]).distinct()
        beside = safe.select("p_id")
        for k in range(-frames, frames + 1):
            beside = beside.union(radius_pairs(place(pool), place(safe), radius_um, k).select("a_id"))
        pool = keep(pool.join(beside.distinct(), "p_id", "left_anti").join(safe.select("d2_id").distinct(), "d2_id", "left_anti"), "pool")
    parents = pool.groupBy("p_id").agg(F.max("s").alias("s"), *[F.first(c).alias(c) for c in ("dataset", "t", "p_z", "p_y", "p_x")])
    parents = keep(parents.withColumn("rank", F.struct((-F.col("s")).alias("s"), F.col("p_id").alias("p"))), "parents")
    det = parents.select("dataset", "t", F.col("p_id").alias("node_id"), *[F.col(f"p_{c}").alias(c) for c in AXES])
    near = None
    for k in range(-frames, frames + 1):
        pairs = radius_pairs(det, det, radius_um, k).where("a_id <> b_id").select(F.col("a_id").alias("p_id"), F.col("b_id").alias("other"))
        near = pairs if near is None else near.unionByName(pairs)
    ranks = parents.select("p_id", "rank")
    near = near.join(ranks, "p_id").join(ranks.select(F.col("p_id").alias("other"), F.col("rank").alias("other_rank")), "other")
    near = keep(near.where("other_rank < rank").select("p_id", "other"), "near")

    open_, taken = keep(pool.join(ranks, "p_id").select("p_id", "d2_id", "mirror_um", "rank"), "open"), None
    while True:
        left = open_.select("p_id").distinct()
        waits = near.join(left, "p_id", "left_semi").join(left.withColumnRenamed("p_id", "other"), "other", "left_semi").select("p_id").distinct()
        first = open_.groupBy("d2_id").agg(F.min("rank").alias("first"))
        behind = open_.join(first, "d2_id").where("first < rank").select("p_id").distinct()
        ready = left.join(waits, "p_id", "left_anti").join(behind, "p_id", "left_anti")
        picks = open_.join(ready, "p_id", "left_semi").groupBy("p_id").agg(F.min(F.struct("mirror_um", "d2_id")).alias("pick")).select("p_id", "pick.d2_id")
        picks = keep(picks, "picks")
        if not picks.limit(1).count():
            break
        taken = picks if taken is None else taken.unionByName(picks)
        # settled parents, those near an accepted one, and used daughters leave
        shut = near.join(picks.select(F.col("p_id").alias("other")), "other", "left_semi").select("p_id").union(picks.select("p_id")).distinct()
        rest = keep(open_.join(shut, "p_id", "left_anti").join(picks.select("d2_id"), "d2_id", "left_anti"), "open")
        scratch.drop(open_)
        open_ = rest
    chosen = pool.limit(0).select("p_id", "d2_id") if taken is None else taken
    return parents.select("p_id", "dataset", "t", "s").join(chosen, "p_id").select("dataset", "t", "p_id", "d2_id", F.col("s").alias("score"))


def conditional_logit(cands: DataFrame, utility) -> DataFrame:
    """Probability of each candidate among those for one d2, with the choice of none."""
    rows = cands.withColumn("_e", F.exp(utility))
    total = rows.groupBy("dataset", "d2_id").agg(F.sum("_e").alias("_sum"))
    return rows.join(total, ["dataset", "d2_id"]).withColumn("prob", F.col("_e") / (1 + F.col("_sum"))).drop("_e", "_sum")
