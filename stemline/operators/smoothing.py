"""Smoothing along tracks, and one place for a nucleus in repeated frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.functions.geometry import AXES, SCALE, distance


def line_fit(det: DataFrame, links: DataFrame, kinds: DataFrame | None = None, shifts: DataFrame | None = None, weight: float = 0.8) -> DataFrame:
    """Detections with z, y, x pulled toward a straight line through up to two steps before and behind.

    The walk ends where a node has not exactly one neighbour on that side, at frozen transitions, and at jumps without a
    shift; across a jump with one, positions behind it are moved back by the shift. Fewer than three places: unchanged.
    kinds(dataset, t, kind); shifts(dataset, t, dz, dy, dx) in micrometres.
    """
    step = links.select("dataset", "t", "source_id", "target_id")
    for c in AXES:
        step = step.withColumn(f"h{c}", F.lit(0.0))
    if kinds is not None:
        step = step.join(kinds.where("kind <> 'normal'").select("dataset", "t", "kind"), ["dataset", "t"], "left")
        if shifts is not None:
            step = step.drop("hz", "hy", "hx").join(shifts.select("dataset", "t", *[(F.col(f"d{c}") / SCALE[c]).alias(f"h{c}") for c in AXES]), ["dataset", "t"], "left")
            step = step.withColumn("shifted", F.col("hz").isNotNull()).fillna(0.0, ["hz", "hy", "hx"])
        else:
            step = step.withColumn("shifted", F.lit(False))
        open_ = F.col("kind").isNull() | ((F.col("kind") == "jump") & F.col("shifted"))
        for c in AXES:
            step = step.withColumn(f"h{c}", F.when(F.col("kind") == "jump", F.col(f"h{c}")).otherwise(0.0))
    else:
        open_ = F.lit(True)
    step = step.withColumn("open", open_)

    def walk(here: str, there: str, sign: int) -> DataFrame:
        one = step.groupBy(here).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (there, "open", "hz", "hy", "hx")]).where("n = 1 and open")
        place = det.select(F.col("node_id").alias(there), *AXES)
        first = one.join(place, there).select(F.col(here).alias("node_id"), F.col(there).alias("via"), F.lit(sign).alias("dt"), *[(sign * F.col(f"h{c}")).alias(f"o{c}") for c in AXES], *AXES)
        second = first.select("node_id", F.col("via").alias(here), "oz", "oy", "ox").join(one, here).join(place, there)
        second = second.select("node_id", F.col(there).alias("via"), F.lit(2 * sign).alias("dt"), *[(F.col(f"o{c}") + sign * F.col(f"h{c}")).alias(f"o{c}") for c in AXES], *AXES)
        return first.unionByName(second)

    around = walk("source_id", "target_id", 1).unionByName(walk("target_id", "source_id", -1))
    points = around.select("node_id", "dt", *[(F.col(c) - F.col(f"o{c}")).alias(c) for c in AXES]).unionByName(det.select("node_id", F.lit(0).alias("dt"), *AXES))
    fitted = points.groupBy("node_id").agg(F.count("*").alias("n"), *[F.regr_intercept(c, F.col("dt").cast("double")).alias(f"f{c}") for c in AXES]).where("n >= 3")
    rows = det.join(fitted, "node_id", "left")
    return rows.select(*[F.when(F.col("n").isNull(), F.col(c)).otherwise((1 - weight) * F.col(c) + weight * F.col(f"f{c}")).alias(c) if c in AXES else F.col(c) for c in det.columns])


def consensus(smoothed: DataFrame, before: DataFrame, links: DataFrame, kinds: DataFrame, most_um: float = 1.625) -> DataFrame:
    """Nodes linked one to one across frozen transitions take the mean of their places, unless one is further than most_um from it.

    Chains are short (runs of frozen transitions), so their heads are found by following links to the end.
    """
    n_out = links.groupBy("source_id").agg(F.count("*").alias("n_out"))
    n_in = links.groupBy("target_id").agg(F.count("*").alias("n_in"))
    parents_of_source, children_of_target = n_in.select(F.col("target_id").alias("source_id"), F.col("n_in").alias("above")), n_out.select(F.col("source_id").alias("target_id"), F.col("n_out").alias("below"))
    chain = links.select("dataset", "t", "source_id", "target_id").join(kinds.where("kind = 'frozen'").select("dataset", "t"), ["dataset", "t"], "left_semi")
    chain = chain.join(n_out, "source_id").join(n_in, "target_id").join(parents_of_source, "source_id", "left").join(children_of_target, "target_id", "left")
    chain = chain.where("n_out = 1 and n_in = 1 and coalesce(above, 0) <= 1 and coalesce(below, 0) <= 1")
    at = lambda key, p: before.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    chain = chain.join(at("source_id", "s_"), "source_id").join(at("target_id", "g_"), "target_id").where(distance("s_", "g_") <= most_um).select("source_id", "target_id")

    from stemline.operators.hierarchy import nested_sets
    from stemline.store import Scratch

    scratch = Scratch(smoothed.sparkSession, "consensus")
    chain = scratch.keep(chain, "chain")
    ends = chain.select(F.col("target_id").alias("v"), F.col("source_id").alias("p")).unionByName(chain.select(F.col("source_id").alias("v"), F.lit(None).cast("long").alias("p")))
    head = nested_sets(ends.groupBy("v").agg(F.max("p").alias("p")), scratch).select(F.col("v").alias("node_id"), F.col("root").alias("head"))
    placed = head.join(smoothed.select("node_id", *AXES), "node_id")
    mean = placed.groupBy("head").agg(*[F.avg(c).alias(f"m_{c}") for c in AXES])
    far = placed.join(mean, "head").withColumn("off", distance("", "m_")).groupBy("head").agg(F.max("off").alias("off"), *[F.first(f"m_{c}").alias(f"m_{c}") for c in AXES]).where(F.col("off") <= most_um)
    moved = head.join(far, "head").select("node_id", *[f"m_{c}" for c in AXES])
    rows = smoothed.join(moved, "node_id", "left")
    return rows.select(*[F.coalesce(f"m_{c}", c).alias(c) if c in AXES else F.col(c) for c in smoothed.columns], F.col("m_z").isNotNull().alias("moved"))
