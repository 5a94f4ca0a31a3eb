"""Radius, nearest-neighbour and mutual joins between frames.

Pairs are found by an equi-join on dataset, frame and grid cell: cells are as wide as the radius in y and x, and one side
looks into the cells around its own. No pair is formed that is further apart than two cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, SCALE, distance
from stemline.store import Scratch


#: Partners of a frame that are all compared.
SMALL = 64


def radius_pairs(left: DataFrame, right: DataFrame, radius_um: float, frames: int = 1, width: int = 1) -> DataFrame:
    """(dataset, t, a_id, a_z.., b_id, b_z.., um): detections of right at most radius_um from one of left, that many frames later.

    width: of a cell, in radii. Wider cells mean fewer copies of left, and more pairs that are compared.
    """
    cell = lambda p, c, k=0: (F.floor(F.col(f"{p}{c}") * SCALE[c] / (radius_um * width)) + k).cast("long")
    a = left.select("dataset", "t", F.col("node_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in AXES])
    b = right.select("dataset", (F.col("t") - frames).alias("t"), F.col("node_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in AXES])
    if width == 1:
        around = lambda c: F.explode(F.array(*[cell("a_", c, k) for k in (-1, 0, 1)]))
    else:
        edge = lambda c, by: F.floor((F.col(f"a_{c}") * SCALE[c] + by * (radius_um + 1e-6)) / (radius_um * width)).cast("long")
        around = lambda c: F.explode(F.sequence(edge(c, -1), edge(c, 1)))
    a = a.withColumn("cy", around("y")).withColumn("cx", around("x"))
    b = b.withColumn("cy", cell("b_", "y")).withColumn("cx", cell("b_", "x"))
    return a.join(b, ["dataset", "t", "cy", "cx"]).withColumn("um", distance("a_", "b_")).where(F.col("um") <= radius_um).drop("cy", "cx")


def nearest(pairs: DataFrame, key: str = "a_id", other: str = "b_id", k: int = 1) -> DataFrame:
    """The k nearest partners of each key, ties by id, with their rank from 1."""
    if k == 1:  # combined before the shuffle
        best = pairs.groupBy("dataset", "t", key).agg(F.min(F.struct("um", other)).alias("best"))
        return best.select("dataset", "t", key, F.col(f"best.{other}").alias(other), F.col("best.um").alias("um"), F.lit(1).alias("rank"))
    w = W.partitionBy(key).orderBy("um", other)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_anywhere(left: DataFrame, right: DataFrame, frames: int = 1, k: int = 1, start_um: float = 12.0, growth: float = 4.0) -> DataFrame:
    """The k nearest partners of each detection of left, however far, with their rank; a detection is no partner of itself.

    In frames of at most SMALL partners all of them are compared. In others rings grow: who has k partners within the radius,
    or all that the frame has, is settled; the others look further.
    """
    scratch = Scratch(left.sparkSession, "nearest")
    there = right.groupBy("dataset", (F.col("t") - frames).alias("t")).agg(F.count("*").alias("there"))
    own = F.lit(1) if frames == 0 else F.lit(0)
    open_ = left.select("dataset", "t", "node_id", *AXES).join(there, ["dataset", "t"]).where(F.col("there") > own)
    open_, radius = scratch.keep(open_, "open"), start_um
    at = lambda rows, p: rows.select("dataset", "t", F.col("node_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in AXES])
    few = at(open_.where(F.col("there") <= SMALL), "a").join(at(right.withColumn("t", F.col("t") - frames), "b"), ["dataset", "t"]).where("a_id <> b_id")
    done = nearest(few.select("dataset", "t", "a_id", "b_id", distance("a_", "b_").alias("um")), k=k)
    open_ = open_.where(F.col("there") > SMALL)
    while open_.limit(1).count():
        pairs = radius_pairs(open_, right, radius, frames, width=2).where("a_id <> b_id").select("dataset", "t", "a_id", "b_id", "um")
        near = scratch.keep(nearest(pairs, k=k), "near")
        got = near.groupBy(F.col("a_id").alias("node_id")).agg(F.count("*").alias("got"))
        rows = scratch.keep(open_.join(got, "node_id", "left").withColumn("settled", F.coalesce("got", F.lit(0)) >= F.least(F.lit(k), F.col("there") - own)).drop("got"), "rows")
        done = done.unionByName(near.join(rows.where("settled").select(F.col("node_id").alias("a_id")), "a_id", "left_semi"))
        open_, radius = rows.where("not settled").drop("settled"), radius * growth
    return done.select("dataset", "t", "a_id", "b_id", "um", "rank")


def mutual(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    ab, ba = nearest(pairs), nearest(pairs, "b_id", "a_id")
    return ab.join(ba.select("a_id", "b_id"), ["a_id", "b_id"], "left_semi").select("dataset", "t", "a_id", "b_id", "um")


def spacing(det: DataFrame, k: int = 3, default: float = 6.5) -> DataFrame:
    """(node_id, dataset, t, spacing_um): the median distance to the k nearest neighbours of the same frame; default without any."""
    near = nearest_anywhere(det, det, 0, k).groupBy(F.col("a_id").alias("node_id")).agg(F.median("um").alias("spacing_um"))
    return det.select("node_id", "dataset", "t").join(near, "node_id", "left").fillna(default, ["spacing_um"])


def frame_spacing(of: DataFrame, det: DataFrame, within_um: float = 20.0, default: float = 6.5) -> DataFrame:
    """(node_id, spacing_um): for detections of, the median distance to the three nearest ones of det in their frame, however far.

    In frames of four or more it is the distance of the second nearest, and above within_um it stands at within_um.
    """
    sizes = det.groupBy("dataset", "t").agg(F.count("*").alias("n"))
    near = nearest(radius_pairs(of, det, within_um, 0, width=4).where("a_id <> b_id"), k=2).where("rank = 2").select(F.col("a_id").alias("node_id"), F.col("um").alias("second"))
    few = sizes.where("n in (2, 3)").select("dataset", "t")
    at = lambda rows, p: rows.select("dataset", "t", F.col("node_id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    pairs = at(of.join(few, ["dataset", "t"], "left_semi"), "a_").join(at(det, "b_"), ["dataset", "t"]).where("a_id <> b_id").withColumn("um", distance("a_", "b_"))
    whole = pairs.groupBy(F.col("a_id").alias("node_id")).agg(F.avg("um").alias("mean"))  # of two, and so their median
    rows = of.select("node_id", "dataset", "t").join(sizes, ["dataset", "t"]).join(near, "node_id", "left").join(whole, "node_id", "left")
    spacing = F.when(F.col("n") >= 4, F.coalesce("second", F.lit(within_um))).otherwise(F.coalesce("mean", F.lit(default)))
    return rows.select("node_id", spacing.alias("spacing_um"))


def flow(points: DataFrame, samples: DataFrame, k: int = 12, reach_um: float = 40.0, exclude_um: float = 1.5) -> DataFrame:
    """The motion at each point: per axis, the median of up to k samples of its transition within reach.

    Of the k + 1 nearest, those below exclude_um are a point's own ones and leave; then the first k count.

    samples(dataset, t, node_id, z, y, x, dz, dy, dx): where a step starts, and the step in micrometres.
    """
    near = nearest(radius_pairs(points, samples, reach_um, 0), k=k + 1).where(F.col("um") >= exclude_um)
    rank = F.row_number().over(W.partitionBy("a_id").orderBy("um", "b_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).join(samples.select(F.col("node_id").alias("b_id"), "dz", "dy", "dx"), "b_id")
    return near.groupBy(F.col("a_id").alias("node_id")).agg(F.count("*").alias("n_samples"), *[F.median(f"d{c}").alias(f"flow_{c}") for c in AXES])
