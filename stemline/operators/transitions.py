"""Frames and the transitions between them: frozen frames, typical motion, jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES


def digests(det: DataFrame) -> DataFrame:
    """(dataset, t, n, d1, d2): the number of detections of each frame, and two digests of its positions that no order changes."""
    at = [F.col(c) + 0.0 for c in AXES]
    return det.groupBy("dataset", "t").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*at).cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64(*at, F.lit(1))).alias("d2")
    )


def frozen(det: DataFrame) -> DataFrame:
    """(dataset, t, frozen) of each transition t to t + 1 of frames that exist: whether the frame is repeated."""
    d = digests(det)
    w = W.partitionBy("dataset").orderBy("t")
    same = F.lit(True)
    for c in [c for c in d.columns if c not in ("dataset", "t")]:
        same = same & (F.lead(c).over(w) == F.col(c))
    return d.select("dataset", "t", F.coalesce(same & (F.lead("t").over(w) == F.col("t") + 1), F.lit(False)).alias("frozen"))


def run_lengths(table: DataFrame) -> DataFrame:
    """With k: how many frozen transitions stand directly before t; a missing one ends the run."""
    w = W.partitionBy("dataset").orderBy("t")
    # t - row number is equal along unbroken stretches; within them, count since the last one that is not frozen
    rows = table.withColumn("stretch", F.col("t") - F.row_number().over(w))
    before = W.partitionBy("dataset", "stretch").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(~F.col("frozen"), F.col("t"))).over(before)
    first = F.min("t").over(W.partitionBy("dataset", "stretch"))
    return rows.withColumn("k", (F.col("t") - 1 - F.coalesce(last, first - 1)).cast("int")).drop("stretch")


def kinds(table: DataFrame, links: DataFrame, factor: float = 2.0, least: int = 4) -> DataFrame:
    """(dataset, t, kind, reason, k, step_um): frozen; jump after frozen ones or with steps of factor times the movie's; else normal."""
    steps = links.groupBy("dataset", "t").agg(F.count("*").alias("n"), F.median("um").alias("step_um")).where(F.col("n") >= least).drop("n")
    rows = run_lengths(table).join(steps, ["dataset", "t"], "left")
    movie = rows.where("not frozen and step_um is not null").groupBy("dataset").agg(F.median("step_um").alias("movie_um"))
    rows = rows.join(movie, "dataset", "left")
    wide = (F.col("movie_um") > 0) & (F.col("step_um") >= factor * F.col("movie_um"))
    kind = F.when(F.col("frozen"), "frozen").when((F.col("k") >= 1) | F.coalesce(wide, F.lit(False)), "jump").otherwise("normal")
    reason = F.when(F.col("frozen"), "frozen").when(F.col("k") >= 1, "after_frozen").when(F.coalesce(wide, F.lit(False)), "seed_median").otherwise("")
    return rows.select("dataset", "t", kind.alias("kind"), reason.alias("reason"), "k", "step_um")
