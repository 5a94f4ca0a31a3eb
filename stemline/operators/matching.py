"""One-to-one joins: greedy by rounds, and at least total cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.functions.pairing import best_pairs
from stemline.functions.runs import whole_groups
from stemline.store import Scratch


def greedy_matching(pairs: DataFrame, left: str = "a_id", right: str = "b_id", cost: str = "um") -> DataFrame:
    """The pairs that a greedy choice by (cost, left, right) takes, each left and right once.

    A pair that is the best one of both its ends is taken whatever else happens; each round takes all of these.
    """
    scratch = Scratch(pairs.sparkSession, "greedy")
    open_ = scratch.keep(pairs.withColumn("_r", F.struct(F.col(cost).alias("c"), F.col(left).alias("l"), F.col(right).alias("r"))), "pairs")
    taken = None
    while True:
        best_l = open_.groupBy(left).agg(F.min("_r").alias("_l"))
        best_r = open_.groupBy(right).agg(F.min("_r").alias("_b"))
        picks = scratch.keep(open_.join(best_l, left).join(best_r, right).where("_r = _l and _r = _b").drop("_l", "_b"), "picks")
        if not picks.limit(1).count():
            break
        taken = picks if taken is None else taken.unionByName(picks)
        rest = scratch.keep(open_.join(picks.select(left), left, "left_anti").join(picks.select(right), right, "left_anti"), "pairs")
        scratch.drop(open_)
        open_ = rest
    return (open_ if taken is None else taken).drop("_r")


def _components(pairs: DataFrame, left: str, right: str, cost: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pairs whose ends have no other pair, and the others with the least left id of their component.

    Ids spread over the pairs, and each row then takes the label of its label, so that long chains need few rounds.
    """
    pairs = scratch.keep(pairs.select(left, right, cost), "pairs")
    alone_l = pairs.groupBy(left).agg(F.count("*").alias("_nl"))
    alone_r = pairs.groupBy(right).agg(F.count("*").alias("_nr"))
    counted = scratch.keep(pairs.join(alone_l, left).join(alone_r, right), "counted")
    simple = counted.where("_nl = 1 and _nr = 1").select(left, right, cost)
    crowded = scratch.keep(counted.where("_nl > 1 or _nr > 1").select(left, right, cost), "crowded")
    label = scratch.keep(crowded.select(F.col(left).alias("v"), F.col(left).alias("comp")).distinct(), "labels")
    while True:
        rows = crowded.join(label.select(F.col("v").alias(left), "comp"), left)
        low = rows.groupBy(right).agg(F.min("comp").alias("low"))
        near = rows.join(low, right).groupBy(F.col(left).alias("v")).agg(F.min("low").alias("near"))
        jump = label.select(F.col("v").alias("near"), F.col("comp").alias("then"))
        new = label.join(near, "v").join(jump, "near").select("v", F.least("near", "then").alias("comp"), (F.least("near", "then") < F.col("comp")).alias("moved"))
        new = scratch.keep(new, "labels")
        scratch.drop(label)
        label = new.select("v", "comp")
        label._stemline_path = new._stemline_path
        if not new.where("moved").limit(1).count():
            return simple, crowded.join(label.select(F.col("v").alias(left), "comp"), left)


def crowds(pairs: DataFrame, left: str = "a_id", right: str = "b_id", cost: str = "um") -> DataFrame:
    """(n_pairs, n_components): how many components of so many pairs an assignment has to solve."""
    simple, label = _components(pairs, left, right, cost, Scratch(pairs.sparkSession, "crowds"))
    sizes = label.groupBy("comp").agg(F.count("*").alias("n_pairs")).select("n_pairs").unionByName(simple.select(F.lit(1).cast("long").alias("n_pairs")))
    return sizes.groupBy("n_pairs").agg(F.count("*").alias("n_components"))


def assignment(pairs: DataFrame, left: str = "a_id", right: str = "b_id", cost: str = "um") -> DataFrame:
    """The one-to-one pairs that are most in number and, among these, least in total cost.

    Pairs whose ends have no other pair are settled at once. The rest falls into connected components, found by spreading
    least ids; each is solved by itself over its pairs only, as the optimum of the whole is that of its components. They are
    as large as crowds of detections within the gate, not as frames; crowds() reports them.
    """
    scratch = Scratch(pairs.sparkSession, "assignment")
    simple, label = _components(pairs, left, right, cost, scratch)

    def solve(batches):
        for t in whole_groups(batches, "comp"):
            a, b, c = (t.column(x).to_numpy() for x in (left, right, cost))
            at = np.lexsort((c, b, a))
            a, b, c = a[at], b[at], c[at]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # of repeated pairs the cheapest
            a, b, c = a[first], b[first], c[first]
            got = best_pairs(np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1], c)
            yield pa.RecordBatch.from_arrays([pa.array(x[got], kind) for x, kind in zip((a, b, c), (pa.int64(), pa.int64(), pa.float64()))], [left, right, cost])

    # so many partitions even for few rows: the work lies in Python
    parallel = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowds = label.select("comp", left, right, cost).repartition(parallel, "comp").sortWithinPartitions("comp")
    return simple.unionByName(crowds.mapInArrow(solve, f"{left} long, {right} long, {cost} double"))
