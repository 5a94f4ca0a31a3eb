"""Divisions judged by topology: an added fork by what it would score, and predicted divisions by their components.

Both take forests (one parent, at most two children) and a one-to-one match (pred_id, true_id). All steps are equi-joins
on node ids; what lies below a node comes from nested-set ranges, so no lineage is walked. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.operators.hierarchy import nested_sets
from stemline.store import Scratch

#: Width of a bucket of preorder places.
BUCKET = 1_000_000


def trees(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, root, pre, size) of each node of a forest."""
    ends = links.select(F.col("target_id").alias("v"), F.col("source_id").alias("p")).unionByName(links.select(F.col("source_id").alias("v"), F.lit(None).cast("long").alias("p")))
    return nested_sets(ends.groupBy("v").agg(F.max("p").alias("p")), scratch).select(F.col("v").alias("node_id"), "root", "pre", "size")


def next_mark(asked: DataFrame, marks: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """asked(keys.., at, ..) with ``next``: the least ``at`` of the marks(keys.., at) of its keys at or behind its own, else null.

    Windows are cut into buckets of places, so that one long run of keys is not one task.
    """
    number = F.floor(F.col("at") / bucket).alias("bucket")
    marks = marks.select(*keys, "at").distinct()
    firsts = marks.groupBy(*keys, number).agg(F.min("at").alias("first"))
    spans = firsts.unionByName(asked.select(*keys, number).distinct(), allowMissingColumns=True).groupBy(*keys, "bucket").agg(F.min("first").alias("first"))
    ahead = W.partitionBy(*keys).orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(*keys, "bucket", F.min("first").over(ahead).alias("beyond"))
    rows = asked.withColumn("asks", F.lit(True)).unionByName(marks.withColumn("asks", F.lit(False)), allowMissingColumns=True).withColumn("bucket", number)
    here = W.partitionBy(*keys, "bucket").orderBy(F.col("at").desc(), "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("near", F.min(F.when(~F.col("asks"), F.col("at"))).over(here)).where("asks")
    return rows.join(spans, [*keys, "bucket"]).withColumn("next", F.coalesce("near", "beyond")).drop("asks", "near", "beyond", "bucket")


def _children(truth: DataFrame) -> DataFrame:
    """(dataset, g, c0, c1) of nodes that divide."""
    both = truth.groupBy("dataset", F.col("source_id").alias("g")).agg(F.min("target_id").alias("c0"), F.max("target_id").alias("c1"))
    return both.where("c0 < c1")


def division_proxy(pred: DataFrame, truth: DataFrame, match: DataFrame, scratch: Scratch) -> DataFrame:
    """(dataset, true_id, outcome): divisions found by component.

    tp: the divider or its parent is matched into a predicted component that has a fork and holds a matched descendant of
    each daughter; fn: no such component; fp: a predicted fork at a matched node that has children but is not a tp.
    """
    comps = scratch.keep(trees(pred, scratch), "pred_trees")
    sets = scratch.keep(trees(truth, scratch), "true_trees")
    forks = scratch.keep(pred.groupBy("source_id").agg(F.min("target_id").alias("lo"), F.max("target_id").alias("hi")).where("lo < hi").select(F.col("source_id").alias("pred_id")), "forks")
    forked = comps.join(forks.withColumnRenamed("pred_id", "node_id"), "node_id", "left_semi").select(F.col("root").alias("comp")).distinct()
    placed = match.join(comps.select(F.col("node_id").alias("pred_id"), F.col("root").alias("comp")), "pred_id").join(forked, "comp", "left_semi").select("true_id", "comp")
    placed = scratch.keep(placed, "placed")
    marks = placed.join(sets.select(F.col("node_id").alias("true_id"), "root", F.col("pre").alias("at")), "true_id").select("root", "comp", "at")

    divisions = scratch.keep(_children(truth), "divisions")
    parents = truth.select(F.col("target_id").alias("g"), F.col("source_id").alias("true_id"))
    own = divisions.select("g", F.col("g").alias("true_id"))
    anchors = own.unionByName(parents.join(divisions.select("g"), "g", "left_semi")).join(placed, "true_id").select("g", "comp").distinct()
    sides = divisions.select("g", F.explode(F.array("c0", "c1")).alias("node_id")).join(sets, "node_id")
    asked = anchors.join(sides, "g").select("g", "comp", "root", F.col("pre").alias("at"), (F.col("pre") + F.col("size") - 1).alias("upto"))
    hit = next_mark(asked, marks, ["root", "comp"]).where(F.col("next") <= F.col("upto"))
    found = hit.groupBy("g", "comp").agg(F.count("*").alias("n")).where("n = 2").select("g", F.lit("tp").alias("outcome")).distinct()
    judged = scratch.keep(divisions.join(found, "g", "left").select("dataset", F.col("g").alias("true_id"), F.coalesce("outcome", F.lit("fn")).alias("outcome")), "judged")
    goes_on = truth.select("dataset", F.col("source_id").alias("true_id")).distinct()
    wrong = match.join(forks, "pred_id", "left_semi").join(goes_on, "true_id").join(judged.where("outcome = 'tp'"), "true_id", "left_anti")
    return judged.unionByName(wrong.select("dataset", "true_id", F.lit("fp").alias("outcome")))


def _roles(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, g): dividers and their parents; (v, g, k): the daughters of a division and their children, k 0 or 1."""
    divisions = _children(truth).drop("dataset")
    up = truth.select(F.col("source_id").alias("u"), F.col("target_id").alias("g")).join(divisions.select("g"), "g", "left_semi").select("u", "g")
    heads = divisions.select(F.col("g").alias("u"), "g").unionByName(up)
    kids = divisions.select("g", F.posexplode(F.array("c0", "c1")).alias("k", "v"))
    below = truth.select(F.col("source_id").alias("v"), F.col("target_id").alias("w")).join(kids, "v").select(F.col("w").alias("v"), "g", "k")
    return heads, kids.select("v", "g", "k").unionByName(below)


def _evidence(cands: DataFrame, base: DataFrame, match: DataFrame, comp: DataFrame, heads: DataFrame, kids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For cands(fork_id, p_id, d1_id, d2_id): the fork_id of those across two true trees; (fork_id, g, valid) of divisions near them."""
    to_true = match.select(F.col("pred_id").alias("n"), F.col("true_id").alias("v"))
    step = base.select(F.col("source_id").alias("s"), F.col("target_id").alias("d")).distinct()
    above = cands.select("fork_id", F.col("p_id").alias("d")).join(step, "d").select("fork_id", F.col("s").alias("n"))
    up = cands.select("fork_id", F.col("p_id").alias("n")).unionByName(above).join(to_true, "n")
    near = up.select("fork_id", F.col("v").alias("u")).join(heads, "u").select("fork_id", "g").distinct()
    own = cands.select("fork_id", F.posexplode(F.array("d1_id", "d2_id")).alias("side", "n"))
    after = own.withColumnRenamed("n", "s").join(step, "s").select("fork_id", "side", F.col("d").alias("n"), F.lit(False).alias("own"))
    seen = own.withColumn("own", F.lit(True)).unionByName(after).join(to_true, "n").select("fork_id", "side", "own", "v")

    at = lambda side, k: F.max((F.col("side") == side) & (F.col("k") == k))
    hits = seen.join(kids, "v").groupBy("fork_id", "g").agg(at(0, 0).alias("a0"), at(0, 1).alias("a1"), at(1, 0).alias("b0"), at(1, 1).alias("b1"))
    valid = hits.where("(a0 and b1) or (a1 and b0)").select("fork_id", "g", F.lit(True).alias("valid"))
    near = near.join(valid, ["fork_id", "g"], "left").fillna(False, ["valid"])
    branch = seen.join(comp, "v").groupBy("fork_id", "side").agg(
        F.max(F.when(F.col("own"), F.col("comp"))).alias("mine"), F.min(F.when(~F.col("own"), F.col("comp"))).alias("lo"), F.max(F.when(~F.col("own"), F.col("comp"))).alias("hi")
    )
    branch = branch.select("fork_id", F.coalesce("mine", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).alias("c"))
    across = branch.groupBy("fork_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("fork_id", F.lit(True).alias("crosses"))
    return across, near


def label_forks(cands: DataFrame, base: DataFrame, truth: DataFrame, match: DataFrame, scratch: Scratch, times: DataFrame, true_times: DataFrame) -> DataFrame:
    """(fork_id, label, fp_reason, gt_divider_id, timing_vs_gt, gt_p_id, gt_p_outdeg) of cands(fork_id, p_id, d1_id, d2_id), each taken as added alone to the forest base.

    In this order: fp malformed, if a daughter has another parent or is the other daughter; tp, if it fits a true division
    near the parent that no other fork holds, within one true tree; fp cross_gt_tracks, if the branches lie in two true trees; fp
    near_gt_division, if the parent is at a division that it does not fit; fp annotated_continuing, if the parent is matched to a node
    that goes on; else ignored. gt_divider_id: the least division that it fits or is near, timing_vs_gt the
    frames from it to the parent; gt_p_id and gt_p_outdeg: the true node of the parent and its children; -1 without one.
    Rows with a null id get no label. times, true_times (node_id, t): of the predicted and the true nodes.
    """
    keep = scratch.keep
    cands = keep(cands.select("fork_id", "p_id", "d1_id", "d2_id").dropna().distinct(), "cands")
    comp = keep(trees(truth, scratch).select(F.col("node_id").alias("v"), F.col("root").alias("comp")), "true_trees")
    heads, kids = (keep(r, "roles") for r in _roles(truth))
    old = base.groupBy(F.col("source_id").alias("p_id")).agg(F.min("target_id").alias("d1_id"), F.max("target_id").alias("d2_id")).where("d1_id < d2_id").withColumn("fork_id", F.col("p_id"))
    across, near = _evidence(keep(old, "old"), base, match, comp, heads, kids)
    held = near.where("valid").join(across, "fork_id", "left_anti").groupBy("g").agg(F.min("fork_id").alias("least"), F.max("fork_id").alias("most"))

    across, near = _evidence(cands, base, match, comp, heads, kids)
    parent = cands.select("fork_id", "p_id", F.explode(F.array("d1_id", "d2_id")).alias("target_id")).join(base.select("target_id", "source_id"), "target_id")
    malformed = parent.where("source_id <> p_id").select("fork_id").union(cands.where("d1_id = d2_id").select("fork_id")).distinct().withColumn("malformed", F.lit(True))
    near = near.join(held, "g", "left").join(cands.select("fork_id", "p_id"), "fork_id")
    free = F.col("least").isNull() | ((F.col("least") == F.col("p_id")) & (F.col("most") == F.col("p_id")))
    near = near.groupBy("fork_id").agg(F.min(F.when(F.col("valid") & free, F.col("g"))).alias("fits"), F.min("g").alias("near"))
    goes_on = match.join(truth.select(F.col("source_id").alias("true_id")).distinct(), "true_id", "left_semi").select(F.col("pred_id").alias("p_id"), F.lit(True).alias("goes_on"))
    rows = cands.join(malformed, "fork_id", "left").join(across, "fork_id", "left").join(near, "fork_id", "left").join(goes_on, "p_id", "left")
    fits = F.col("fits").isNotNull() & F.col("crosses").isNull()
    reason = (
        F.when(F.col("malformed"), "malformed").when(fits, "").when(F.col("crosses"), "cross_gt_tracks").when(F.col("near").isNotNull(), "near_gt_division").when(F.col("goes_on"), "annotated_continuing").otherwise("")
    )
    label = F.when(F.col("malformed").isNull() & fits, "tp").when(reason != "", "fp").otherwise("ignored")
    divider = F.when(label == "tp", F.col("fits")).when(reason == "near_gt_division", F.col("near"))
    rows = rows.select("fork_id", "p_id", label.alias("label"), reason.alias("fp_reason"), divider.alias("gt_divider_id"))
    true_p = match.select(F.col("pred_id").alias("p_id"), F.col("true_id").alias("gt_p_id"))
    degree = truth.groupBy(F.col("source_id").alias("gt_p_id")).agg(F.countDistinct("target_id").cast("int").alias("gt_p_outdeg"))
    rows = rows.join(true_p, "p_id", "left").join(degree, "gt_p_id", "left")
    rows = rows.join(times.select(F.col("node_id").alias("p_id"), F.col("t").alias("p_t")), "p_id", "left").join(true_times.select(F.col("node_id").alias("gt_divider_id"), F.col("t").alias("g_t")), "gt_divider_id", "left")
    outdeg = F.when(F.col("gt_p_id").isNull(), -1).otherwise(F.coalesce("gt_p_outdeg", F.lit(0))).alias("gt_p_outdeg")
    minus = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return rows.select("fork_id", "label", "fp_reason", minus("gt_divider_id"), (F.col("p_t") - F.col("g_t")).cast("int").alias("timing_vs_gt"), minus("gt_p_id"), outdeg)
