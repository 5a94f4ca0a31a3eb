"""Scores of a predicted lineage against a sparsely annotated one, and of fork scores against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Thresholds that are tried, in steps of 0.05, then 0.01, then two more.
TAUS = [round(0.05 * k, 4) for k in range(1, 18)] + [round(0.9 + 0.01 * k, 4) for k in range(10)] + [0.995, 0.999]


def edge_confusion(pred: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """(dataset, source_id, target_id, outcome): tp and fp of predicted links, fn of true ones.

    A predicted link that is not a true one counts as fp only next to annotation: if the truth has a parent for its
    target or a child for its source. match: (pred_id, true_id).
    """
    m = lambda p, t: match.select(F.col("pred_id").alias(p), F.col("true_id").alias(t))
    mapped = pred.select("dataset", "source_id", "target_id").distinct().join(m("source_id", "ts"), "source_id", "left").join(m("target_id", "tt"), "target_id", "left")
    true = truth.select("dataset", F.col("source_id").alias("ts"), F.col("target_id").alias("tt")).distinct()
    hit = mapped.join(true.select("ts", "tt", F.lit(True).alias("hit")), ["ts", "tt"], "left")
    hit = hit.join(true.select("tt", F.lit(True).alias("has_parent")).distinct(), "tt", "left").join(true.select("ts", F.lit(True).alias("has_child")).distinct(), "ts", "left")
    outcome = F.when(F.col("hit"), "tp").when(F.col("has_parent") | F.col("has_child"), "fp")
    scored = hit.select("dataset", "source_id", "target_id", outcome.alias("outcome")).where("outcome is not null")
    missed = true.join(mapped.select("ts", "tt").where("ts is not null and tt is not null").distinct(), ["ts", "tt"], "left_anti")
    return scored.unionByName(missed.select("dataset", F.col("ts").alias("source_id"), F.col("tt").alias("target_id"), F.lit("fn").alias("outcome")))


def error_decomposition(pred_nodes: DataFrame, pred: DataFrame, true_nodes: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """(dataset, kind, n): missed and spurious nodes; true links recovered, fragmented (both ends found) or lost to detection; wrong links."""
    found_true, found_pred = match.select(F.col("true_id").alias("node_id")).distinct(), match.select(F.col("pred_id").alias("node_id")).distinct()
    missed = true_nodes.join(found_true, "node_id", "left_anti").select("dataset", F.lit("missed_node").alias("kind"))
    spurious = pred_nodes.join(found_pred, "node_id", "left_anti").select("dataset", F.lit("spurious_node").alias("kind"))
    conf = edge_confusion(pred, truth, match)
    seen = lambda c: found_true.select(F.col("node_id").alias(c), F.lit(True).alias(f"has_{c}"))
    fn = conf.where("outcome = 'fn'").join(seen("source_id"), "source_id", "left").join(seen("target_id"), "target_id", "left")
    lost = fn.select("dataset", F.when(F.col("has_source_id") & F.col("has_target_id"), "fragmented_edge").otherwise("lost_to_detection").alias("kind"))
    rest = conf.where("outcome <> 'fn'").select("dataset", F.when(F.col("outcome") == "tp", "recovered_edge").otherwise("wrong_association").alias("kind"))
    return reduce(DataFrame.unionByName, [missed, spurious, lost, rest]).groupBy("dataset", "kind").agg(F.count("*").alias("n"))


def division_confusion(pred: DataFrame, truth: DataFrame, match: DataFrame) -> DataFrame:
    """(dataset, outcome) of divisions (nodes with two or more children): tp if both sides divide, fp only at annotated nodes that go on, else fn."""
    forks = lambda rows, key: rows.groupBy("dataset", F.col("source_id").alias(key)).agg(F.countDistinct("target_id").alias("n"))
    true, got = forks(truth, "true_id"), forks(pred, "pred_id").where("n >= 2").join(match, "pred_id").select("true_id", F.lit(True).alias("divides"))
    both = true.join(got, "true_id", "left")
    outcome = F.when((F.col("n") >= 2) & F.col("divides"), "tp").when(F.col("n") >= 2, "fn").when(F.col("divides"), "fp")
    return both.select("dataset", outcome.alias("outcome")).where("outcome is not null")


def score_report(confusion: DataFrame, divisions: DataFrame, n_pred: DataFrame, n_true: DataFrame) -> DataFrame:
    """Scores for each dataset, each embryo and all: Jaccard indices pooled, the adjusted one weighted by its edges.

    n_pred, n_true: (dataset, n). The adjusted index is lowered by a tenth of the relative surplus of nodes, not below 0.
    """
    count = lambda c: F.sum(F.when(F.col("outcome") == c, 1).otherwise(0))
    e = confusion.groupBy("dataset").agg(*[count(c).alias(c) for c in ("tp", "fp", "fn")])
    d = divisions.groupBy("dataset").agg(*[count(c).alias(f"d_{c}") for c in ("tp", "fp", "fn")])
    rows = e.join(d, "dataset", "left").join(n_pred.withColumnRenamed("n", "n_pred"), "dataset", "left").join(n_true.withColumnRenamed("n", "n_true"), "dataset", "left")
    rows = rows.fillna(0, ["d_tp", "d_fp", "d_fn", "n_pred", "n_true"]).withColumn("w", F.col("tp") + F.col("fp") + F.col("fn"))
    j = F.col("tp") / F.col("w")
    rows = rows.withColumn("adj", F.greatest(F.lit(0.0), j * (1 - 0.1 * F.when(F.col("n_true") > 0, (F.col("n_pred") - F.col("n_true")) / F.col("n_true")).otherwise(0.0))))
    rows = rows.withColumn("embryo", F.split("dataset", "_")[0])
    g = rows.rollup("embryo", "dataset").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "d_tp", "d_fp", "d_fn")], F.sum(F.col("adj") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 0, "dataset").when(F.col("g") == 1, "embryo").otherwise("all")
    dj = F.col("d_tp") / F.when(F.col("d_tp") + F.col("d_fp") + F.col("d_fn") > 0, F.col("d_tp") + F.col("d_fp") + F.col("d_fn"))
    return g.select(
        level.alias("level"), F.coalesce("dataset", "embryo", F.lit("all")).alias("name"), "tp", "fp", "fn", F.round(F.col("tp") / F.col("w"), 6).alias("edge_jaccard"),
        F.round(F.col("s") / F.col("w"), 6).alias("adjusted_jaccard"), F.round(dj, 6).alias("division_jaccard"),
        F.round(F.col("s") / F.col("w") + 0.1 * F.coalesce(dj, F.lit(0.0)), 6).alias("score"),
    )


def _by_tau(scored: DataFrame) -> DataFrame:
    """Label counts of candidates between neighbouring thresholds, so that each row is read once."""
    steps = reduce(lambda a, b: a + b, [F.when(F.col("score") >= t, 1).otherwise(0) for t in TAUS])
    label = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(k)
    return scored.groupBy(steps.alias("step")).agg(F.count("*").alias("n"), label("tp"), label("fp"), label("ignored"))


def sweep_additions(scored: DataFrame) -> DataFrame:
    """For each threshold, what is added at or above it: (tau, added, added_tp, added_fp, added_ignored, precision_add)."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(t, k + 1) for k, t in enumerate(TAUS)], "tau double, k int")
    above = grid.join(F.broadcast(_by_tau(scored)), F.col("step") >= F.col("k"), "left").groupBy("tau").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tp", "fp", "ignored")])
    precision = F.col("tp") / F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fp"))
    return above.select("tau", F.col("n").alias("added"), F.col("tp").alias("added_tp"), F.col("fp").alias("added_fp"), F.col("ignored").alias("added_ignored"), F.round(precision, 6).alias("precision_add"))


def sweep_removals(scored: DataFrame) -> DataFrame:
    """For each threshold, what is removed below it: (tau, removed, removed_tp, removed_fp, kept_tp_frac)."""
    grid = scored.sparkSession.createDataFrame([(t, k + 1) for k, t in enumerate(TAUS)], "tau double, k int")
    parts = _by_tau(scored)
    below = grid.join(F.broadcast(parts), F.col("step") < F.col("k"), "left").groupBy("tau").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tp", "fp")])
    rows = below.crossJoin(F.broadcast(parts.agg(F.sum("tp").alias("all_tp"))))
    kept = F.when(F.col("all_tp") > 0, 1 - F.col("tp") / F.col("all_tp")).otherwise(1.0)
    return rows.select("tau", F.col("n").alias("removed"), F.col("tp").alias("removed_tp"), F.col("fp").alias("removed_fp"), F.round(kept, 6).alias("kept_tp_frac"))


def pick_thresholds(add: DataFrame, remove: DataFrame, least_precision=0.40, least_adds=3, least_kept=0.95) -> DataFrame:
    """(kind, tau): the lowest threshold for additions and the highest for removals that meet the gates; null if none does."""
    a = add.where((F.col("precision_add") >= least_precision) & (F.col("added_tp") + F.col("added_fp") >= least_adds)).agg(F.min("tau").alias("tau"))
    r = remove.where((F.col("kept_tp_frac") >= least_kept) & (F.col("removed") > 0)).agg(F.max("tau").alias("tau"))
    return a.select(F.lit("add").alias("kind"), "tau").unionByName(r.select(F.lit("del").alias("kind"), "tau"))


def division_sweeps(adds: DataFrame, safe: DataFrame) -> DataFrame:
    """(kind, embryo, tau, n, tp, fp, ignored, precision_add, kept_tp_frac): additions at or above each threshold, and removals below it.

    adds(embryo, score, label): the forks that the greedy choice at the least threshold adds; safe(embryo, score, label): the
    safe forks. Rows without score are never removed. The embryo is null for all embryos together.
    """
    score = F.coalesce("score", F.lit(float("nan")))  # NaN is above all thresholds
    step = reduce(lambda a, b: a + b, [F.when(score >= t, 1).otherwise(0) for t in TAUS])
    label = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(k)
    rows = adds.select(F.lit("add").alias("kind"), "embryo", "label", step.alias("step")).unionByName(safe.select(F.lit("del").alias("kind"), "embryo", "label", step.alias("step")))
    rows = rows.select("kind", "label", "step", F.explode(F.array("embryo", F.lit(None).cast("string"))).alias("embryo"))
    parts = rows.groupBy("kind", "embryo", "step").agg(F.count("*").alias("n"), label("tp"), label("fp"), label("ignored"))
    taus = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(k + 1).alias("k")) for k, t in enumerate(TAUS)])).alias("at")
    parts = parts.select("*", taus).withColumn("hit", F.when(F.col("kind") == "add", F.col("step") >= F.col("at.k")).otherwise(F.col("step") < F.col("at.k")))
    sums = [F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0)).alias(c) for c in ("n", "tp", "fp", "ignored")]
    table = parts.groupBy("kind", "embryo", F.col("at.tau").alias("tau")).agg(*sums, F.sum("tp").alias("all_tp"))
    scored = F.col("tp") + F.col("fp")
    precision = F.when(F.col("kind") == "add", F.col("tp") / F.when(scored > 0, scored))
    kept = F.when(F.col("kind") == "del", F.when(F.col("all_tp") > 0, 1 - F.col("tp") / F.when(F.col("all_tp") > 0, F.col("all_tp"))).otherwise(1.0))
    return table.withColumn("precision_add", precision).withColumn("kept_tp_frac", kept).drop("all_tp")


def division_thresholds(sweeps: DataFrame, embryos: DataFrame, least_precision=0.40, least_adds=3, least_kept=0.95) -> DataFrame:
    """(kind, fit_embryo, test_embryo, tau, n, tp, fp, ignored, precision_add, kept_tp_frac): thresholds, and what they do where they were not fitted.

    Both embryos are null for all; else thresholds are picked on one embryo and counted on each other one. tau is null where
    no threshold meets the gates, and then there are no counts.
    """
    add = (F.col("kind") == "add") & (F.col("precision_add") >= least_precision) & (F.col("tp") + F.col("fp") >= least_adds)
    remove = (F.col("kind") == "del") & (F.col("kept_tp_frac") >= least_kept) & (F.col("n") > 0)
    picks = sweeps.groupBy("kind", F.col("embryo").alias("fit_embryo")).agg(F.coalesce(F.min(F.when(add, F.col("tau"))), F.max(F.when(remove, F.col("tau")))).alias("tau"))
    kinds = F.explode(F.array(F.lit("add"), F.lit("del"))).alias("kind")
    every = embryos.select(F.col("embryo").alias("fit_embryo")).crossJoin(embryos.select(F.col("embryo").alias("test_embryo"))).where("fit_embryo <> test_embryo").select("*", kinds)
    none = F.lit(None).cast("string")
    whole = embryos.sparkSession.range(1).select(none.alias("fit_embryo"), none.alias("test_embryo"), kinds)
    rows = every.unionByName(whole).alias("e").join(picks.alias("p"), F.expr("e.kind = p.kind and e.fit_embryo <=> p.fit_embryo"), "left").select("e.*", "p.tau")
    found = rows.alias("e").join(sweeps.alias("s"), F.expr("e.kind = s.kind and e.test_embryo <=> s.embryo and e.tau = s.tau"), "left").select("e.*", "s.n", "s.tp", "s.fp", "s.ignored", "s.precision_add", "s.kept_tp_frac")
    # an embryo without additions, or without safe forks, has nothing to count at a threshold
    zero = {c: F.when(F.col("tau").isNotNull(), F.coalesce(c, F.lit(0))) for c in ("n", "tp", "fp", "ignored")}
    return found.withColumns(zero | {"kept_tp_frac": F.when(F.col("tau").isNotNull() & (F.col("kind") == "del"), F.coalesce("kept_tp_frac", F.lit(1.0)))})


#: Buckets of a score of one, for prefix sums over all scores.
SCORE_BUCKETS = 4096


def _ranked(scored: DataFrame) -> DataFrame:
    """(score, p, n, tp, fp): true and false ones at each score that occurs, and at or above it.

    Prefix sums in two levels, over buckets of scores and within them, so that the scores are never one task.
    """
    count = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0))
    steps = scored.where("label in ('tp', 'fp') and score is not null and not isnan(score)").groupBy("score").agg(count("tp").alias("p"), count("fp").alias("n"))
    bucket = F.floor(F.least(F.lit(1e3), F.greatest(F.lit(-1e3), F.col("score"))) * SCORE_BUCKETS)
    steps = steps.withColumn("bucket", bucket)
    above = W.orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    parts = steps.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))  # one row for each bucket in use
    parts = parts.select("bucket", *[F.coalesce(F.sum(f"b{c}").over(above), F.lit(0)).alias(f"over_{c}") for c in "pn"])
    here = W.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = steps.select("*", *[F.sum(c).over(here).alias(f"here_{c}") for c in "pn"])
    return inside.join(F.broadcast(parts), "bucket").select("score", "p", "n", (F.col("over_p") + F.col("here_p")).alias("tp"), (F.col("over_n") + F.col("here_n")).alias("fp"))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_fp"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, precision, recall) at each score that occurs; recall is null without true ones."""
    rows = _ranked(scored)
    recall = F.col("tp") / F.when(F.col("n_tp") > 0, F.col("n_tp"))
    rows = rows.crossJoin(F.broadcast(_totals(rows)))  # one row
    return rows.select("score", "tp", "fp", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(recall, 6).alias("recall"))


#: Recalls at which the best precision is reported.
RECALLS = (0.3, 0.5, 0.7, 0.9)


def ranking_quality(scored: DataFrame) -> DataFrame:
    """(n_tp, n_fp, roc_auc, average_precision, p_at_r30, ..): of all scores, exactly; null where there are no true or no false ones.

    p_at_r: the highest precision of a threshold that reaches the recall.
    """
    rows = _ranked(scored)
    total = _totals(rows)
    rows = rows.crossJoin(F.broadcast(total))  # one row
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    best = [F.round(F.max(F.when(F.col("tp") >= F.lit(r) * F.col("n_tp"), precision)), 6).alias(f"p_at_r{round(100 * r)}") for r in RECALLS]
    sums = rows.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("wins"), F.sum(F.col("p") * precision).alias("ap"), *best)
    out = total.crossJoin(sums)  # one row each
    both = (F.col("n_tp") > 0) & (F.col("n_fp") > 0)
    auc, ap = F.col("wins") / (F.col("n_tp") * F.col("n_fp")), F.col("ap") / F.col("n_tp")
    return out.select("n_tp", "n_fp", F.when(both, F.round(auc, 6)).alias("roc_auc"), F.when(both, F.round(ap, 6)).alias("average_precision"), *[F.when(both, F.col(f"p_at_r{round(100 * r)}")).alias(f"p_at_r{round(100 * r)}") for r in RECALLS])


def node_ratios(n_pred: DataFrame, n_true: DataFrame) -> DataFrame:
    """(dataset, n_pred, n_true, node_ratio): the relative surplus of nodes; null without an estimate, or where it is 0."""
    both = n_pred.withColumnRenamed("n", "n_pred").join(n_true.withColumnRenamed("n", "n_true"), "dataset", "left")
    return both.select("dataset", "n_pred", "n_true", ((F.col("n_pred") - F.col("n_true")) / F.when(F.col("n_true") != 0, F.col("n_true"))).alias("node_ratio"))


def report_summary(report: DataFrame, pred_names: DataFrame, true_names: DataFrame) -> DataFrame:
    """(score, worst_embryo, worst_score, n_datasets, n_skipped, skipped): the overall score, the embryo of the lowest one, and annotated names without prediction.

    report: as score_report gives it. Equal scores of embryos go to the lesser name.
    """
    worst = report.where("level = 'embryo'").agg(F.min(F.struct("score", "name")).alias("worst")).select("worst.*").withColumnsRenamed({"score": "worst_score", "name": "worst_embryo"})
    whole = report.agg(F.max(F.when(F.col("level") == "all", F.col("score"))).alias("score"), F.sum(F.when(F.col("level") == "dataset", 1).otherwise(0)).alias("n_datasets"))
    skipped = true_names.select("dataset").distinct().join(pred_names.select("dataset").distinct(), "dataset", "left_anti")
    skipped = skipped.agg(F.count("*").alias("n_skipped"), F.coalesce(F.array_join(F.sort_array(F.collect_list("dataset")), ","), F.lit("")).alias("skipped"))
    return whole.crossJoin(worst).crossJoin(skipped).select("score", "worst_embryo", "worst_score", "n_datasets", "n_skipped", "skipped")  # one row each


def sweep_gates(links: DataFrame, truth: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, tp, fp, fn, score) of the forest of the links that pass each gate; all gates in one pass, as a further key.

    links as lineage.links gives them; truth(source_id, target_id), each pair once. The score is the Jaccard index of links.
    """
    passed = F.explode(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in gates.items()]))).alias("gate")
    rows = links.select(passed, "source_id", "target_id", F.coalesce("edge_prob", F.lit(0.0)).alias("prob"), "um", "edge_id")
    best = rows.groupBy("gate", "target_id").agg(F.min(F.struct((-F.col("prob")).alias("a"), "um", "edge_id", "source_id")).alias("b")).select("gate", "target_id", "b.*")
    rank = F.row_number().over(W.partitionBy("gate", "source_id").orderBy("a", "um", "edge_id"))
    forest = best.withColumn("k", rank).where("k <= 2").select("gate", "source_id", "target_id")
    pairs = truth.select("source_id", "target_id", F.lit(True).alias("hit")).distinct()
    marked = forest.join(pairs, ["source_id", "target_id"], "left")
    for key in ("source_id", "target_id"):
        marked = marked.join(truth.select(key, F.lit(True).alias(f"near_{key}")).distinct(), key, "left")
    near = F.col("hit").isNull() & (F.col("near_source_id") | F.col("near_target_id"))
    sums = marked.groupBy("gate").agg(F.count("hit").alias("tp"), F.sum(F.when(near, 1).otherwise(0)).alias("fp"))
    names = links.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    rows = names.join(sums, "gate", "left").fillna(0, ["tp", "fp"]).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("all"))))  # one row
    rows = rows.withColumn("fn", F.col("all") - F.col("tp"))
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return rows.select("gate", "tp", "fp", "fn", F.round(F.col("tp") / F.when(total > 0, total), 6).alias("score"))


def sweep_with_combination(links: DataFrame, truth: DataFrame, gates: dict[str, Column], base: str, margin: float = 0.0005) -> DataFrame:
    """The sweep with each gate's gain over the base one, whether it is above the margin, and a row of all such gates combined."""
    rows = sweep_gates(links, truth, gates)
    scores = {r.gate: r.score for r in rows.select("gate", "score").collect()}  # one row for each gate
    picked = [g for g, v in scores.items() if g != base and v is not None and scores[base] is not None and v - scores[base] > margin]
    combined = sweep_gates(links, truth, {"combined": reduce(lambda a, b: a & b, [gates[g] for g in picked], gates[base])})
    gain = F.round(F.col("score") - F.lit(scores[base]), 6)
    return rows.unionByName(combined).select("*", gain.alias("gain"), F.col("gate").isin(picked).alias("picked"))
