"""Queries on scores, thresholds, learning and run statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, clean_probability
from stemline.operators import divisions as dv
from stemline.operators import edits as dedits
from stemline.operators import labelling, learning, matching, scoring, spatial
from stemline.operators import lineage as ln
from stemline.plans.divisions import division_peaks
from stemline.plans.lineage import BASE, MOVIE, N, TREE, det, edges, forest, fork_pools, forks, kept, links, movie_name, pre_forest
from stemline.sources.tables import table
from stemline.store import Scratch

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _graphs(spark, d):
    """Predicted: the forest of all links. True: the best links of the passes strict and division, between their nodes."""
    n, l = kept(spark, det(spark, d), links(spark, d))
    pred = ln.forest(l)
    truth = ln.best_per(ln.best_parent(l.where("motion_pass in ('strict', 'division')")), "source_id", 2)
    truth = truth.where("distance_um <= 5")
    pred, truth = kept(spark, pred.select("edge_id", "dataset", "source_id", "target_id"), truth.select("edge_id", "dataset", "source_id", "target_id"))
    return n, pred, truth, ln.prune_isolated(n, pred), ln.prune_isolated(n, truth)


def _by_id(pred_nodes, true_nodes):
    return pred_nodes.select(F.col("node_id").alias("pred_id")).join(true_nodes.select(F.col("node_id").alias("true_id"), F.col("node_id").alias("pred_id")), "pred_id")


GR = """tr as (select * from (select * from (select * from l where motion_pass in ('strict', 'division') qualify row_number() over (partition by target_id order by coalesce(edge_prob, 0) desc, um, edge_id) = 1)
  qualify row_number() over (partition by source_id order by coalesce(edge_prob, 0) desc, um, edge_id) <= 2) where distance_um <= 5),
pn as (select * from n where node_id in (select source_id from fo union select target_id from fo)), tn as (select * from n where node_id in (select source_id from tr union select target_id from tr)),
mt as (select node_id from pn where node_id in (select node_id from tn)),
co as (select dataset, source_id, target_id, case when (source_id, target_id) in (select (source_id, target_id) from tr) then 'tp'
  when target_id in (select target_id from tr) or source_id in (select source_id from tr) then 'fp' end outcome from fo
 union all select dataset, source_id, target_id, 'fn' from tr where (source_id, target_id) not in (select (source_id, target_id) from fo)),
cf as (select * from co where outcome is not null),
df as (select dataset, source_id, count(*) k from tr group by all), dp as (select source_id from fo group by 1 having count(*) >= 2),
dc as (select * from (select dataset, case when k >= 2 and source_id in (from dp) then 'tp' when k >= 2 then 'fn' when source_id in (from dp) then 'fp' end outcome from df) where outcome is not null)"""


@query
def edge_confusion(spark, d):
    """True positives, false positives next to annotation, and misses, with nodes matched by id."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    return scoring.edge_confusion(pred, truth, _by_id(pn, tn))


SQL["edge_confusion"] = BASE + f", {GR} select dataset, source_id, target_id, outcome from cf"


@query
def error_decomposition(spark, d):
    _, pred, truth, pn, tn = _graphs(spark, d)
    return scoring.error_decomposition(pn, pred, tn, truth, _by_id(pn, tn))


SQL["error_decomposition"] = BASE + f""", {GR} select dataset, kind, count(*) n from (
 select dataset, 'missed_node' kind from tn where node_id not in (from mt) union all select dataset, 'spurious_node' from pn where node_id not in (from mt)
 union all select dataset, case when source_id in (from mt) and target_id in (from mt) then 'fragmented_edge' else 'lost_to_detection' end from cf where outcome = 'fn'
 union all select dataset, case when outcome = 'tp' then 'recovered_edge' else 'wrong_association' end from cf where outcome <> 'fn') group by all"""


def _expected(spark, d):
    """Nodes that each dataset should have, by its score rows."""
    return table(spark, d, "per_dataset").select(movie_name(F.col("dataset")).alias("dataset"), "n_nodes").where("dataset is not null").groupBy("dataset").agg(F.max("n_nodes").alias("n"))


@query
def score_report(spark, d):
    """Edge, division and overall scores of each dataset, each embryo and all."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    match = _by_id(pn, tn)
    return scoring.score_report(scoring.edge_confusion(pred, truth, match), scoring.division_confusion(pred, truth, match), pn.groupBy("dataset").agg(F.count("*").alias("n")), _expected(spark, d))


SQL["score_report"] = BASE + f""", {GR}, ex as (select {MOVIE} dataset, max(n_nodes) n_true from per_dataset where dataset is not null group by 1), np as (select dataset, count(*) n_pred from pn group by 1),
ee as (select dataset, count(*) filter (outcome = 'tp') tp, count(*) filter (outcome = 'fp') fp, count(*) filter (outcome = 'fn') fn from cf group by 1),
dd as (select dataset, count(*) filter (outcome = 'tp') d_tp, count(*) filter (outcome = 'fp') d_fp, count(*) filter (outcome = 'fn') d_fn from dc group by 1),
rw as (select ee.*, coalesce(d_tp, 0) d_tp, coalesce(d_fp, 0) d_fp, coalesce(d_fn, 0) d_fn, tp + fp + fn w, split_part(dataset, '_', 1) embryo,
 greatest(0.0, tp / (tp + fp + fn) * (1 - 0.1 * case when coalesce(n_true, 0) > 0 then (coalesce(n_pred, 0) - n_true) / n_true else 0.0 end)) adj from ee left join dd using (dataset) left join np using (dataset) left join ex using (dataset)),
g as (select embryo, dataset, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(d_tp)::bigint d_tp, sum(d_fp)::bigint d_fp, sum(d_fn)::bigint d_fn, sum(adj * w) s, sum(w)::double w, grouping(embryo, dataset) gr from rw group by rollup (embryo, dataset))
select case gr when 0 then 'dataset' when 1 then 'embryo' else 'all' end as level, coalesce(dataset, embryo, 'all') as name, tp, fp, fn, round(tp / w, 6) edge_jaccard, round(s / w, 6) adjusted_jaccard,
 round(case when d_tp + d_fp + d_fn > 0 then d_tp / (d_tp + d_fp + d_fn) end, 6) division_jaccard, round(s / w + 0.1 * coalesce(case when d_tp + d_fp + d_fn > 0 then d_tp / (d_tp + d_fp + d_fn) end, 0), 6) score from g"""


@query
def node_ratios(spark, d):
    _, _, _, pn, _ = _graphs(spark, d)
    rows = scoring.node_ratios(pn.groupBy("dataset").agg(F.count("*").alias("n")), _expected(spark, d))
    return rows.withColumn("node_ratio", F.round("node_ratio", 6))


SQL["node_ratios"] = BASE + f""", {GR}, ex as (select {MOVIE} dataset, max(n_nodes) n_true from per_dataset where dataset is not null group by 1)
select dataset, n_pred, n_true, round((n_pred - n_true) / nullif(n_true, 0), 6) node_ratio from (select dataset, count(*) n_pred from pn group by 1) left join ex using (dataset)"""


@query
def report_summary(spark, d):
    """The overall score, the worst embryo, and annotated datasets without prediction."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    match = _by_id(pn, tn)
    report = scoring.score_report(scoring.edge_confusion(pred, truth, match), scoring.division_confusion(pred, truth, match), pn.groupBy("dataset").agg(F.count("*").alias("n")), _expected(spark, d))
    return scoring.report_summary(*kept(spark, report), pn, _expected(spark, d))


SQL["report_summary"] = f"""select (select score from rep where level = 'all') score, arg_min(name, (score, name)) worst_embryo, min(score) worst_score, (select count(*) from rep where level = 'dataset') n_datasets,
 (select count(*) from sk) n_skipped, (select coalesce(string_agg(dataset, ',' order by dataset), '') from sk) skipped from rep where level = 'embryo'"""
SQL["report_summary"] = SQL["score_report"].replace("select case gr when", "rep as (select case gr when", 1).replace("score from g", "score from g), sk as (select dataset from ex where dataset not in (select dataset from pn))\n" + SQL["report_summary"], 1)
SQL["report_summary"] = SQL["report_summary"].replace("group by rollup (embryo, dataset))\nrep", "group by rollup (embryo, dataset)),\nrep")


@query
def written_match(spark, d):
    """Nodes as written (whole voxels) matched to true ones one to one within 7 micrometres in their frames, at least total distance."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    rounded = pn.select("dataset", "t", "node_id", *[F.bround(c).cast("double").alias(c) for c in AXES])
    return matching.assignment(spatial.radius_pairs(rounded, tn, 7.0, 0)).select(F.col("a_id").alias("pred_id"), F.col("b_id").alias("true_id"), F.round("um", 6).alias("um"))


@query
def written_score(spark, d):
    """The score report with nodes matched by place after rounding."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    rounded = pn.select("dataset", "t", "node_id", *[F.bround(c).cast("double").alias(c) for c in AXES])
    (match,) = kept(spark, matching.assignment(spatial.radius_pairs(rounded, tn, 7.0, 0)).select(F.col("a_id").alias("pred_id"), F.col("b_id").alias("true_id")))
    return scoring.score_report(scoring.edge_confusion(pred, truth, match), scoring.division_confusion(pred, truth, match), pn.groupBy("dataset").agg(F.count("*").alias("n")), _expected(spark, d))


@query
def division_proxy(spark, d):
    """Divisions found, missed and wrong, by the components of the predicted graph."""
    _, pred, truth, pn, tn = _graphs(spark, d)
    return labelling.division_proxy(pred, truth, _by_id(pn, tn), Scratch(spark, "proxy"))


SQL["division_proxy"] = BASE + f""", {GR}, {TREE}, fk as (select source_id p from fo group by 1 having count(*) >= 2), fc as (select distinct component from tree where node_id in (from fk)),
pl as (select node_id, component from tree where node_id in (from mt) and component in (from fc)),
dv as (select dataset, source_id g, min(target_id) c0, max(target_id) c1 from tr group by all having count(*) >= 2),
ds as (with recursive r(c, node) as (select c0, c0 from dv union select c1, c1 from dv union select c, target_id from r join tr on source_id = node) select * from r),
hc as (select distinct c, component from ds join pl on pl.node_id = ds.node), an as (select g, g a from dv union select g, source_id from dv join tr on target_id = g),
ok as (select distinct g from an join pl on node_id = a join dv using (g) where (c0, component) in (select (c, component) from hc) and (c1, component) in (select (c, component) from hc))
select dataset, g true_id, case when g in (from ok) then 'tp' else 'fn' end outcome from dv
union all select distinct dataset, source_id, 'fp' from tr where source_id in (from fk) and source_id in (from mt) and source_id not in (from ok)"""


@query
def labelled_forks(spark, d):
    """What each fork candidate of detections would score if it were added to the forest."""
    n, pred, truth, pn, tn = _graphs(spark, d)
    rows = forks(spark, d).where("shape = 'a'").select("fork_id", "p_id", "d1_id", "d2_id")
    for c in ("p_id", "d1_id", "d2_id"):
        rows = rows.join(n.select(F.col("node_id").alias(c)), c, "left_semi")
    return labelling.label_forks(rows, pred, truth, _by_id(pn, tn), Scratch(spark, "labels"), n, n)


def _evidence_sql(p, c):
    """Tables named with a prefix on the forks of a table c(f, p, x0, x1): near and fitting divisions, and forks across trees."""
    return f"""{p}n as (select distinct f, g from (select f, p q from {c} union select f, source_id from {c} join fo on target_id = p) join hd on q = u where q in (from mt)),
{p}l as (select f, 0 side, x0 v, true own from {c} union all select f, 1, x1, true from {c} union all select f, 0, target_id, false from {c} join fo on source_id = x0 union all select f, 1, target_id, false from {c} join fo on source_id = x1),
{p}s as (select * from {p}l where v in (from mt)), {p}h as (select distinct f, g, side, k from {p}s join kd using (v)),
{p}v as (select f, g from {p}n where exists (select 1 from {p}h a, {p}h b where a.f = {p}n.f and b.f = a.f and a.g = {p}n.g and b.g = a.g and a.side = 0 and b.side = 1 and a.k <> b.k)),
{p}b as (select f, side, coalesce(max(component) filter (own), case when count(distinct component) filter (not own) = 1 then max(component) filter (not own) end) c from {p}s join tt on node_id = v group by all),
{p}x as (select f from {p}b group by 1 having count(distinct c) >= 2)"""


SQL["labelled_forks"] = BASE + f""", {GR}, tt as (with recursive r(node_id, component) as (select distinct source_id, source_id from tr where source_id not in (select target_id from tr) union all select target_id, component from r join tr on source_id = node_id) select * from r),
dv as (select source_id g, min(target_id) c0, max(target_id) c1 from tr group by 1 having count(*) >= 2), hd as (select g u, g from dv union select source_id, g from dv join tr on target_id = g),
ki as (select c0 v, g, 0 k from dv union all select c1, g, 1 from dv), kd as (select * from ki union select target_id, g, k from ki join tr on source_id = v),
fr as (select distinct fork_id f, p_id p, d1_id x0, d2_id x1 from forks where shape = 'a' and p_id in (select node_id from n) and d1_id in (select node_id from n) and d2_id in (select node_id from n)),
od as (select source_id f, source_id p, min(target_id) x0, max(target_id) x1 from fo group by 1 having count(*) >= 2),
{_evidence_sql("o_", "od")}, {_evidence_sql("c_", "fr")}, hl as (select g, f from o_v where f not in (from o_x)),
mf as (select f from fr join fo on target_id in (x0, x1) where source_id <> p union select f from fr where x0 = x1),
ft as (select f, min(g) fits from c_v join fr using (f) where not exists (select 1 from hl where hl.g = c_v.g and hl.f <> p) group by 1), nr as (select f, min(g) near from c_n group by 1),
j as (select fr.f, f in (from mf) bad, f in (from c_x) crosses, fits, near, p in (from mt) and p in (select source_id from tr) goes from fr left join ft using (f) left join nr using (f)),
z as (select *, case when bad then 'malformed' when fits is not null and not crosses then '' when crosses then 'cross_gt_tracks' when near is not null then 'near_gt_division' when goes then 'annotated_continuing' else '' end fp_reason from j),
y as (select z.*, p, case when fp_reason = 'near_gt_division' then near when fp_reason = '' and fits is not null and not crosses then fits end g from z join fr using (f))
select f fork_id, case when fp_reason <> '' then 'fp' when fits is not null and not crosses then 'tp' else 'ignored' end as label, fp_reason, coalesce(g, -1) gt_divider_id, a.t - b.t timing_vs_gt,
 case when p in (from mt) then p else -1 end gt_p_id, case when p in (from mt) then coalesce(k, 0) else -1 end::int gt_p_outdeg
 from y left join n a on a.node_id = p left join n b on b.node_id = g left join (select source_id, count(distinct target_id) k from tr group by 1) on source_id = p"""


# ---- thresholds ----------------------------------------------------------------------------------------------------


def _scored(spark, d):
    return forks(spark, d).where("shape = 'a' and score is not null and not isnan(score)").select("fork_id", "score", "label")


SC = "sc as (select distinct fork_id, dataset, p_id, d1_id, d2_id, shape, angle_deg, mirror_um, score, label from forks where shape = 'a' and score is not null and not isnan(score))"
GRID = "gr as (select unnest([" + ", ".join(map(str, scoring.TAUS)) + "]::double[]) tau)"


@query
def threshold_sweep_add(spark, d):
    return scoring.sweep_additions(_scored(spark, d))


ADD = """ad as (select tau, count(fork_id) added, count(*) filter (label = 'tp') added_tp, count(*) filter (label = 'fp') added_fp, count(*) filter (label = 'ignored') added_ignored from gr left join sc on score >= tau group by 1)"""
SQL["threshold_sweep_add"] = f"with {SC}, {GRID}, {ADD} select *, round(case when added_tp + added_fp > 0 then added_tp / (added_tp + added_fp) end, 6) precision_add from ad"


@query
def threshold_sweep_del(spark, d):
    return scoring.sweep_removals(_scored(spark, d))


DEL = """de as (select tau, count(fork_id) removed, count(*) filter (label = 'tp') removed_tp, count(*) filter (label = 'fp') removed_fp from gr left join sc on score < tau group by 1)"""
SQL["threshold_sweep_del"] = f"with {SC}, {GRID}, {DEL} select *, round(coalesce(1 - removed_tp / nullif((select count(*) from sc where label = 'tp'), 0), 1.0), 6) kept_tp_frac from de"


@query
def picked_thresholds(spark, d):
    s = _scored(spark, d)
    return scoring.pick_thresholds(scoring.sweep_additions(s), scoring.sweep_removals(s))


SQL["picked_thresholds"] = f"""with {SC}, {GRID}, {ADD}, {DEL} select 'add' kind, min(tau) tau from ad where added_tp + added_fp >= 3 and round(added_tp / (added_tp + added_fp), 6) >= 0.4
union all select 'del', max(tau) from de where removed > 0 and round(1 - removed_tp / (select count(*) from sc where label = 'tp'), 6) >= 0.95"""


def _division_sweeps(spark, d):
    """Sweeps over what the greedy choice adds beside the safe divisions, and over these; and the embryos of both."""
    cands, safe = fork_pools(spark, d)
    taken = dv.choose_forks(cands, min(scoring.TAUS), safe=safe).select("p_id", "d2_id")
    best = cands.where(F.col("score") >= min(scoring.TAUS)).groupBy("p_id", "d2_id").agg(F.min(F.struct("mirror_um", "fork_id", "score", "label", "dataset")).alias("r"))
    adds = best.join(taken, ["p_id", "d2_id"], "left_semi").select("r.*")
    embryo = lambda rows: rows.where("dataset is not null").select(F.split("dataset", "_")[0].alias("embryo"), "score", "label")
    every = embryo(cands).unionByName(embryo(safe)).select("embryo").distinct()
    return kept(spark, scoring.division_sweeps(embryo(adds), embryo(safe)), every)


@query
def division_sweeps(spark, d):
    """The sweeps of all embryos together, and of each."""
    return _division_sweeps(spark, d)[0]


@query
def division_thresholds(spark, d):
    """Thresholds for additions and removals, and each embryo's counted on the others."""
    return scoring.division_thresholds(*_division_sweeps(spark, d))


@query
def pr_curve(spark, d):
    return scoring.pr_curve(_scored(spark, d))


PR = "st as (select score, count(*) filter (label = 'tp') p, count(*) filter (label = 'fp') n from sc where label in ('tp', 'fp') group by 1), cu as (select *, sum(p) over (order by score desc)::bigint tp, sum(n) over (order by score desc)::bigint fp, sum(p) over ()::bigint pos from st)"
SQL["pr_curve"] = f"with {SC}, {PR} select score, tp, fp, round(tp / (tp + fp), 6) as \"precision\", round(tp / nullif(pos, 0), 6) as recall from cu"


@query
def ranking_quality(spark, d):
    return scoring.ranking_quality(_scored(spark, d))


SQL["ranking_quality"] = f"""with {SC}, a as (select label, score r from sc where label in ('tp', 'fp')), {PR}
select (select count(*) from a where label = 'tp') n_tp, (select count(*) from a where label = 'fp') n_fp,
 round((select sum(case when p.r > n.r then 1.0::double when p.r = n.r then 0.5::double else 0 end) from a p, a n where p.label = 'tp' and n.label = 'fp') / ((select count(*) from a where label = 'tp') * (select count(*) from a where label = 'fp')), 6) roc_auc,
 round((select sum(p * (tp / (tp + fp))) from cu) / (select count(*) from a where label = 'tp'), 6) average_precision,
 """ + ", ".join(f"(select round(max(tp / (tp + fp)), 6) from cu where tp >= {r}::double * pos) p_at_r{round(100 * r)}" for r in scoring.RECALLS)


#: Gates of links that are tried: a name, and a condition that both engines read.
GATES = {"base": "true", "um_8": "um <= 8", "um_11": "um <= 11", "prob_0.3": "coalesce(edge_prob, 0) >= 0.3", "prob_0.6": "coalesce(edge_prob, 0) >= 0.6", "not_relaxed": "coalesce(motion_pass, '') <> 'relaxed'", "not_closed": "coalesce(gap_closed, 0) = 0"}


@query
def parameter_sweep(spark, d):
    """What each gate of links does to the score, and all that help together."""
    (l,) = kept(spark, links(spark, d))
    _, _, truth, _, _ = _graphs(spark, d)
    return scoring.sweep_with_combination(l, truth, {k: F.coalesce(F.expr(v), F.lit(False)) for k, v in GATES.items()}, "base")


def _gate_sql(name: str, source: str, ok: str) -> str:
    return f"""select '{name}' gate, source_id, target_id from (select * from {source} where {ok} qualify row_number() over (partition by target_id order by coalesce(edge_prob, 0) desc, um, edge_id) = 1)
 qualify row_number() over (partition by source_id order by coalesce(edge_prob, 0) desc, um, edge_id) <= 2"""


def _gate_scores(name: str, source: str) -> str:
    return f"""{name} as (select gate, tp, fp, fn, round(tp / nullif(tp + fp + fn, 0), 6) score from (select gate, count(*) filter (hit) tp, count(*) filter (not hit and near) fp, (select count(*) from tr) - count(*) filter (hit) fn
 from (select gate, (source_id, target_id) in (select (source_id, target_id) from tr) hit, source_id in (select source_id from tr) or target_id in (select target_id from tr) near from {source}) group by 1))"""


_WHOLE = " and ".join(f"((select score from s1 where gate = '{k}') - (select score from s1 where gate = 'base') <= 0.0005 or coalesce({v}, false))" for k, v in GATES.items() if k != "base")
SQL["parameter_sweep"] = BASE + f""", {GR}, gf as ({" union all ".join(_gate_sql(k, "l", f"coalesce({v}, false)") for k, v in GATES.items())}), {_gate_scores("s1", "gf")},
lc as (select * from l where {_WHOLE}), cb as ({_gate_sql("combined", "lc", "true")}), {_gate_scores("s2", "cb")}
select *, round(score - (select score from s1 where gate = 'base'), 6) gain, gate not in ('base', 'combined') and score - (select score from s1 where gate = 'base') > 0.0005 picked from (from s1 union all from s2)"""


# ---- learning ------------------------------------------------------------------------------------------------------


#: Features of a fork candidate that come without images.
FEATURES = ["p_d1_um", "p_d2_um", "sister_um", "len_ratio", "angle_deg", "mirror_um", "mirror_rank", "t2_sister_um", "t2_gain_um", "p_back_len", "d1_fwd_len", "d2_fwd_len", "prob_p_d1", "prob_p_d2",
            "prob_p_d1_observed", "prob_p_d2_observed", "low_score_d2", "d2_is_readmitted", "nearby_10um", "broken_track_d2_um"]


def _featured(spark, d):
    """Fork candidates of both shapes with all features, their movie's fold, and for shape a what they would score."""
    n, _, truth, _, tn = _graphs(spark, d)
    (before,) = kept(spark, pre_forest(spark, d))
    tracked, peaks = kept(spark, *division_peaks(spark, d, n, before))
    probs = ln.deliveries(edges(spark, d)).where("edge_prob is not null").select("source_id", "target_id", clean_probability(F.col("edge_prob")).alias("prob"))
    cands = dedits.with_surroundings(dedits.with_probabilities(dedits.enumerate_forks(tracked, before, None, peaks), probs), tracked, before)
    again = n.where("readmitted = 1").select(F.col("node_id").alias("d2_id"), F.lit(1.0).alias("d2_is_readmitted")).distinct()
    cands = cands.join(again, "d2_id", "left").fillna(0.0, ["d2_is_readmitted"]).withColumn("t2_sister_um", F.col("t2_gain_um") + F.col("sister_um"))
    cands = cands.join(learning.folds(n).select("dataset", "embryo", "fold"), "dataset").withColumn("fork_id", F.xxhash64("p_id", "d2_id"))
    (cands,) = kept(spark, cands.select("fork_id", "dataset", "embryo", "fold", "shape", "p_id", "d1_id", "d2_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]))
    match = _by_id(tracked, tn)
    labels = labelling.label_forks(cands.where("shape = 'a'").select("fork_id", "p_id", "d1_id", "d2_id"), before.select("edge_id", "dataset", "source_id", "target_id"), truth, match, Scratch(spark, "labels"), n, n)
    label = F.when(F.col("label") == "tp", 1).when(F.col("label") == "fp", 0)
    return kept(spark, cands.join(labels.select("fork_id", label.alias("is_tp")), "fork_id", "left"))[0]


@query
def fork_classifier(spark, d):
    """The probability of each fork candidate by a classifier of 20 features, fitted to other movies than its own."""
    rows = learning.out_of_fold(_featured(spark, d), FEATURES)
    return rows.select("dataset", "p_id", "d2_id", "is_tp", F.round("prob", 6).alias("prob"))


@query
def classifier_report(spark, d):
    """How the classifier ranks candidates of embryos that it was not fitted to, each half of them held out in turn."""
    rows = _featured(spark, d).withColumn("half", F.pmod(F.xxhash64("embryo"), F.lit(2)))
    rows = learning.out_of_fold(rows, FEATURES, fold="half", k=2)
    return scoring.ranking_quality(rows.select(F.when(F.col("is_tp") == 1, "tp").when(F.col("is_tp") == 0, "fp").alias("label"), F.col("prob").alias("score")))


@query
def fitted_choice(spark, d):
    """The probability of each delivered fork among those of its daughter, by a conditional logit that is fitted to their labels."""
    (rows,) = kept(spark, forks(spark, d).where("d2_id is not null and dataset is not null"))
    features = ["angle_deg", "mirror_um", "score"]
    train = rows.where("label in ('tp', 'fp')").withColumn("chosen", (F.col("label") == "tp").cast("int"))
    model = learning.fit_choice(train, features)
    return dv.conditional_logit(rows, learning.utility(model)).select("fork_id", F.round("prob", 6).alias("prob"))


@query
def movie_folds(spark, d):
    return learning.folds(det(spark, d))


SQL["movie_folds"] = f"with {N} select dataset, split_part(dataset, '_', 1) embryo, ((row_number() over (partition by split_part(dataset, '_', 1) order by md5(dataset), dataset) - 1) % 5)::int fold from (select distinct dataset from n)"


@query
def training_events(spark, d):
    n, l = kept(spark, det(spark, d), forest(spark, d))
    return learning.training_events(l, n)


SQL["training_events"] = BASE + """, o as (select source_id, count(*) k from fo group by 1), dv as (select source_id from o where k = 2),
po as (select source_id id from dv union select source_id from fo where target_id in (from dv) union select target_id from fo where source_id in (from dv))
select dataset, t, node_id, 1 as label from n where node_id in (from po) union all
select dataset, t, node_id, 0 from (select * from n where node_id in (select source_id from o where k = 1) and node_id in (select target_id from fo) and node_id not in (from po)
 qualify row_number() over (partition by dataset order by md5(node_id::varchar), node_id) <= 30)"""


@query
def validation_movies(spark, d):
    """Four movies of each embryo for validation, those with divisions first."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    has = l.groupBy("dataset", "source_id").agg(F.count("*").alias("n")).where("n = 2").select("dataset", F.lit(1).alias("divides")).distinct()
    rows = n.select("dataset").distinct().join(has, "dataset", "left").fillna(0, ["divides"]).withColumn("embryo", F.split("dataset", "_")[0])
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("embryo").orderBy(F.col("divides").desc(), "dataset"))).where("rank <= 4").select("dataset", "embryo", "divides")


SQL["validation_movies"] = BASE + """, h as (select distinct dataset from (select dataset, source_id from fo group by all having count(*) = 2)),
m as (select distinct dataset, split_part(dataset, '_', 1) embryo, case when dataset in (from h) then 1 else 0 end divides from n)
select * from m qualify row_number() over (partition by embryo order by divides desc, dataset) <= 4"""


def _head_rows(spark, d):
    """Feature vectors with a target offset: from the vector to the mean of its label, along the first three axes, in twentieths, and a fold."""
    rows = table(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", "embedding", (F.pmod(F.xxhash64("vec_id"), F.lit(5))).cast("int").alias("fold"))
    part = lambda k: F.element_at("embedding", k + 1).cast("double")
    means = rows.groupBy("label").agg(*[F.avg(part(k)).alias(f"m{c}") for k, c in enumerate(AXES)])  # one row for each label
    return rows.join(means, "label").select("vec_id", "fold", "embedding", *[((F.col(f"m{c}") - part(k)) * 20).alias(f"t{c}") for k, c in enumerate(AXES)])


def _fitted_head(sample):
    x, y = np.stack(sample.embedding.to_numpy()).astype(float), sample[[f"t{c}" for c in AXES]].to_numpy()
    start = learning.start_head(x.shape[1])
    return start, learning.fit_head(x, y, start, keep=0.03, rate=3e-3)


@query
def bounded_offsets(spark, d):
    """A bounded correction from each feature vector, by a head that is fitted to the other folds."""
    (rows,) = kept(spark, _head_rows(spark, d))
    out = None
    for f in range(5):
        _, head = _fitted_head(learning.labelled_sample(rows.where(F.col("fold") != f), ["embedding", *[f"t{c}" for c in AXES]], "vec_id"))
        part = learning.bounded_offset(rows.where(F.col("fold") == f), "embedding", *head).select("vec_id", "fold", *[F.round(f"d{c}", 5).alias(f"d{c}") for c in AXES])
        out = part if out is None else out.unionByName(part)
    return out


@query
def head_evaluation(spark, d):
    """The mean error of fitted offsets on vectors of other folds, relative to the head before fitting (below 0: better)."""
    (rows,) = kept(spark, _head_rows(spark, d))
    start = learning.start_head(len(rows.select("embedding").first()[0])) if rows.limit(1).count() else learning.start_head(1)
    (fitted,) = kept(spark, bounded_offsets(spark, d))
    before = learning.bounded_offset(rows, "embedding", *start).withColumnsRenamed({f"d{c}": f"s{c}" for c in AXES})
    both = before.join(fitted.drop("fold"), "vec_id")
    error = lambda p: F.sqrt(sum(((F.col(f"{p}{c}") - F.col(f"t{c}")) * (F.col(f"{p}{c}") - F.col(f"t{c}")) for c in AXES), F.lit(0.0)))
    g = both.groupBy("fold").agg(F.count("*").alias("n"), F.avg(error("d")).alias("fitted"), F.avg(error("s")).alias("start"))
    return g.select("fold", "n", F.round("fitted", 6).alias("error_um"), F.round(F.col("fitted") / F.col("start") - 1, 6).alias("relative"))


# ---- run statistics ------------------------------------------------------------------------------------------------


#: Counters of detections, of links, and of links of the forest: a name, and what counts (all rows where empty).
OF_NODES = {"nodes": "", "synthetic_nodes": "gap_synthetic = 1", "readmitted_nodes": "readmitted = 1"}
OF_LINKS = {"links": "", "gap_closed_links": "gap_closed = 1", "safe_division_links": "safe_division = 1", "strict_links": "motion_pass = 'strict'", "relaxed_links": "motion_pass = 'relaxed'",
            "division_links": "motion_pass = 'division'", "links_without_pass": "motion_pass is null", "links_without_prob": "edge_prob is null", "long_links": "um > 10"}
OF_FOREST = {"forest_links": "", "forest_gap_closed_links": "gap_closed = 1", "forest_safe_division_links": "safe_division = 1", "forest_long_links": "um > 10"}


def _stats(spark, d):
    n, l = kept(spark, det(spark, d), links(spark, d))
    (best, fo) = kept(spark, ln.best_parent(l), ln.forest(l))

    def counts(rows, names):  # one pass for all counters of a table
        hit = {k: F.count_if(F.coalesce(F.expr(v), F.lit(False))) if v else F.count("*") for k, v in names.items()}
        return rows.groupBy("dataset").agg(*[c.alias(k) for k, c in hit.items()]).unpivot("dataset", list(names), "metric", "value").where("value > 0")

    role = ln.ends_of_tracks(n, fo).groupBy("dataset", F.concat("kind", F.lit("_nodes")).alias("metric")).agg(F.count("*").alias("value"))
    forked = fo.groupBy("dataset", "source_id").agg(F.count("*").alias("n")).where("n = 2")
    parts = [counts(n, OF_NODES), counts(l, OF_LINKS), counts(best, {"single_parent_links": ""}), counts(fo, OF_FOREST), role, counts(forked, {"divisions": ""})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts_sql(names: dict[str, str], source: str) -> str:
    return " union all ".join(f"select dataset, '{k}' metric, count(*) as value from {source} {'where ' + v if v else ''} group by 1" for k, v in names.items())


STATS = f"""ss as ({_counts_sql(OF_NODES, "n")} union all {_counts_sql(OF_LINKS, "l")} union all {_counts_sql({"single_parent_links": ""}, "bp")} union all {_counts_sql(OF_FOREST, "fo")}
 union all select dataset, case when not s and not g then 'isolated_nodes' when not g then 'start_nodes' else 'end_nodes' end, count(*) from (select dataset, node_id in (select source_id from fo) s, node_id in (select target_id from fo) g from n) where not s or not g group by all
 union all select dataset, 'divisions', count(*) from (select dataset, source_id from fo group by all having count(*) = 2) group by 1)"""
METRICS = [*OF_NODES, *OF_LINKS, "single_parent_links", *OF_FOREST, "start_nodes", "end_nodes", "isolated_nodes", "divisions"]


@query
def run_stats_long(spark, d):
    return _stats(spark, d)


SQL["run_stats_long"] = BASE + f", {STATS} select * from ss"


@query
def run_stats_pivot(spark, d):
    return _stats(spark, d).groupBy("dataset").pivot("metric", METRICS).agg(F.sum("value")).fillna(0, METRICS)


SQL["run_stats_pivot"] = BASE + f", {STATS} select dataset, " + ", ".join(f"coalesce(sum(value) filter (metric = '{m}'), 0)::bigint {m}" for m in METRICS) + " from ss group by 1"


@query
def retention_guard(spark, d):
    """Least and median share of links that the forest keeps, by embryo and in all."""
    wide = run_stats_pivot(spark, d).where("links > 0").withColumn("embryo", F.split("dataset", "_")[0]).withColumn("kept", F.col("forest_links") / F.col("links"))
    g = wide.cube("embryo").agg(F.count("*").alias("n_movies"), F.round(F.min("kept"), 6).alias("least"), F.round(F.median("kept"), 6).alias("median"), F.sum(F.when(F.col("kept") < 0.9, 1).otherwise(0)).alias("n_low"))
    return g.select(F.coalesce("embryo", F.lit("all")).alias("embryo"), "n_movies", "least", "median", "n_low")


SQL["retention_guard"] = BASE + f""", {STATS}, w as (select dataset, split_part(dataset, '_', 1) embryo, sum(value) filter (metric = 'forest_links') / sum(value) filter (metric = 'links') kept from ss group by 1 having sum(value) filter (metric = 'links') > 0)
select coalesce(embryo, 'all') embryo, count(*) n_movies, round(min(kept), 6) least, round(median(kept), 6) as median, count(*) filter (kept < 0.9) n_low from w group by cube (embryo)"""
