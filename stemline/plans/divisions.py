"""Queries of divisions as edits: enumeration with peaks, budgets, choices, the hook, replay, filters and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, clean_probability
from stemline.operators import divisions as dv
from stemline.operators import edits, learning
from stemline.operators import lineage as ln
from stemline.plans.lineage import BASE, CA, PRE, SD, _um, det, edges, forks, kept, links, pre_forest

QUERIES = {}
SQL: dict[str, str] = {}
#: The gain that rule-based divisions need in these tables.
GAIN = 0.25


def query(f):
    QUERIES[f.__name__] = f
    return f


def division_peaks(spark, d, n: DataFrame, l: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections of the forest, and the others as peaks, scored by the best probability of a link that names them."""
    tracked = ln.prune_isolated(n, l)
    best = ln.deliveries(edges(spark, d)).where("edge_prob is not null").select(F.explode(F.array("source_id", "target_id")).alias("node_id"), clean_probability(F.col("edge_prob")).alias("p"))
    best = best.where("node_id >= 0").groupBy("node_id").agg(F.max("p").alias("score"))
    return tracked, edits.low_peaks(n.join(tracked.select("node_id"), "node_id", "left_anti").join(best, "node_id"))


def _base(spark, d):
    n, l = kept(spark, det(spark, d), pre_forest(spark, d))
    tracked, peaks = kept(spark, *division_peaks(spark, d, n, l))
    (safe,) = kept(spark, edits.capped_safe_divisions(tracked, l, least_gain=GAIN))
    return tracked, l, peaks, safe


PK = """tk as (select * from n where node_id in (select source_id from fo union select target_id from fo)),
pb as (select node_id, max(p) score from (select unnest([source_id, target_id]) node_id, case when isnan(edge_prob) then 0 when edge_prob < 0 or edge_prob > 1 then 1 / (1 + exp(-greatest(-20, least(20, edge_prob)))) else edge_prob end p
 from e where edge_prob is not null) where node_id >= 0 group by 1),
pk as (select n.*, score from n join pb using (node_id) where node_id not in (select node_id from tk) and score >= 0.3)"""
#: The same blocks over the detections of the forest only.
PRE_T = PRE + f", {PK}, nt as (select * from tk)"
CA_T = CA.replace("from n where", "from tk where").replace("from n p", "from tk p").replace("join n ", "join tk ")
SD_T = SD.replace("join n ", "join tk ")
CAPPED = f"""{SD_T},
rk as (select *, row_number() over (partition by dataset, t order by score, p_id, d2_id) k from sd),
gr as (with recursive g as (select distinct dataset, t, 0 k, []::bigint[] ps, []::bigint[] ds from rk
 union all select g.dataset, g.t, g.k + 1, case when list_contains(ps, p_id) or list_contains(ds, d2_id) then ps else list_append(ps, p_id) end,
  case when list_contains(ps, p_id) or list_contains(ds, d2_id) then ds else list_append(ds, d2_id) end from g join rk on rk.dataset = g.dataset and rk.t = g.t and rk.k = g.k + 1) select * from g),
gl as (select dataset, t, unnest(ps) p_id, unnest(ds) d2_id, unnest(range(1, len(ps) + 1)) k from (select * from gr qualify row_number() over (partition by dataset, t order by k desc) = 1)),
fcap as (select dataset, t, greatest(1, round_even(count(*) * 0.0076::double, 0)) cap from tk where node_id in (select source_id from ch) group by all),
gcap as (select dataset, greatest(1, round_even(count(*) * 0.00375::double, 0)) cap from fo group by 1),
inf as (select gl.* from gl join fcap using (dataset, t) where k <= cap),
sf as (select * from (select *, row_number() over (partition by dataset order by t, k) j from inf) join gcap using (dataset) where j <= cap),
sa as (select sd.* from sd join sf using (p_id, d2_id))"""
EN = f"""ea as (select 'a' shape, t, p_id, d1_id, d2_id, p_d1_um, p_d2_um, sister_um, angle_deg, mirror_um, null::double low_score_d2 from ca),
fp as (select * from pk where not exists (select 1 from tk b where b.dataset = pk.dataset and b.t = pk.t and {_um("pk", "b")} < 3.0)),
ed0 as (select p.t, p.node_id p_id, d1.node_id d1_id, -d2.node_id - 1 d2_id, ch.um p_d1_um, {_um("p", "d2")} p_d2_um, {_um("d1", "d2")} sister_um, d2.score low_score_d2,
 ((d1.z - p.z) * 1.625 * ((d2.z - p.z) * 1.625) + (d1.y - p.y) * 0.40625 * ((d2.y - p.y) * 0.40625) + (d1.x - p.x) * 0.40625 * ((d2.x - p.x) * 0.40625)) dotp,
 sqrt(((d2.z - (2 * p.z - d1.z)) * 1.625) ** 2 + ((d2.y - (2 * p.y - d1.y)) * 0.40625) ** 2 + ((d2.x - (2 * p.x - d1.x)) * 0.40625) ** 2) mirror_um
 from tk p join ch on ch.source_id = p.node_id and ch.um <= 12 join tk d1 on d1.node_id = ch.target_id join fp d2 on d2.dataset = p.dataset and d2.t = p.t + 1 where {_um("p", "d2")} <= 9 and {_um("d1", "d2")} <= 16),
ed as (select 'd' shape, t, p_id, d1_id, d2_id, p_d1_um, p_d2_um, sister_um, degrees(acos(greatest(-1.0, least(1.0, dotp / (p_d1_um * p_d2_um))))) angle_deg, mirror_um, low_score_d2 from ed0 where p_d1_um * p_d2_um > 1e-8),
en as (select *, row_number() over (partition by p_id order by mirror_um, shape, d2_id) - 1 mirror_rank from (select * from ea union all select * from ed where angle_deg >= 90))"""


@query
def capped_safe_divisions(spark, d):
    """Rule-based divisions under the budgets of frames and datasets."""
    return _base(spark, d)[3].select("dataset", "t", "p_id", "d1_id", "d2_id", F.round("score", 6).alias("score"))


SQL["capped_safe_divisions"] = PRE_T + f", {CA_T}, {CAPPED} select dataset, t, p_id, d1_id, d2_id, round(score, 6) score from sa"


@query
def enumerated_forks(spark, d):
    """Fork candidates with a free detection (a) or a peak (d) as second daughter, beside the rule-based divisions."""
    n, l, peaks, safe = _base(spark, d)
    rows = edits.enumerate_forks(n, l, safe, peaks)
    return rows.select("shape", "t", "p_id", "d1_id", "d2_id", "mirror_rank", "in_safe_div", "p_in_safe_div", "d2_in_safe_div", "p_back_len", "d1_fwd_len", "d2_fwd_len",
                       *[F.round(c, 6).alias(c) for c in ("p_d1_um", "p_d2_um", "sister_um", "angle_deg", "mirror_um", "low_score_d2")])


_LEN = lambda a, b, name: f"""{name}1 as (select {a} s, min({b}) g from fo group by 1 having count(*) = 1),
{name} as (with recursive r(s, v, k) as (select s, g, 1 from {name}1 union all select r.s, g, k + 1 from r join {name}1 c on c.s = r.v where k < 10) select s, max(k) k from r group by 1)"""  # noqa: E731
FLAGS = """fl as (select en.*, case when (en.p_id, en.d2_id) in (select (p_id, d2_id) from sa) then 1 else 0 end in_safe_div, en.p_id in (select p_id from sa) ps, en.d2_id in (select d2_id from sa) ds from en)"""
SQL["enumerated_forks"] = PRE_T + f""", {CA_T}, {CAPPED}, {EN}, {FLAGS}, {_LEN("target_id", "source_id", "bk")}, {_LEN("source_id", "target_id", "fw")}
select shape, t, p_id, d1_id, d2_id, mirror_rank::int mirror_rank, in_safe_div, case when ps and in_safe_div = 0 then 1 else 0 end p_in_safe_div, case when ds and in_safe_div = 0 then 1 else 0 end d2_in_safe_div,
 coalesce(b.k, 0)::int p_back_len, coalesce(f1.k, 0)::int d1_fwd_len, coalesce(f2.k, 0)::int d2_fwd_len, round(p_d1_um, 6) p_d1_um, round(p_d2_um, 6) p_d2_um, round(sister_um, 6) sister_um, round(angle_deg, 6) angle_deg,
 round(mirror_um, 6) mirror_um, round(low_score_d2, 6) low_score_d2 from fl left join bk b on b.s = p_id left join fw f1 on f1.s = d1_id left join fw f2 on f2.s = d2_id"""


@query
def edit_filter(spark, d):
    """Candidates within the bounds of geometry, and every rule-based division; peaks are none."""
    n, l, peaks, safe = _base(spark, d)
    return edits.edit_filter(edits.enumerate_forks(n, l, safe, peaks), 6.0, 1.0, 9.0, 90.0).select("shape", "p_id", "d2_id", "in_safe_div")


SQL["edit_filter"] = PRE_T + f", {CA_T}, {CAPPED}, {EN}, {FLAGS} select shape, p_id, d2_id, in_safe_div from fl where in_safe_div = 1 or (shape = 'a' and mirror_um <= 6 and p_d2_um between 1 and 9 and angle_deg >= 90)"


@query
def fork_surroundings(spark, d):
    """Detections near each second daughter, and how near another track ends."""
    n, l, peaks, safe = _base(spark, d)
    rows = edits.with_surroundings(edits.enumerate_forks(n, l, safe, peaks), n, l)
    return rows.select("p_id", "d2_id", "nearby_10um", F.round("broken_track_d2_um", 6).alias("broken_track_d2_um"))


SQL["fork_surroundings"] = PRE_T + f""", {CA_T}, {EN}, sp as (select distinct en.shape, d2_id, coalesce(a.dataset, b.dataset) dataset, en.t, coalesce(a.z, b.z) z, coalesce(a.y, b.y) y, coalesce(a.x, b.x) x
 from en left join tk a on a.node_id = d2_id left join pk b on b.node_id = -d2_id - 1),
nb as (select d2_id, count(*) c from sp join tk b on b.dataset = sp.dataset and b.t = sp.t + 1 where {_um("sp", "b")} <= 10 group by 1),
br as (select en.p_id, en.d2_id, min({_um("sp", "b")}) um from en join sp using (d2_id) join tk b on b.dataset = sp.dataset and b.t in (sp.t - 1, sp.t) and b.node_id not in (select source_id from fo) and b.node_id <> en.p_id group by all)
select p_id, d2_id, greatest(0, coalesce(c, 0) - case when shape = 'd' then 0 else 1 end)::int nearby_10um, round(um, 6) broken_track_d2_um from en left join nb using (d2_id) left join br using (p_id, d2_id)"""


def _scorer(spark, d):
    """A score for each parent: the highest one of its delivered forks, -1 without one."""
    best = forks(spark, d).where("score is not null and not isnan(score)").groupBy("p_id").agg(F.max("score").alias("score"))

    def score(cands, n, before, cache):
        probs = ln.deliveries(edges(spark, d)).where("edge_prob is not null").select("source_id", "target_id", clean_probability(F.col("edge_prob")).alias("prob"))
        scored = edits.with_probabilities(cands, probs).join(best, "p_id", "left")
        may = (F.col("in_safe_div") == 1) | edits.add_gate_flag()
        return scored.withColumn("score", F.when(may, F.coalesce("score", F.lit(-1.0))).otherwise(-1.0))

    return score


def _hook(spark, d):
    n, l, _, safe = _base(spark, d)
    return edits.division_hook(n, l, safe.select("dataset", "t", "p_id", "d2_id"), _scorer(spark, d), 0.3, 0.2, {"most_mirror": 8.0})


@query
def division_hook(spark, d):
    """The links of the forest after the whole hook: enumerate, filter, score, choose, cap, apply."""
    return _hook(spark, d)[0]


@query
def stronger_edits(spark, d):
    """Additions and removals by the plan that takes single candidates by score and spares ended tracks."""
    n, l, peaks, safe = _base(spark, d)
    cands = _scorer(spark, d)(edits.enumerate_forks(n, l, safe, peaks), n, l, None)
    adds, removes = edits.choose_stronger(edits.with_surroundings(cands, n, l), 0.3, 0.2)
    pair = lambda rows, what: rows.select(F.lit(what).alias("action"), "p_id", "d2_id")
    return pair(adds, "add").unionByName(pair(removes, "remove"))


def _apply_case(spark, d):
    """Rule-based divisions; of these the ones above 6 leave, and peaks come in that fit their parent best, and their parent them."""
    n, l, peaks, safe = _base(spark, d)
    (cands,) = kept(spark, edits.enumerate_forks(n, l, safe, peaks).where("shape = 'd' and p_in_safe_div = 0"))
    for key in ("p_id", "d2_id"):
        rank = F.row_number().over(W.partitionBy(key).orderBy("mirror_um", "p_id", "d2_id"))
        cands = cands.withColumn(f"k_{key}", rank)
    adds = cands.where("k_p_id = 1 and k_d2_id = 1")
    both = l.select("dataset", "t", "source_id", "target_id", F.lit(0).alias("safe_division")).unionByName(safe.select("dataset", "t", F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id"), F.lit(1).alias("safe_division")))
    return edits.apply_edits(n, *kept(spark, both, adds, safe.where("score > 6")))


APPLY = """rm as (select * from sa where score > 6), dd as (select en.*, tk.dataset from en join tk on tk.node_id = p_id where shape = 'd' and p_id not in (select p_id from sa)),
dk as (select * from dd qualify row_number() over (partition by p_id order by mirror_um, d2_id) = 1 and row_number() over (partition by d2_id order by mirror_um, p_id) = 1),
nw as (select *, (select max(node_id) + 1 from tk) + row_number() over (order by dataset, t, p_id) - 1 new_id from dk)"""


@query
def applied_edits(spark, d):
    """The forest with rule-based divisions after removals and additions of peaks as new nodes."""
    return _apply_case(spark, d)[0]


SQL["applied_edits"] = PRE_T + f""", {CA_T}, {CAPPED}, {EN}, {APPLY} select dataset, t, source_id, target_id, 0 safe_division, 0 learned_division from fo
union all select dataset, t, p_id, d2_id, 1, 0 from sa where (p_id, d2_id) not in (select (p_id, d2_id) from rm) union all select dataset, t, p_id, new_id, 1, 1 from nw"""


@query
def new_division_nodes(spark, d):
    """The nodes that peaks become, with the next free ids."""
    return _apply_case(spark, d)[1]


SQL["new_division_nodes"] = PRE_T + f", {CA_T}, {CAPPED}, {EN}, {APPLY} select nw.dataset, new_id node_id, nw.t + 1 t, pk.z, pk.y, pk.x from nw join pk on pk.node_id = -d2_id - 1"


@query
def replayed_divisions(spark, d):
    """Recorded decisions in place of scores: the rule-based divisions above 6 leave."""
    n, l, _, safe = _base(spark, d)
    both = l.select("dataset", "t", "source_id", "target_id", F.lit(0).alias("safe_division")).unionByName(safe.select("dataset", "t", F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id"), F.lit(1).alias("safe_division")))
    rows = safe.select(F.lit("kept").alias("plan"), F.when(F.col("score") > 6, "remove").otherwise("keep").alias("action"), "p_id", "d2_id")
    for p in ("p", "d2"):
        rows = rows.join(n.select(*["dataset"] * (p == "p"), F.col("node_id").alias(f"{p}_id"), F.col("t").alias(f"{p}_t"), *[F.col(c).alias(f"{p}_{c}") for c in AXES]), f"{p}_id")
    return edits.replay(n, *kept(spark, both, rows), "kept").select("dataset", "t", "source_id", "target_id", "safe_division")


SQL["replayed_divisions"] = PRE_T + f", {CA_T}, {CAPPED} select dataset, t, source_id, target_id, 0 safe_division from fo union all select dataset, t, p_id, d2_id, 1 from sa where score <= 6"


@query
def source_geometry(spark, d):
    """Links whose source keeps two of them only if they look like a division."""
    n, l = kept(spark, det(spark, d), links(spark, d))
    return edits.source_geometry(l, n, ln.strength()).select("edge_id", "source_id", "target_id")


SQL["source_geometry"] = BASE + f""", r as (select *, row_number() over (partition by source_id order by coalesce(edge_prob, 0) desc, um, edge_id) k from l),
g as (select a.source_id, greatest(a.um, b.um) <= 10.5 and {_um("x", "y")} <= 8 ok from r a join r b on a.source_id = b.source_id and a.k = 1 and b.k = 2 join n x on x.node_id = a.target_id join n y on y.node_id = b.target_id)
select edge_id, source_id, target_id from r left join g using (source_id) where ok is null or (ok and k <= 2) or (not ok and k <= 1)"""


@query
def score_combinations(spark, d):
    """One score of several, each way: the delivered one, the angle as a classifier's, and the choice probability."""
    rows = forks(spark, d).where("d2_id is not null and mirror_um is not null and angle_deg is not null and not isnan(mirror_um) and not isnan(angle_deg)")
    rows = dv.conditional_logit(rows, F.col("angle_deg") / 90 - F.col("mirror_um"))
    gate = (F.col("angle_deg") >= 90).cast("int")
    ways = edits.combined_scores(F.nanvl("score", F.lit(None).cast("double")), F.col("angle_deg") / 180, F.col("prob"), F.col("mirror_um"), gate, 0.3, 0.25)
    return rows.select("fork_id", *[F.round(c, 6).alias(name.lower()) for name, c in ways.items()])


SQL["score_combinations"] = """with f as (select distinct fork_id, dataset, p_id, d1_id, d2_id, shape, angle_deg, mirror_um, score, label from forks),
u as (select *, exp(angle_deg / 90 - mirror_um) v from f where d2_id is not null and mirror_um is not null and angle_deg is not null and not isnan(mirror_um) and not isnan(angle_deg) and dataset is not null),
w as (select fork_id, case when not isnan(score) then score end a, angle_deg / 180 b, v / (1 + sum(v) over (partition by dataset, d2_id)) bl, mirror_um, angle_deg from u),
x as (select *, least(1.0, greatest(0.0, coalesce(a, 0.0))) un from w)
select fork_id, round(a, 6) a, round(b, 6) b, round(case when a is not null then least(a, b) end, 6) "and", round(case when a is not null then greatest(a, b) end, 6) "or", round(mirror_um, 6) geom, round(bl, 6) bl, round(sqrt(un * bl), 6) a_bl,
 round(greatest(case when angle_deg >= 90 then un / 0.3 else 0.0 end, sqrt(un * bl) / 0.25), 6) a_or_bl from x"""


@query
def accepted_by_score(spark, d):
    """Forks that a detector's score does not bar: those without one, and those at 0.5 or above."""
    return forks(spark, d).where(edits.accept_by_score(F.col("score"), 0.5)).select("fork_id")


SQL["accepted_by_score"] = "select distinct fork_id from forks where score is null or isnan(score) or score >= 0.5"


@query
def probability_percentiles(spark, d):
    """Percentiles of the cleaned probabilities of each dataset's links, by linear interpolation."""
    rows = ln.deliveries(edges(spark, d)).join(det(spark, d).select(F.col("node_id").alias("source_id"), "dataset"), "source_id").where("edge_prob is not null")
    return learning.percentiles(rows.select("dataset", clean_probability(F.col("edge_prob")).alias("p")), ["dataset"], "p")


SQL["probability_percentiles"] = BASE + """, p as (select dataset, case when isnan(edge_prob) then 0 when edge_prob < 0 or edge_prob > 1 then 1 / (1 + exp(-greatest(-20, least(20, edge_prob)))) else edge_prob end p
 from e join n on node_id = source_id where edge_prob is not null)
select dataset, round(quantile_cont(p, 0.01), 9) p1, round(quantile_cont(p, 0.2), 9) p20, round(quantile_cont(p, 0.5), 9) p50, round(quantile_cont(p, 0.995), 9) p99_5, round(quantile_cont(p, 0.999), 9) p99_9 from p group by 1"""
