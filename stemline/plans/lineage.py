"""Queries of the lineage engine: graph checks, spatial joins, divisions, smoothing, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, clean_probability
from stemline.operators import divisions as dv
from stemline.operators import lineage as ln
from stemline.operators import matching, relink, repair, scoring, smoothing, spatial
from stemline.operators import transitions as tr
from stemline.operators.hierarchy import nested_sets
from stemline.sources import submission
from stemline.sources.tables import table
from stemline.store import Scratch

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def det(spark: SparkSession, d: str) -> DataFrame:
    return ln.detections(table(spark, d, "nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges")


def links(spark: SparkSession, d: str) -> DataFrame:
    return ln.links(edges(spark, d), det(spark, d))


def forest(spark: SparkSession, d: str) -> DataFrame:
    return ln.forest(links(spark, d))


#: Links that are there before divisions are added.
BEFORE_DIVISIONS = "motion_pass is null or motion_pass <> 'division'"


def pre_forest(spark: SparkSession, d: str) -> DataFrame:
    """The forest before divisions are added."""
    return ln.forest(links(spark, d).where(BEFORE_DIVISIONS))


def kept(spark: SparkSession, *tables: DataFrame) -> list[DataFrame]:
    """Tables that a query reads several times, written once."""
    scratch = Scratch(spark, "lineage")
    return [scratch.keep(t, "table") for t in tables]


def forks(spark: SparkSession, d: str) -> DataFrame:
    """Fork candidates, repeated deliveries once."""
    return table(spark, d, "forks").select("fork_id", "dataset", "p_id", "d1_id", "d2_id", "shape", "angle_deg", "mirror_um", "score", "label").distinct()


# The gates, budgets and weights in the SQL below are those of the definition, stated again.
# ---- SQL building blocks -----------------------------------------------------------------------------------------


def _um(a: str, b: str) -> str:
    part = [f"(({b}.{c} - {a}.{c}) * {s})" for c, s in (("z", "1.625"), ("y", "0.40625"), ("x", "0.40625"))]
    return "sqrt(" + " + ".join(f"{p} * {p}" for p in part) + ")"


N = """n as (select distinct dataset, node_id, t, z + 0.0 z, y + 0.0 y, x + 0.0 x, gap_synthetic, readmitted from nodes where dataset is not null and node_id is not null and t is not null
 and z is not null and y is not null and x is not null and not isnan(z) and not isnan(y) and not isnan(x))"""
E_ = "e as (select distinct edge_id, source_id, target_id, edge_prob, distance_um, motion_pass, gap_closed, safe_division from edges)"
L = f"""l0 as (select e.*, a.dataset, a.t, {_um("a", "b")} um from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.dataset = b.dataset and b.t = a.t + 1),
 l as (select * from l0 where um <= 14.0)"""
BP = "bp as (select * from l qualify row_number() over (partition by target_id order by coalesce(edge_prob, 0) desc, um, edge_id) = 1)"
FO = "fo as (select * from bp qualify row_number() over (partition by source_id order by coalesce(edge_prob, 0) desc, um, edge_id) <= 2)"
BASE = f"with {N},\n {E_},\n {L},\n {BP},\n {FO}\n"
#: The same, before divisions are added.
PRE = BASE.replace("where um <= 14.0", "where um <= 14.0 and motion_pass is distinct from 'division'")


def _greedy(src: str, cost: str, a: str = "a_id", b: str = "b_id") -> str:
    """Tables rk and gl: what a greedy choice in each frame takes, pair by pair in the order of the cost."""
    busy = f"list_contains(ps, {a}) or list_contains(ds, {b})"
    return f"""rk as (select *, row_number() over (partition by dataset, t order by {cost}, {a}, {b}) k from {src}),
gr as (with recursive g as (select distinct dataset, t, 0 k, []::bigint[] ps, []::bigint[] ds from rk
 union all select g.dataset, g.t, g.k + 1, case when {busy} then ps else list_append(ps, {a}) end, case when {busy} then ds else list_append(ds, {b}) end
 from g join rk on rk.dataset = g.dataset and rk.t = g.t and rk.k = g.k + 1) select * from g),
gl as (select dataset, t, unnest(ps) {a}, unnest(ds) {b} from (select * from gr qualify row_number() over (partition by dataset, t order by k desc) = 1))"""


# ---- relational ------------------------------------------------------------------------------------------------


@query
def detections(spark, d):
    return det(spark, d)


SQL["detections"] = f"with {N} select * from n"


@query
def links_14um(spark, d):
    return links(spark, d).select("edge_id", "dataset", "t", "source_id", "target_id", F.round("um", 6).alias("um"))


SQL["links_14um"] = BASE + "select edge_id, dataset, t, source_id, target_id, round(um, 6) um from l"


@query
def dangling_links(spark, d):
    return ln.dangling(edges(spark, d), table(spark, d, "nodes"))


SQL["dangling_links"] = f"""with {E_}, ends as (select edge_id, 'source_id' field, source_id node_id from e union all select edge_id, 'target_id', target_id from e)
select * from ends where node_id >= 0 and node_id not in (select node_id from nodes)"""


@query
def track_ends(spark, d):
    """Starts, ends and isolated detections."""
    return ln.ends_of_tracks(det(spark, d), links(spark, d))


SQL["track_ends"] = BASE + """select node_id, dataset, t, kind from (select n.*, case when not s and not g then 'isolated' when not g then 'start' when not s then 'end' end kind
 from (select n.*, node_id in (select source_id from l) s, node_id in (select target_id from l) g from n) n) where kind is not null"""


@query
def degree_histogram(spark, d):
    return ln.degrees(links(spark, d)).groupBy("n_in", "n_out").agg(F.count("*").alias("n_nodes"))


SQL["degree_histogram"] = BASE + """select n_in, n_out, count(*) n_nodes from (select node_id, sum(i)::bigint n_in, sum(o)::bigint n_out from
 (select source_id node_id, 0 i, 1 o from l union all select target_id, 1, 0 from l) group by 1) group by all"""


@query
def division_parents(spark, d):
    return ln.degrees(forest(spark, d)).where("n_out = 2").select("node_id")


SQL["division_parents"] = BASE + "select source_id node_id from fo group by 1 having count(*) = 2"


@query
def best_parents(spark, d):
    return ln.best_parent(links(spark, d)).select("edge_id", "source_id", "target_id")


SQL["best_parents"] = BASE + "select edge_id, source_id, target_id from bp"


@query
def fallback_graph(spark, d):
    """At most one parent and the two best children."""
    return forest(spark, d).select("edge_id", "source_id", "target_id")


SQL["fallback_graph"] = BASE + "select edge_id, source_id, target_id from fo"


@query
def prune_isolated(spark, d):
    return ln.prune_isolated(det(spark, d), links(spark, d)).select("node_id", "dataset", "t")


SQL["prune_isolated"] = BASE + "select node_id, dataset, t from n where node_id in (select source_id from l union select target_id from l)"


@query
def forest_violations(spark, d):
    return ln.violations(edges(spark, d), det(spark, d))


SQL["forest_violations"] = f"""with {N}, {E_}, k as (select edge_id, source_id, target_id, a.t st, b.t gt from e left join n a on a.node_id = source_id left join n b on b.node_id = target_id
 where source_id is not null and target_id is not null), u as (select distinct source_id, target_id from k)
select 'self_loop' kind, edge_id id from k where source_id = target_id
union all select 'dangling', edge_id from k where st is null or gt is null
union all select 'dt', edge_id from k where gt <> st + 1 and source_id <> target_id
union all select 'merge', target_id from u group by target_id having count(*) > 1
union all select 'multi_branch', source_id from u group by source_id having count(*) > 2"""


@query
def edge_prob_lookup(spark, d):
    """The learned probability of each forest link, cleaned; 0 and not observed where there is none."""
    return ln.probabilities(forest(spark, d).select("source_id", "target_id"), edges(spark, d))


SQL["edge_prob_lookup"] = BASE + """, p as (select source_id, target_id, max(case when isnan(edge_prob) then 0 when edge_prob < 0 or edge_prob > 1
 then 1 / (1 + exp(-greatest(-20, least(20, edge_prob)))) else edge_prob end) prob from e where edge_prob is not null group by all)
select source_id, target_id, coalesce(prob, 0.0) prob, case when prob is null then 0 else 1 end observed from fo left join p using (source_id, target_id)"""


@query
def clean_probabilities(spark, d):
    return ln.deliveries(edges(spark, d)).select("edge_id", F.round(clean_probability(F.col("edge_prob")), 6).alias("prob"))


SQL["clean_probabilities"] = f"""with {E_} select edge_id, round(case when edge_prob is null or isnan(edge_prob) then 0 when edge_prob < 0 or edge_prob > 1
 then 1 / (1 + exp(-greatest(-20, least(20, edge_prob)))) else edge_prob end, 6) prob from e"""


@query
def keep_strict_merge(spark, d):
    """Strict links, and other links whose ends are both free in these."""
    rows = links(spark, d)
    strict = F.col("motion_pass") == "strict"
    return ln.keep_and_fill(rows.where(strict), rows.where(F.col("motion_pass").isNull() | ~strict)).select("edge_id", "source_id", "target_id")


SQL["keep_strict_merge"] = BASE + """select edge_id, source_id, target_id from l where motion_pass = 'strict' union all select edge_id, source_id, target_id from l where motion_pass is distinct from 'strict'
 and source_id not in (select source_id from l where motion_pass = 'strict') and target_id not in (select target_id from l where motion_pass = 'strict')"""


@query
def added_links_except(spark, d):
    """Pairs that only links of other passes than the strict one give."""
    rows = links(spark, d)
    pair = ["source_id", "target_id"]
    return rows.select(*pair).distinct().join(rows.where("motion_pass = 'strict'").select(*pair).distinct(), pair, "left_anti")


SQL["added_links_except"] = BASE + "select source_id, target_id from l except select source_id, target_id from l where motion_pass = 'strict'"


@query
def single_links(spark, d):
    """Links that are the only one of both their ends."""
    return ln.single_links(links(spark, d)).select("edge_id", "source_id", "target_id")


SQL["single_links"] = BASE + "select edge_id, source_id, target_id from l qualify count(*) over (partition by source_id) = 1 and count(*) over (partition by target_id) = 1"


def movie_name(c):
    return F.btrim(F.regexp_replace(F.btrim(F.lower(c), F.lit(" \t")), r"\.(zarr|geff)$", ""), F.lit(" \t"))


MOVIE = r"trim(regexp_replace(trim(lower(dataset), ' ' || chr(9)), '\.(zarr|geff)$', ''), ' ' || chr(9))"


@query
def coverage(spark, d):
    """Datasets that have score rows but no detections, and the other way round."""
    scored = table(spark, d, "per_dataset").select(movie_name(F.col("dataset")).alias("dataset")).where("dataset is not null").distinct()
    seen = det(spark, d).select(movie_name(F.col("dataset")).alias("dataset")).distinct()
    return scored.join(seen, "dataset", "left_anti").withColumn("lacks", F.lit("detections")).unionByName(seen.join(scored, "dataset", "left_anti").withColumn("lacks", F.lit("scores")))


SQL["coverage"] = f"""with {N}, s as (select distinct {MOVIE} dataset from per_dataset where dataset is not null), g as (select distinct {MOVIE} dataset from n)
select dataset, 'detections' lacks from s where dataset not in (from g) union all select dataset, 'scores' from g where dataset not in (from s)"""


@query
def submission_rows(spark, d):
    return ln.submission(det(spark, d), forest(spark, d))


SQL["submission_rows"] = BASE + """select dataset, 'node' row_type, node_id, t::bigint t, greatest(0, round_even(z, 0)::bigint) z, greatest(0, round_even(y, 0)::bigint) y, greatest(0, round_even(x, 0)::bigint) x,
 -1::bigint source_id, -1::bigint target_id from n union all select dataset, 'edge', -1, -1, -1, -1, -1, source_id, target_id from fo"""


@query
def submission_roundtrip(spark, d):
    """The submission rows, written as CSV and read again."""
    path = f"{Scratch(spark, 'submission').root}/csv"
    submission.write_submission(submission_rows(spark, d), path)
    return submission.read_submission(spark, path).drop("id")


SQL["submission_roundtrip"] = SQL["submission_rows"]


# ---- spatial -----------------------------------------------------------------------------------------------------

PAIRS = lambda r, dt, extra="": f"""pairs as (select a.dataset, a.t, a.node_id a_id, b.node_id b_id, {_um("a", "b")} um from n a join n b on a.dataset = b.dataset and b.t = a.t + {dt}
 where {_um("a", "b")} <= {r} {extra})"""  # noqa: E731


@query
def radius_pairs_12um(spark, d):
    """Pairs of detections of neighbouring frames within 12 micrometres."""
    n = det(spark, d)
    return spatial.radius_pairs(n, n, 12.0).select("a_id", "b_id", F.round("um", 6).alias("um"))


SQL["radius_pairs_12um"] = f"with {N}, {PAIRS(12.0, 1)} select a_id, b_id, round(um, 6) um from pairs"


@query
def nearest_next(spark, d):
    """The nearest detection of the next frame, however far."""
    (n,) = kept(spark, det(spark, d))
    return spatial.nearest_anywhere(n, n).select("a_id", "b_id", F.round("um", 6).alias("um"))


SQL["nearest_next"] = f"with {N}, {PAIRS(1e300, 1)} select a_id, b_id, round(um, 6) um from pairs qualify row_number() over (partition by a_id order by um, b_id) = 1"


@query
def knn3_spacing(spark, d):
    """The median distance to the three nearest neighbours in the frame, however far."""
    return spatial.spacing(*kept(spark, det(spark, d))).select("node_id", F.round("spacing_um", 6).alias("spacing_um"))


SQL["knn3_spacing"] = f"""with {N}, {PAIRS(1e300, 0, "and a.node_id <> b.node_id")}, k as (select * from pairs qualify row_number() over (partition by a_id order by um, b_id) <= 3),
m as (select a_id, median(um) s from k group by 1) select node_id, round(coalesce(s, 6.5), 6) spacing_um from n left join m on a_id = node_id"""


@query
def mutual_nn_7um(spark, d):
    n = det(spark, d)
    return spatial.mutual(spatial.radius_pairs(n, n, 7.0)).select("a_id", "b_id", F.round("um", 6).alias("um"))


SQL["mutual_nn_7um"] = f"""with {N}, {PAIRS(7.0, 1)} select a_id, b_id, round(um, 6) um from pairs
 qualify row_number() over (partition by a_id order by um, b_id) = 1 and row_number() over (partition by b_id order by um, a_id) = 1"""


@query
def flow_knn_median(spark, d):
    """The motion at each detection: the median step of 12 links near it, of the 13 nearest without its own ones."""
    n = det(spark, d)
    step = ln.single_links(links(spark, d))
    samples = step.select("dataset", "t", F.col("source_id").alias("node_id"), *[F.col(f"s_{c}").alias(c) for c in AXES], *[((F.col(f"g_{c}") - F.col(f"s_{c}")) * spatial.SCALE[c]).alias(f"d{c}") for c in AXES])
    rows = spatial.flow(n, samples)
    return rows.select("node_id", "n_samples", *[F.round(f"flow_{c}", 6).alias(f"flow_{c}") for c in AXES])


SQL["flow_knn_median"] = BASE + f""", s as (select dataset, t, source_id, target_id from l qualify count(*) over (partition by source_id) = 1 and count(*) over (partition by target_id) = 1),
q as (select a.*, (b.z - a.z) * 1.625 dz, (b.y - a.y) * 0.40625 dy, (b.x - a.x) * 0.40625 dx from s join n a on a.node_id = source_id join n b on b.node_id = target_id),
k13 as (select a.node_id, q.node_id other, {_um("a", "q")} um, q.dz, q.dy, q.dx from n a join q on q.dataset = a.dataset and q.t = a.t where {_um("a", "q")} <= 40.0
 qualify row_number() over (partition by a.node_id order by {_um("a", "q")}, q.node_id) <= 13),
k as (select * from k13 where um >= 1.5 qualify row_number() over (partition by node_id order by um, other) <= 12)
select node_id, count(*) n_samples, round(median(dz), 6) flow_z, round(median(dy), 6) flow_y, round(median(dx), 6) flow_x from k group by 1"""


@query
def mutual_assignment(spark, d):
    """Detections of neighbouring frames matched one to one within 7 micrometres, as many and then as near as possible."""
    n = det(spark, d)
    return matching.assignment(spatial.radius_pairs(n, n, 7.0))


@query
def greedy_links(spark, d):
    """Detections of neighbouring frames matched one to one within 10 micrometres, the nearest pairs first."""
    n = det(spark, d)
    return matching.greedy_matching(spatial.radius_pairs(n, n, 10.0).select("dataset", "t", "a_id", "b_id", "um"))


@query
def track_lengths(spark, d):
    """Single links up to each node and away from it, up to ten."""
    return ln.track_lengths(*kept(spark, links(spark, d)))


_CHAIN = lambda a, b, name: f"""{name}1 as (select {a} s, min({b}) g from l group by 1 having count(*) = 1),
{name} as (with recursive r(s, v, k) as (select s, g, 1 from {name}1 union all select r.s, g, k + 1 from r join {name}1 c on c.s = r.v where k < 10) select s, max(k) k from r group by 1)"""  # noqa: E731
SQL["track_lengths"] = BASE + f""", {_CHAIN("target_id", "source_id", "bk")}, {_CHAIN("source_id", "target_id", "fw")}
select node_id, coalesce(bk.k, 0)::int back, coalesce(fw.k, 0)::int forward from (select source_id node_id from l union select target_id from l) left join bk on bk.s = node_id left join fw on fw.s = node_id"""


@query
def next_free_id(spark, d):
    """The id that the next new node gets."""
    return ln.next_free_id(det(spark, d))


SQL["next_free_id"] = f"with {N} select coalesce(max(node_id) + 1, 0) next_id from n"


@query
def cache_alignment(spark, d):
    """Whether the first nodes of each dataset lie where its detections, numbered by frame and place, say so."""
    (n,) = kept(spark, det(spark, d))
    row = F.row_number().over(W.partitionBy("dataset", "t").orderBy(*AXES, "node_id")) - 1
    before = n.groupBy("dataset", "t").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(W.partitionBy("dataset").orderBy("t")) - F.col("k"))
    cache = n.withColumn("at", row).join(before, ["dataset", "t"]).select("dataset", (F.col("before") + F.col("at")).alias("row"), "t", *AXES)
    return ln.aligned(n, cache)


SQL["cache_alignment"] = f"""with {N}, c as (select dataset, row_number() over (partition by dataset order by t, z, y, x, node_id) - 1 node_id, t, z, y, x from n),
f as (select * from n where node_id >= 0 qualify row_number() over (partition by dataset order by node_id) <= 200)
select dataset, coalesce(bool_and(c.t is null or (c.t = f.t and abs(f.z - c.z) <= 1e-8 + 1e-5 * abs(c.z) and abs(f.y - c.y) <= 1e-8 + 1e-5 * abs(c.y) and abs(f.x - c.x) <= 1e-8 + 1e-5 * abs(c.x))), true) aligned
from f left join c using (dataset, node_id) group by 1"""


SQL["greedy_links"] = f"with {N}, {PAIRS(10.0, 1)}, {_greedy('pairs', 'um')} select gl.dataset, gl.t, a_id, b_id, um from gl join pairs using (a_id, b_id)"


# ---- transitions ---------------------------------------------------------------------------------------------------


@query
def frozen_transitions(spark, d):
    return tr.frozen(det(spark, d))


FR = """dg as (select dataset, t, list((z, y, x) order by z, y, x) pts from n group by all),
fr as (select dataset, t, coalesce(lead(t) over w = t + 1 and lead(pts) over w = pts, false) frozen from dg window w as (partition by dataset order by t))"""
SQL["frozen_transitions"] = f"with {N}, {FR} select * from fr"


@query
def frozen_run_lengths(spark, d):
    return tr.run_lengths(tr.frozen(det(spark, d)))


RL = """rl as (select dataset, t, frozen, (t - 1 - coalesce(max(case when not frozen then t end) over b, min(t) over (partition by dataset, stretch) - 1))::int k
 from (select *, t - row_number() over (partition by dataset order by t) stretch from fr) window b as (partition by dataset, stretch order by t rows between unbounded preceding and 1 preceding))"""
SQL["frozen_run_lengths"] = f"with {N}, {FR}, {RL} select * from rl"


@query
def transition_kinds(spark, d):
    rows = tr.kinds(tr.frozen(det(spark, d)), links(spark, d))
    return rows.select("dataset", "t", "kind", "reason", "k", F.round("step_um", 6).alias("step_um"))


KI = """st as (select dataset, t, median(um) step from l group by all having count(*) >= 4), j as (select rl.*, step from rl left join st using (dataset, t)),
mv as (select dataset, median(step) mv from j where not frozen and step is not null group by 1),
ki as (select dataset, t, case when frozen then 'frozen' when k >= 1 or coalesce(mv > 0 and step >= 2 * mv, false) then 'jump' else 'normal' end kind,
 case when frozen then 'frozen' when k >= 1 then 'after_frozen' when coalesce(mv > 0 and step >= 2 * mv, false) then 'seed_median' else '' end reason, k, step from j left join mv using (dataset))"""
SQL["transition_kinds"] = BASE + f", {FR}, {RL}, {KI} select dataset, t, kind, reason, k, round(step, 6) step_um from ki"


# ---- divisions -----------------------------------------------------------------------------------------------------


def _candidates(spark, d):
    n, l = kept(spark, det(spark, d), pre_forest(spark, d))
    return dv.fork_candidates(n, l)


@query
def fork_candidates(spark, d):
    """Parents with one child and a parentless detection near both, with the geometry of the fork."""
    rows = _candidates(spark, d)
    return rows.select("p_id", "d1_id", "d2_id", "mirror_rank", *[F.round(c, 6).alias(c) for c in ("p_d1_um", "p_d2_um", "sister_um", "angle_deg", "mirror_um", "len_ratio", "t2_gain_um")])


CA = f"""ch as (select source_id, min(target_id) target_id, min(um) um from fo group by 1 having count(*) = 1),
orp as (select * from n where node_id not in (select target_id from fo)),
ca0 as (select p.dataset, p.t, p.node_id p_id, d1.node_id d1_id, d2.node_id d2_id, ch.um p_d1_um, {_um("p", "d2")} p_d2_um, {_um("d1", "d2")} sister_um,
 ((d1.z - p.z) * 1.625 * ((d2.z - p.z) * 1.625) + (d1.y - p.y) * 0.40625 * ((d2.y - p.y) * 0.40625) + (d1.x - p.x) * 0.40625 * ((d2.x - p.x) * 0.40625)) dotp,
 sqrt(((d2.z - (2 * p.z - d1.z)) * 1.625) ** 2 + ((d2.y - (2 * p.y - d1.y)) * 0.40625) ** 2 + ((d2.x - (2 * p.x - d1.x)) * 0.40625) ** 2) mirror_um
 from n p join ch on ch.source_id = p.node_id and ch.um <= 12 join n d1 on d1.node_id = ch.target_id join orp d2 on d2.dataset = p.dataset and d2.t = p.t + 1
 where {_um("p", "d2")} <= 12 and {_um("d1", "d2")} <= 16),
ca as (select ca0.*, case when p_d1_um * p_d2_um > 1e-8 then degrees(acos(greatest(-1.0, least(1.0, dotp / (p_d1_um * p_d2_um))))) end angle_deg,
 least(p_d1_um, p_d2_um) / greatest(p_d1_um, p_d2_um, 1e-6) len_ratio, {_um("g1", "g2")} - sister_um t2_gain_um, row_number() over (partition by p_id order by mirror_um, d2_id) - 1 mirror_rank
 from ca0 left join ch c1 on c1.source_id = d1_id left join n g1 on g1.node_id = c1.target_id left join ch c2 on c2.source_id = d2_id left join n g2 on g2.node_id = c2.target_id)"""
SQL["fork_candidates"] = PRE + f""", {CA} select p_id, d1_id, d2_id, mirror_rank::int mirror_rank, round(p_d1_um, 6) p_d1_um, round(p_d2_um, 6) p_d2_um, round(sister_um, 6) sister_um, round(angle_deg, 6) angle_deg,
 round(mirror_um, 6) mirror_um, round(len_ratio, 6) len_ratio, round(t2_gain_um, 6) t2_gain_um from ca"""


@query
def fork_geometry_filter(spark, d):
    rows = dv.geometry_filter(_candidates(spark, d), 6.0, 1.0, 9.0, 90.0)
    return rows.select("p_id", "d2_id")


SQL["fork_geometry_filter"] = PRE + f", {CA} select p_id, d2_id from ca where mirror_um <= 6 and p_d2_um between 1 and 9 and angle_deg >= 90"


@query
def fork_add_gate(spark, d):
    """Candidates whose new link the model has seen, wide and moving apart."""
    seen = ln.deliveries(edges(spark, d)).where("edge_prob is not null")
    return dv.add_gate(_candidates(spark, d), seen).select("p_id", "d2_id")


SQL["fork_add_gate"] = PRE + f", {CA} select p_id, d2_id from ca where angle_deg >= 90 and coalesce(t2_gain_um, -1) > 0 and (p_id, d2_id) in (select (source_id, target_id) from e where edge_prob is not null)"


@query
def safe_divisions(spark, d):
    n, l = kept(spark, det(spark, d), pre_forest(spark, d))
    return dv.safe_divisions(n, l, least_gain=0.25).select("p_id", "d1_id", "d2_id", F.round("score", 6).alias("score"))


SD = f"""cl as (select d1.node_id d1_id, d2.node_id d2_id, {_um("d1", "d2")} sister from ch join n d1 on d1.node_id = ch.target_id and ch.um <= 10 join orp d2 on d2.dataset = d1.dataset and d2.t = d1.t
 where {_um("d1", "d2")} <= 14 qualify row_number() over (partition by d1.node_id order by {_um("d1", "d2")}, d2.node_id) = 1),
sd as (select p.dataset, p.t, p.node_id p_id, cl.d1_id, cl.d2_id, {_um("p", "d2")} + 0.15 * sister score from ch join n p on p.node_id = ch.source_id join cl on cl.d1_id = ch.target_id
 join n d2 on d2.node_id = cl.d2_id join ch c1 on c1.source_id = cl.d1_id join n g1 on g1.node_id = c1.target_id join ch c2 on c2.source_id = cl.d2_id join n g2 on g2.node_id = c2.target_id
 where {_um("p", "d2")} <= 9 and {_um("g1", "g2")} - sister >= 0.25 and abs(ch.um - {_um("p", "d2")}) / ((ch.um + {_um("p", "d2")}) / 2) <= 0.6)"""
SQL["safe_divisions"] = PRE + f", {CA}, {SD} select p_id, d1_id, d2_id, round(score, 6) score from sd"


@query
def capped_additions(spark, d):
    """Fork candidates within the budgets of their frames and datasets, small mirror distances first."""
    n, l = kept(spark, det(spark, d), pre_forest(spark, d))
    adds = dv.fork_candidates(n, l).where("mirror_rank = 0").withColumn("score", -F.round("mirror_um", 9))
    return dv.capped(adds, l, l, frame_part=0.05, edge_part=0.01).select("dataset", "t", "p_id", "d2_id")


SQL["capped_additions"] = PRE + f""", {CA}, fc as (select dataset, t, greatest(1, round_even(count(distinct source_id) * 0.05::double, 0)) fcap from fo group by all),
sc as (select dataset, greatest(1, round_even(count(*) * 0.01::double, 0)) scap from fo group by 1),
k1 as (select * from (select ca.*, coalesce(fcap, 1) fcap, coalesce(scap, 1) scap, row_number() over (partition by dataset, t order by round(mirror_um, 9), p_id, d2_id) k from ca left join fc using (dataset, t) left join sc using (dataset) where mirror_rank = 0) where k <= fcap)
select dataset, t, p_id, d2_id from (select *, row_number() over (partition by dataset order by round(mirror_um, 9), p_id, d2_id) k2 from k1) where k2 <= scap"""


def fork_pools(spark, d):
    """Delivered fork candidates that are no safe divisions, and those that are: pairs (p_id, d2_id) with a link of safe_division 1."""
    n = det(spark, d)
    at = n.select(F.col("node_id").alias("p_id"), F.col("dataset").alias("p_dataset"), "t", *[F.col(c).alias(f"p_{c}") for c in AXES])
    rows = forks(spark, d).drop("dataset").join(at, "p_id").withColumnRenamed("p_dataset", "dataset")
    links_ = edges(spark, d).where("safe_division = 1").select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d2_id"), F.lit(True).alias("safe")).distinct()
    rows = rows.withColumn("mirror_um", F.coalesce("mirror_um", F.lit(float("nan")))).join(links_, ["p_id", "d2_id"], "left")  # without one: behind all others
    rows, first = kept(spark, rows, rows.where("safe").groupBy("p_id", "d2_id").agg(F.min("fork_id").alias("fork_id")).select("fork_id"))
    cands = rows.where("safe is null and shape = 'a' and d2_id >= 0 and score is not null and not isnan(score)").drop("safe")
    return cands, rows.join(first, "fork_id", "left_semi").drop("safe")


@query
def chosen_forks(spark, d):
    """Greedy selection among the scored fork candidates that are delivered, beside the safe divisions."""
    cands, safe = fork_pools(spark, d)
    return dv.choose_forks(cands, 0.5, safe=safe)


_NEAR = "((a.z - {p}.p_z) * 1.625) ** 2 + ((a.y - {p}.p_y) * 0.40625) ** 2 + ((a.x - {p}.p_x) * 0.40625) ** 2 <= 100"
SQL["chosen_forks"] = BASE + f""", fk as (select distinct fork_id, p_id, d1_id, d2_id, shape, mirror_um, score from forks), sl as (select distinct source_id p_id, target_id d2_id from e where safe_division = 1),
fp as (select fk.*, n.dataset, n.t, n.z p_z, n.y p_y, n.x p_x, (fk.p_id, fk.d2_id) in (select (p_id, d2_id) from sl) safe from fk join n on n.node_id = fk.p_id),
sf as (select * from fp where safe),
pl as (select distinct dataset, t, p_id, d2_id, coalesce(mirror_um, 'nan'::double) m, score s, p_z, p_y, p_x from fp where not coalesce(safe, false) and shape = 'a' and d2_id >= 0 and score >= 0.5 and not isnan(score)
 and p_id not in (select p_id from sf) and d2_id not in (select d2_id from sf)
 and not exists (select 1 from (select dataset, t, p_z z, p_y y, p_x x from sf) a where a.dataset = fp.dataset and abs(a.t - fp.t) <= 1 and {_NEAR.format(p="fp")})),
pa as (select dataset, t, p_id, p_z, p_y, p_x, max(s) s, list(d2_id order by m, d2_id) ds from pl group by all),
pk as (select *, row_number() over (partition by dataset order by s desc, p_id) k from pa),
st as (with recursive g as (select distinct dataset, 0 k, []::struct(t int, z double, y double, x double)[] near, []::bigint[] used, null::bigint p_id, null::bigint d2_id, null::double score, null::int t from pk
 union all select dataset, k, case when pick is null then near else list_append(near, struct_pack(t := t, z := p_z, y := p_y, x := p_x)) end, case when pick is null then used else list_append(used, pick) end, p_id, pick, s, t
 from (select g.dataset, pk.k, near, used, pk.p_id, pk.t, p_z, p_y, p_x, s, case when len(list_filter(near, lambda a: abs(a.t - pk.t) <= 1 and {_NEAR.format(p="pk")})) = 0 then list_filter(ds, lambda v: not list_contains(used, v))[1] end pick
  from g join pk on pk.dataset = g.dataset and pk.k = g.k + 1)) select * from g)
select dataset, t, p_id, d2_id, score from st where d2_id is not null"""


@query
def fork_choice_probability(spark, d):
    """Each fork candidate's probability among those for the same daughter, none being a choice too."""
    rows = forks(spark, d).where("d2_id is not null and mirror_um is not null and angle_deg is not null and not isnan(mirror_um) and not isnan(angle_deg)")
    return dv.conditional_logit(rows, F.col("angle_deg") / 90 - F.col("mirror_um")).select("fork_id", F.round("prob", 6).alias("prob"))


SQL["fork_choice_probability"] = """with f as (select distinct fork_id, dataset, p_id, d1_id, d2_id, shape, angle_deg, mirror_um, score, label from forks),
u as (select *, exp(angle_deg / 90 - mirror_um) v from f where d2_id is not null and mirror_um is not null and angle_deg is not null and not isnan(mirror_um) and not isnan(angle_deg) and dataset is not null)
select fork_id, round(v / (1 + sum(v) over (partition by dataset, d2_id)), 6) prob from u"""


# ---- gaps ----------------------------------------------------------------------------------------------------------


def _gap_pairs(spark, d, most_um=10.0, frames=2):
    n, l = kept(spark, det(spark, d), forest(spark, d))
    role = ln.ends_of_tracks(n, l)
    ends, starts = (n.join(role.where(F.col("kind") == k).select("node_id"), "node_id", "left_semi") for k in ("end", "start"))
    return n, l, spatial.radius_pairs(ends, starts, most_um, frames)


@query
def gap_candidates(spark, d):
    """Ends of tracks and starts two frames later within 10 micrometres."""
    return _gap_pairs(spark, d)[2].select("a_id", "b_id", F.round("um", 6).alias("um"))


@query
def gap_candidates_by_density(spark, d):
    """Ends of tracks and starts two frames later within a gate that follows the local spacing of detections."""
    n, _, pairs = _gap_pairs(spark, d, 10.25)
    return repair.within_gap_gate(pairs, n).select("a_id", "b_id", F.round("um", 6).alias("um"))


GA = f"""en as (select * from n where node_id not in (select source_id from fo) and node_id in (select target_id from fo)),
sta as (select * from n where node_id in (select source_id from fo) and node_id not in (select target_id from fo)),
ga as (select a.dataset, a.t, a.node_id a_id, b.node_id b_id, {_um("a", "b")} um from en a join sta b on a.dataset = b.dataset and b.t = a.t + 2 where {_um("a", "b")} <= 10)"""
SQL["gap_candidates"] = BASE + f", {GA} select a_id, b_id, round(um, 6) um from ga"
SQL["gap_candidates_by_density"] = BASE + f""", {GA.replace("<= 10)", "<= 10.25)")}, {PAIRS(1e300, 0, "and a.node_id <> b.node_id")}, k3 as (select * from pairs qualify row_number() over (partition by a_id order by um, b_id) <= 3),
sp as (select node_id, coalesce(median(k3.um), 6.5) s from n left join k3 on a_id = node_id group by 1)
select a_id, b_id, round(um, 6) um from ga join sp x on x.node_id = a_id join sp y on y.node_id = b_id where um <= 10 + 2 * least(0.125, greatest(-0.125, 0.04::double * ((x.s + y.s) / 2 - 6.5)))"""


@query
def closed_gaps(spark, d):
    """Ends and starts matched over one missing frame, with the nearest free detection at the middle, or none."""
    n, l, pairs = _gap_pairs(spark, d, 10.25)
    pairs = repair.within_gap_gate(pairs, n)
    (taken,) = kept(spark, matching.assignment(pairs).join(pairs.select("a_id", "b_id", "dataset", "t", *[F.col(f"{p}_{c}") for p in "ab" for c in AXES]), ["a_id", "b_id"]))
    role = ln.ends_of_tracks(n, l)
    free = n.join(role.where("kind = 'isolated'").select("node_id"), "node_id", "left_semi")
    middle = taken.select("dataset", "t", F.col("a_id").alias("node_id"), *[((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(c) for c in AXES])
    near = spatial.radius_pairs(middle, free, 3.2).select("dataset", "t", F.col("a_id"), F.col("b_id").alias("middle_id"), "um")
    got = matching.greedy_matching(near, "a_id", "middle_id").select("a_id", "middle_id")
    return taken.join(got, "a_id", "left").select("dataset", "t", "a_id", "b_id", "middle_id", *[((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(f"mid_{c}") for c in AXES])


@query
def gap2_candidates(spark, d):
    """Ends and starts three frames later that may belong together."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    return repair.two_frame_gaps(n, l).select("a_id", "b_id", F.round("um", 6).alias("um"), F.round("cost", 6).alias("cost"))


def _steps(p: str) -> str:
    return f"""case when not ({p}n <= 0.01 or sn <= 0.01) then ({p}z * sz + {p}y * sy + {p}x * sx) / ({p}n * sn + 1e-9) end {p}cos, ({p}n <= 0.01 or sn <= 0.01) {p}still,
 sqrt(({p}z - sz) ** 2 + ({p}y - sy) ** 2 + ({p}x - sx) ** 2) {p}off"""


G2 = f""", en as (select * from n where node_id not in (select source_id from fo) and node_id in (select target_id from fo)),
sta as (select * from n where node_id in (select source_id from fo) and node_id not in (select target_id from fo)),
g0 as (select a.dataset, a.t, a.z az, a.y ay, a.x ax, b.z bz, b.y by_, b.x bx, a.node_id a_id, b.node_id b_id, {_um("a", "b")} um, (b.z - a.z) * 1.625 / 3 sz, (b.y - a.y) * 0.40625 / 3 sy, (b.x - a.x) * 0.40625 / 3 sx,
 (a.z - p.z) * 1.625 lz, (a.y - p.y) * 0.40625 ly, (a.x - p.x) * 0.40625 lx, (q.z - b.z) * 1.625 nz, (q.y - b.y) * 0.40625 ny, (q.x - b.x) * 0.40625 nx
 from en a join sta b on a.dataset = b.dataset and b.t = a.t + 3 left join (select target_id, min(source_id) s from fo group by 1) f on f.target_id = a.node_id left join n p on p.node_id = f.s
 left join (select source_id, min(target_id) g from fo group by 1) h on h.source_id = b.node_id left join n q on q.node_id = h.g where {_um("a", "b")} <= 10.2 and {_um("a", "b")} / 3 <= 4.4),
g1 as (select *, sqrt(sz * sz + sy * sy + sx * sx) sn, sqrt(lz * lz + ly * ly + lx * lx) ln, sqrt(nz * nz + ny * ny + nx * nx) nn from g0),
g2 as (select *, {_steps("l")}, {_steps("n")} from g1),
g3 as (select *, um + 2 * (coalesce(greatest(0.0, 0.25 - lcos), 0) + coalesce(greatest(0.0, 0.25 - ncos), 0)) as cost from g2
where coalesce(lstill or (lcos > -0.25 and loff <= 6), false) or coalesce(nstill or (ncos > -0.25 and noff <= 6), false))"""
SQL["gap2_candidates"] = BASE + G2 + " select a_id, b_id, round(um, 6) um, round(cost, 6) as cost from g3"


@query
def gap2_recovered(spark, d):
    n, l = kept(spark, det(spark, d), forest(spark, d))
    rows = repair.recover_two_frame_gaps(n, l)
    return rows.select("dataset", "t", "a_id", "b_id", *[F.round(f"m{k}_{c}", 6).alias(f"m{k}_{c}") for k in (1, 2) for c in AXES])


SQL["gap2_recovered"] = BASE + G2 + f""", {_greedy("g3", "cost")}, fcap as (select dataset, t, greatest(1, round_even(count(*) * 0.006::double, 0)) cap from en group by all),
dcap as (select dataset, least(180, greatest(1, round_even(count(*) * 0.0045::double, 0))) cap from fo group by 1),
k1 as (select * from (select g3.*, row_number() over (partition by g3.dataset, g3.t order by cost, a_id, b_id) k from g3 join gl using (a_id, b_id)) join fcap using (dataset, t) where k <= cap),
k2 as (select * from (select k1.* exclude (cap), row_number() over (partition by dataset order by cost, a_id, b_id) j from k1) join dcap using (dataset) where j <= cap)
select dataset, t, a_id, b_id, """ + ", ".join(f"round({a} + ({b} - {a}) * {k} / 3, 6) m{k}_{c}" for k in (1, 2) for c, a, b in (("z", "az", "bz"), ("y", "ay", "by_"), ("x", "ax", "bx"))) + " from k2"


@query
def filled_gaps(spark, d):
    """Gaps of one to three frames joined through detections of no track."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    tracked = ln.prune_isolated(n, l)
    return repair.fill_gaps(tracked, l, n.join(tracked, "node_id", "left_anti"))


@query
def readmitted_detections(spark, d):
    """Detections of no track that lie near an open end, away from all tracks."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    tracked = ln.prune_isolated(n, l)
    return repair.readmit(tracked, l, n.join(tracked, "node_id", "left_anti")).select("node_id", "dataset", "t")


SQL["readmitted_detections"] = BASE + f""", tk as (select * from n where node_id in (select source_id from fo union select target_id from fo)), pk as (select * from n where node_id not in (select node_id from tk))
select node_id, dataset, t from pk where not exists (select 1 from tk b where b.dataset = pk.dataset and b.t = pk.t and {_um("pk", "b")} <= 2.0)
 and (exists (select 1 from tk a where a.dataset = pk.dataset and pk.t = a.t + 1 and {_um("a", "pk")} <= 4.0 and a.node_id not in (select source_id from fo))
  or exists (select 1 from tk b where b.dataset = pk.dataset and b.t = pk.t + 1 and {_um("pk", "b")} <= 4.0 and b.node_id not in (select target_id from fo)))"""


@query
def stolen_daughters(spark, d):
    """Forks whose second daughter is another node's only child, a long step away from it."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    return repair.stolen_daughters(n, l, l.select(F.col("source_id").alias("q_id"), F.col("um").alias("error_um")), least_error=1.5).select("p_id", "d1_id", "d2_id", "q_id")


SQL["stolen_daughters"] = BASE + f""", ch as (select source_id, min(target_id) target_id, min(um) um from fo group by 1 having count(*) = 1)
select p.node_id p_id, d1.node_id d1_id, d2.node_id d2_id, q.source_id q_id from ch c join n p on p.node_id = c.source_id join n d1 on d1.node_id = c.target_id
 join n d2 on d2.dataset = p.dataset and d2.t = p.t + 1 join ch q on q.target_id = d2.node_id
 where d1.node_id <> d2.node_id and q.um >= 1.5 and {_um("p", "d2")} <= 12 and {_um("d1", "d2")} <= 16 and {_um("p", "d1")} * {_um("p", "d2")} > 1e-8 and
 degrees(acos(greatest(-1.0, least(1.0, ((d1.z - p.z) * 1.625 * ((d2.z - p.z) * 1.625) + (d1.y - p.y) * 0.40625 * ((d2.y - p.y) * 0.40625) + (d1.x - p.x) * 0.40625 * ((d2.x - p.x) * 0.40625)) / ({_um("p", "d1")} * {_um("p", "d2")}))))) >= 80"""


@query
def stolen_daughters_by_motion(spark, d):
    """Forks whose second daughter is another node's only child, 3 micrometres or more from where that node's last step leads."""
    n, l = kept(spark, det(spark, d), forest(spark, d))
    return repair.stolen_daughters(n, l, repair.motion_errors(n, l)).select("p_id", "d1_id", "d2_id", "q_id")


SQL["stolen_daughters_by_motion"] = SQL["stolen_daughters"].replace("select p.node_id p_id, d1.node_id d1_id", f""", er as (select q.node_id q_id, sqrt(((c.z - (q.z + coalesce(q.z - o.z, 0))) * 1.625) ** 2 + ((c.y - (q.y + coalesce(q.y - o.y, 0))) * 0.40625) ** 2 + ((c.x - (q.x + coalesce(q.x - o.x, 0))) * 0.40625) ** 2) error_um
 from ch join n q on q.node_id = ch.source_id join n c on c.node_id = ch.target_id left join fo on fo.target_id = q.node_id left join n o on o.node_id = fo.source_id)
select p.node_id p_id, d1.node_id d1_id""", 1).replace("q.um >= 1.5", "q.source_id in (select q_id from er where error_um >= 3)")


@query
def applied_forks(spark, d):
    """The forest before divisions, with the rule-based divisions that its parents and daughters allow."""
    scratch = Scratch(spark, "lineage", tidy=True)
    # no column of a detection is null; said beforehand, the filter and so the shuffle is the same one in every join
    n = scratch.keep(det(spark, d), "detections").where(" and ".join(f"{c} is not null" for c in ("dataset", "node_id", "t", *AXES)))
    l = scratch.keep(ln.bare_forest(edges(spark, d).where(BEFORE_DIVISIONS), n), "links")
    safe = dv.safe_divisions(n, l, least_gain=0.25, children=l.where("only"))
    for key, order in (("d2_id", ("score", "p_id")), ("p_id", ("score", "d2_id"))):
        safe = safe.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("k = 1")
    adds = scratch.keep(safe, "additions")
    before = l.select("dataset", "t", "source_id", "target_id", F.lit(0).alias("safe_division"))
    return repair.apply_forks(before, adds.select("dataset", "t", "p_id", "d2_id"), adds.limit(0).select("p_id", "d2_id"))


SQL["applied_forks"] = PRE + f""", {CA}, {SD}, a1 as (select * from sd qualify row_number() over (partition by d2_id order by score, p_id) = 1), a2 as (select * from a1 qualify row_number() over (partition by p_id order by score, d2_id) = 1)
select dataset, t, source_id, target_id, 0 safe_division from fo union all select dataset, t, p_id, d2_id, 1 from a2"""


def _probabilities(spark, d):
    """(source_id, target_id, prob): the learned probability of each link that has one."""
    # the highest of repeated deliveries is the same as of single ones
    return edges(spark, d).where("edge_prob is not null").groupBy("source_id", "target_id").agg(F.max(clean_probability(F.col("edge_prob"))).alias("prob"))


def _with_probabilities(spark, d):
    """Detections, and the learned probabilities with the dataset and t of their source, both written."""
    (n,) = kept(spark, det(spark, d))
    return n, *kept(spark, relink.placed(n, _probabilities(spark, d)))


def _seed_kinds(n, probs):
    return tr.kinds(tr.frozen(n), relink.seed_steps(n, probs))


@query
def seed_transition_kinds(spark, d):
    """The kinds of transitions by the steps of seed matches; transition_kinds has them by the steps of links."""
    n, probs = _with_probabilities(spark, d)
    return _seed_kinds(n, probs)


@query
def relinked(spark, d):
    """Links by motion, with the learned probabilities as a bonus and the shifts of jumps as a prior; of all movies, however crowded."""
    n, probs = _with_probabilities(spark, d)
    return relink.relink(n, probs, _seed_kinds(n, probs))


# ---- smoothing -----------------------------------------------------------------------------------------------------


def _shifts(l: DataFrame, kinds: DataFrame) -> DataFrame:
    """The median step of each jump, in micrometres."""
    steps = l.join(kinds.where("kind = 'jump'").select("dataset", "t"), ["dataset", "t"], "left_semi")
    return steps.groupBy("dataset", "t").agg(*[F.median((F.col(f"g_{c}") - F.col(f"s_{c}")) * spatial.SCALE[c]).alias(f"d{c}") for c in AXES])


@query
def line_fit(spark, d):
    n, l = kept(spark, det(spark, d), forest(spark, d))
    return smoothing.line_fit(n, l).select("node_id", *[F.round(c, 6).alias(c) for c in AXES])


STEP = lambda here, there, sign: f"""w{'f' if sign > 0 else 'b'} as (select {here} here, min({there}) there, min(t) t from fo group by 1 having count(*) = 1)"""
SQL["line_fit"] = BASE + f""", {STEP("source_id", "target_id", 1)}, {STEP("target_id", "source_id", -1)},
pt as (select node_id, 0 dt, z, y, x from n
 union all select here, 1, z, y, x from wf join n on node_id = there union all select a.here, 2, z, y, x from wf a join wf b on b.here = a.there join n on node_id = b.there
 union all select here, -1, z, y, x from wb join n on node_id = there union all select a.here, -2, z, y, x from wb a join wb b on b.here = a.there join n on node_id = b.there),
ft as (select node_id, regr_intercept(z, dt) fz, regr_intercept(y, dt) fy, regr_intercept(x, dt) fx from pt group by 1 having count(*) >= 3)
select node_id, round(coalesce(0.2 * z + 0.8 * fz, z), 6) z, round(coalesce(0.2 * y + 0.8 * fy, y), 6) y, round(coalesce(0.2 * x + 0.8 * fx, x), 6) x from n left join ft using (node_id)"""


def _smooth(spark, d):
    n, probs = _with_probabilities(spark, d)
    (l,) = kept(spark, forest(spark, d))
    (k,) = kept(spark, _seed_kinds(n, probs))
    return n, l, k, smoothing.line_fit(n, l, k, _shifts(l, k))


@query
def line_fit_over_jumps(spark, d):
    """Smoothing that stops at frozen transitions and takes the shift out of jumps."""
    return _smooth(spark, d)[3].select("node_id", *[F.round(c, 6).alias(c) for c in AXES])


@query
def frozen_consensus(spark, d):
    """One place for nuclei linked across frozen transitions, after smoothing."""
    n, l, k, smooth = _smooth(spark, d)
    (smooth,) = kept(spark, smooth)
    return smoothing.consensus(smooth, n, l, k).select("node_id", "moved", *[F.round(c, 6).alias(c) for c in AXES])


# ---- tracks --------------------------------------------------------------------------------------------------------


def _tracks(spark, d, l: DataFrame) -> DataFrame:
    """(node_id, root, depth, size): the tree of each linked node."""
    scratch = Scratch(spark, "tracks")
    none = F.lit(None).cast("long")
    v = l.select(F.col("target_id").alias("v"), F.col("source_id").alias("p")).unionByName(l.select(F.col("source_id").alias("v"), none.alias("p"))).groupBy("v").agg(F.max("p").alias("p"))
    return nested_sets(v, scratch).select(F.col("v").alias("node_id"), "root", "depth", "size")


@query
def components(spark, d):
    """The track (tree) of each node of the forest, named by its first node."""
    (l,) = kept(spark, forest(spark, d))
    return _tracks(spark, d, l).select("node_id", F.col("root").alias("component"), F.least("depth", F.lit(10)).cast("int").alias("steps_back"))


TREE = """tree as (with recursive r(node_id, component, depth) as (select distinct source_id, source_id, 0 from fo where source_id not in (select target_id from fo)
 union all select target_id, component, depth + 1 from r join fo on fo.source_id = r.node_id) select * from r)"""
SQL["components"] = BASE + f", {TREE} select node_id, component, least(depth, 10)::int steps_back from tree"


@query
def short_track_filter(spark, d):
    """Tracks that stay: long ones, those with a fork, and short ones good enough for the rescue budget of their dataset."""
    (l,) = kept(spark, forest(spark, d))
    (tree,) = kept(spark, _tracks(spark, d, l))
    rows = repair.tracks_that_stay(tree, l)
    return rows.select("dataset", F.col("root").alias("component"), F.col("n").cast("int").alias("n_nodes"), "why")


SQL["short_track_filter"] = BASE + f""", {TREE}, fk as (select source_id from fo group by 1 having count(*) > 1),
cp as (select component root, max(dataset) dataset, count(*) n, bool_or(node_id in (from fk)) fork, avg(case when target_id is not null then coalesce(edge_prob, 0) end) prob, avg(um) um from tree left join fo on target_id = node_id group by 1),
sm as (select dataset, sum(n) al, coalesce(sum(n) filter (n >= 6 or fork), 0) kp from cp group by 1),
bu as (select dataset, least(120, floor(al * 0.012::double))::int budget from sm where kp > 0 and al - kp >= 0.1::double * al),
po as (select cp.*, row_number() over (partition by dataset order by round(prob - 0.02 * um + 0.004 * n, 9) desc, root) k from cp join bu using (dataset) where n < 6 and not fork and n in (4, 5) and prob >= 0.88 and um <= 3.0),
re as (with recursive g as (select dataset, 0 k, budget, []::bigint[] got from bu union all select g.dataset, g.k + 1, case when n <= budget then budget - n else budget end, case when n <= budget then list_append(got, root) else got end
 from g join po on po.dataset = g.dataset and po.k = g.k + 1) select unnest(got) root from (select * from g qualify row_number() over (partition by dataset order by k desc) = 1))
select dataset, root component, n::int n_nodes, case when n >= 6 or fork then 'kept' when kp = 0 then 'unchanged' else 'rescued' end why from cp join sm using (dataset) where n >= 6 or fork or kp = 0 or root in (from re)"""
