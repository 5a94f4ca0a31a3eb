"""Edits of divisions: which forks a lineage graph gains and loses, and the graph after that.

The hook at the end chains them: forks are enumerated, filtered, scored by a function that the caller passes in, chosen,
capped and applied. Greedy choices are rounds over all datasets at once with the result of the sequential order.

A candidate has dataset, t, shape (a: the second daughter is a detection without parent; d: it is only a detector's peak,
its d2_id being -id - 1), p_id, d1_id, d2_id, the places p_z.. and d2_z.., and the geometry of the fork.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, angle, distance, mirror_distance
from stemline.operators.divisions import choose_forks, fork_candidates, only_children, safe_divisions, top_within
from stemline.operators.lineage import next_free_id, track_lengths
from stemline.operators.matching import greedy_matching
from stemline.operators.spatial import nearest_anywhere, radius_pairs
from stemline.store import Scratch

#: Least score of a peak, its distance from all detections, and the bounds of a fork with one (micrometres, degrees).
LOW_SCORE, PEAK_FREE, PEAK_REACH, PEAK_SISTER, PEAK_ANGLE = 0.3, 3.0, 9.0, 16.0, 90.0
#: Parts of a frame's detections and of a dataset's links that additions may make up.
FRAME_PART, EDGE_PART = 0.0076, 0.00375
#: Fixed value: what a fork with a peak has to make up for in mirror distance.
PEAK_PENALTY = 1000.0
PLACES = [f"{p}_{c}" for p in ("p", "d1", "d2") for c in AXES]


def low_peaks(peaks: DataFrame, least: float = LOW_SCORE) -> DataFrame:
    """(dataset, t, node_id, z, y, x, score) of peaks that are good enough; a null or NaN score is none."""
    return peaks.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least)).select("dataset", "t", "node_id", *AXES, "score")


def enumerate_forks(det: DataFrame, links: DataFrame, safe: DataFrame | None = None, peaks: DataFrame | None = None) -> DataFrame:
    """All fork candidates of both shapes, ranked by mirror distance for each parent.

    links: before divisions are added; safe(p_id, d2_id): the rule-based divisions beside them; peaks: as low_peaks gives them.
    """
    scratch = Scratch(det.sparkSession, "enumerate")
    at = lambda key, p: det.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in AXES])
    plain = fork_candidates(det, links).drop("mirror_rank").join(at("d1_id", "d1"), "d1_id").join(at("d2_id", "d2"), "d2_id")
    rows = plain.withColumns({"shape": F.lit("a"), "low_score_d2": F.lit(None).cast("double")})
    if peaks is not None:
        there = det.join(peaks.select("dataset", "t").distinct(), ["dataset", "t"], "left_semi")
        beside = radius_pairs(peaks, there, PEAK_FREE, 0).where(F.col("um") < PEAK_FREE).select(F.col("a_id").alias("node_id")).distinct()
        free = scratch.keep(peaks.join(beside, "node_id", "left_anti"), "peaks")
        children = only_children(links).where(F.col("um") <= 12.0)
        parents = det.join(children.select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
        near = radius_pairs(parents, free, PEAK_REACH).withColumnsRenamed({"a_id": "p_id", "b_id": "peak", "um": "p_d2_um"} | {f"a_{c}": f"p_{c}" for c in AXES} | {f"b_{c}": f"d2_{c}" for c in AXES})
        near = near.join(children.select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d1_id"), F.col("um").alias("p_d1_um")), "p_id").join(at("d1_id", "d1"), "d1_id")
        near = near.withColumns({"sister_um": distance("d1_", "d2_"), "angle_deg": angle("d1_", "p_", "d2_"), "mirror_um": mirror_distance("p_", "d1_", "d2_")})
        near = near.where((F.col("sister_um") <= PEAK_SISTER) & ~F.isnan("angle_deg") & (F.col("angle_deg") >= PEAK_ANGLE))
        near = near.join(free.select(F.col("node_id").alias("peak"), F.col("score").alias("low_score_d2")), "peak")
        ratio = F.least("p_d1_um", "p_d2_um") / F.greatest("p_d1_um", "p_d2_um", F.lit(1e-6))
        near = near.withColumns({"d2_id": -F.col("peak") - 1, "shape": F.lit("d"), "len_ratio": ratio, "t2_gain_um": F.lit(None).cast("double")})
        rows = rows.unionByName(near.select(*rows.columns))
    rank = (F.row_number().over(W.partitionBy("p_id").orderBy("mirror_um", "shape", "d2_id")) - 1).cast("int")
    rows = rows.withColumn("mirror_rank", rank)
    lengths = scratch.keep(track_lengths(links), "lengths")
    for key, kept, name in (("p_id", "back", "p_back_len"), ("d1_id", "forward", "d1_fwd_len"), ("d2_id", "forward", "d2_fwd_len")):
        rows = rows.join(lengths.select(F.col("node_id").alias(key), F.col(kept).alias(name)), key, "left").fillna(0, [name])
    mine = (safe if safe is not None else rows.limit(0)).select("p_id", "d2_id").distinct()
    rows = rows.join(mine.withColumn("own", F.lit(True)), ["p_id", "d2_id"], "left")
    for key in ("p_id", "d2_id"):
        rows = rows.join(mine.select(key, F.lit(True).alias(f"{key}_used")).distinct(), key, "left")
    other = lambda c: (F.coalesce(c, F.lit(False)) & F.col("own").isNull()).cast("int")
    rows = rows.withColumns({"in_safe_div": F.col("own").isNotNull().cast("int"), "p_in_safe_div": other("p_id_used"), "d2_in_safe_div": other("d2_id_used")})
    return rows.drop("own", "p_id_used", "d2_id_used")


def edit_filter(cands: DataFrame, most_mirror: float | None = None, least_pd2: float | None = None, most_pd2: float | None = None, least_angle: float | None = None) -> DataFrame:
    """Candidates of shape a within bounds (a null or NaN measure fails one that is set), and all safe divisions."""
    ok = F.col("shape") == "a"
    for c, bound, below in (("mirror_um", most_mirror, True), ("p_d2_um", least_pd2, False), ("p_d2_um", most_pd2, True), ("angle_deg", least_angle, False)):
        if bound is not None:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & ((F.col(c) <= bound) if below else (F.col(c) >= bound))
    return cands.where((F.col("in_safe_div") == 1) | ok)


def with_probabilities(cands: DataFrame, probs: DataFrame) -> DataFrame:
    """With prob_p_d1, prob_p_d2 and whether they were observed, for probs(source_id, target_id, prob); none for peaks."""
    for d in ("d1", "d2"):
        known = probs.groupBy(F.col("source_id").alias("p_id"), F.col("target_id").alias(f"{d}_id")).agg(F.max("prob").alias(f"prob_p_{d}"))
        cands = cands.join(known, ["p_id", f"{d}_id"], "left").withColumn(f"prob_p_{d}_observed", F.col(f"prob_p_{d}").isNotNull().cast("int")).fillna({f"prob_p_{d}": 0.0})
    return cands


def add_gate_flag() -> Column:
    """Whether a candidate may be added: shape a, no safe division, seen by the model, a wide angle, daughters that move apart."""
    gain = F.coalesce(F.nanvl("t2_gain_um", F.lit(-1.0)), F.lit(-1.0))
    return (F.col("in_safe_div") == 0) & (F.col("shape") == "a") & (F.col("prob_p_d2_observed") == 1) & (F.col("angle_deg") >= 90) & ~F.isnan("angle_deg") & (gain > 0)


def with_surroundings(cands: DataFrame, det: DataFrame, links: DataFrame, around_um: float = 10.0) -> DataFrame:
    """With nearby_10um (other detections near D2) and broken_track_d2_um (how near a track other than the parent's ends, at t - 1 or t)."""
    scratch = Scratch(det.sparkSession, "surroundings")
    cands = scratch.keep(cands, "candidates")
    spots = cands.select("dataset", (F.col("t") + 1).alias("t"), F.col("d2_id").alias("node_id"), *[F.col(f"d2_{c}").alias(c) for c in AXES]).distinct()
    near = radius_pairs(spots, det, around_um, 0).groupBy(F.col("a_id").alias("d2_id")).agg(F.count("*").alias("n"))
    ended = scratch.keep(det.join(links.select(F.col("source_id").alias("node_id")).distinct(), "node_id", "left_anti"), "ended")
    # of two ends one at least is not the parent
    ends = nearest_anywhere(spots, ended, -1, 2).unionByName(nearest_anywhere(spots, ended, -2, 2)).select(F.col("a_id").alias("d2_id"), F.col("b_id").alias("end_id"), "um")
    broken = cands.select("p_id", "d2_id").distinct().join(scratch.keep(ends, "ends"), "d2_id").where("end_id <> p_id").groupBy("p_id", "d2_id").agg(F.min("um").alias("broken_track_d2_um"))
    rows = cands.join(near, "d2_id", "left").join(broken, ["p_id", "d2_id"], "left")
    others = F.coalesce("n", F.lit(0)) - (F.col("shape") != "d").cast("int")
    return rows.withColumn("nearby_10um", F.greatest(F.lit(0), others).cast("int")).drop("n")


def combined_scores(a: Column, b: Column, bl: Column, p_d1_um: Column, gate: Column, tau_add: float, tau_abl: float) -> dict[str, Column]:
    """The ways to make one score of a model's (a), a classifier's (b) and a conditional one (bl); gate: 1 where additions may go by a alone."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(a, F.lit(0.0))))
    both = F.sqrt(unit * bl)
    known = a.isNotNull() & b.isNotNull()
    return {
        "A": a, "B": b, "AND": F.when(known, F.least(a, b)), "OR": F.when(known, F.greatest(a, b)), "GEOM": p_d1_um, "BL": bl, "A_BL": both,
        "A_OR_BL": F.greatest(F.when(gate == 1, unit / tau_add).otherwise(0.0), both / tau_abl),
    }


def accept_by_score(score: Column, least: float) -> Column:
    """Whether a repair passes a detector's score: a missing score does, one below the threshold does not."""
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")) >= least, F.lit(True))


def capped_safe_divisions(det: DataFrame, links: DataFrame, frame_part: float = FRAME_PART, edge_part: float = EDGE_PART, **gates) -> DataFrame:
    """(dataset, t, p_id, d1_id, d2_id, score): rule-based divisions, the best first, each parent and daughter once.

    Budgets: max(1, part of the frame's parents of one child), then, frame after frame, max(1, part of the dataset's links).
    """
    scratch = Scratch(det.sparkSession, "safe")
    proposals = scratch.keep(safe_divisions(det, links, **gates), "proposals")
    taken = scratch.keep(greedy_matching(proposals, "p_id", "d2_id", "score"), "taken")
    parents = det.select("dataset", "t", "node_id").join(only_children(links).select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
    frame_cap = parents.groupBy("dataset", "t").agg(F.greatest(F.lit(1), F.bround(F.count("*") * frame_part)).alias("frame_cap"))
    cap = links.groupBy("dataset").agg(F.greatest(F.lit(1), F.bround(F.count("*") * edge_part)).alias("cap"))
    rows = taken.join(frame_cap, ["dataset", "t"])
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("dataset", "t").orderBy("score", "p_id", "d2_id"))).where("k <= frame_cap")
    rows = scratch.keep(rows, "in_frames")
    frames = rows.groupBy("dataset", "t").agg(F.max("k").alias("n"))
    before = frames.withColumn("before", F.sum("n").over(W.partitionBy("dataset").orderBy("t")) - F.col("n")).drop("n")
    return rows.join(before, ["dataset", "t"]).join(cap, "dataset").where(F.col("before") + F.col("k") <= F.col("cap")).select("dataset", "t", "p_id", "d1_id", "d2_id", "score")


def near_parents(places: DataFrame, frames: int = 1, radius_um: float = 10.0) -> DataFrame:
    """(p_id, other) of two different parents within so many frames and so near, both ways; places(dataset, t, p_id, p_z, p_y, p_x)."""
    at = places.select("dataset", "t", F.col("p_id").alias("node_id"), *[F.col(f"p_{c}").alias(c) for c in AXES]).distinct()
    out = None
    for k in range(-frames, frames + 1):
        pairs = radius_pairs(at, at, radius_um, k).where("a_id <> b_id").select(F.col("a_id").alias("p_id"), F.col("b_id").alias("other"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def spread_apart(rows: DataFrame, scratch: Scratch, frames: int = 1, radius_um: float = 10.0) -> DataFrame:
    """(p_id, d2_id) of forks that a greedy choice by rank takes: no parent or daughter twice, no two parents near each other.

    rows: dataset, t, p_id, d2_id, rank (orderable, the least first), p_z, p_y, p_x. Each round takes the forks that no open
    better one can bar, and closes what they bar.
    """
    keep = scratch.keep
    open_ = keep(rows.select("dataset", "t", "p_id", "d2_id", "rank", *[f"p_{c}" for c in AXES]), "open")
    near = keep(near_parents(open_, frames, radius_um), "near")
    taken = open_.limit(0).select("p_id", "d2_id")
    open_ = open_.select("p_id", "d2_id", "rank")
    while True:
        by_p = open_.groupBy("p_id").agg(F.min("rank").alias("of_p"))
        by_d = open_.groupBy("d2_id").agg(F.min("rank").alias("of_d"))
        by_near = near.join(by_p.withColumnRenamed("p_id", "other"), "other").groupBy("p_id").agg(F.min("of_p").alias("of_near"))
        best = open_.join(by_p, "p_id").join(by_d, "d2_id").where("rank = of_p and rank = of_d").join(by_near, "p_id", "left")
        picks = keep(best.where("of_near is null or rank < of_near").select("p_id", "d2_id"), "picks")
        if not picks.limit(1).count():
            return taken
        taken = taken.unionByName(picks)
        shut = near.join(picks.select(F.col("p_id").alias("other")), "other", "left_semi").select("p_id").union(picks.select("p_id")).distinct()
        open_ = keep(open_.join(shut, "p_id", "left_anti").join(picks.select("d2_id"), "d2_id", "left_anti"), "open")


def choose(cands: DataFrame, tau_add: float | None, tau_del: float | None, shapes: tuple[str, ...] = ("a", "d"), score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(additions, removals) among enumerated candidates with a score for each parent.

    A safe division below tau_del is removed. A parent at or above tau_add without one takes the free daughter with the
    least mirror distance, peaks only behind detections, and not near a fork that is kept or added before.
    """
    scratch = Scratch(cands.sparkSession, "choose")
    cands = scratch.keep(cands, "candidates")
    safe = cands.where("in_safe_div = 1").dropDuplicates(["p_id", "d2_id"])
    low = F.coalesce(F.nanvl(score, F.lit(None).cast("double")) < tau_del, F.lit(False)) if tau_del is not None else F.lit(False)
    removes, kept = safe.where(low), scratch.keep(safe.where(~low), "kept")
    if tau_add is None:
        return cands.limit(0), removes
    penalty = F.col("mirror_um") + F.when(F.col("shape") == "d", PEAK_PENALTY).otherwise(0.0)
    pool = cands.where((F.col("in_safe_div") == 0) & F.col("shape").isin(*shapes) & ~F.isnan(score)).join(kept.select("p_id").distinct(), "p_id", "left_anti")
    taken = choose_forks(pool.withColumn("mirror_um", penalty), tau_add, score=score, safe=kept)
    return scratch.keep(cands.where("in_safe_div = 0").join(taken.select("p_id", "d2_id"), ["p_id", "d2_id"], "left_semi"), "adds"), removes


def choose_stronger(cands: DataFrame, tau_add: float | None, tau_del: float | None, stolen: bool = False, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(additions, removals) by the other plan: candidates one by one, the strongest first.

    Of two safe divisions near each other the weaker is removed as well. A track that ends within 4 micrometres of a
    daughter bars it. stolen: daughters of other nodes (shape c) may be taken at a score of 0.95, where motion is off by 4
    micrometres (q_motion_error_um) and the probability better by 0.25 (prob_p_d2, prob_q_d2).
    """
    scratch = Scratch(cands.sparkSession, "stronger")
    cands = scratch.keep(cands.withColumn("rank", F.struct((-F.col(score)).alias("s"), F.col("p_id").alias("p"), F.col("d2_id").alias("d"))), "candidates")
    safe = cands.where("in_safe_div = 1").dropDuplicates(["p_id", "d2_id"])
    low = F.coalesce(F.nanvl(score, F.lit(None).cast("double")) < tau_del, F.lit(False)) if tau_del is not None else F.lit(False)
    kept = scratch.keep(safe.where(~low).join(spread_apart(safe.where(~low), scratch), ["p_id", "d2_id"], "left_semi"), "kept")
    removes = safe.join(kept.select("p_id", "d2_id"), ["p_id", "d2_id"], "left_anti").drop("rank")
    if tau_add is None:
        return cands.limit(0).drop("rank"), removes
    ok = F.col("shape").isin("a", "d") & ~(F.coalesce(F.nanvl("broken_track_d2_um", F.lit(None).cast("double")) <= 4, F.lit(False)))
    if stolen:
        better = (F.col("q_motion_error_um") >= 4) & (F.col("prob_p_d2") - F.coalesce("prob_q_d2", F.lit(1.0)) >= 0.25)
        ok = F.coalesce(F.col("broken_track_d2_um") > 4, F.lit(True)) & (F.col("shape").isin("a", "d") | ((F.col("shape") == "c") & (F.col(score) >= max(tau_add, 0.95)) & better))
    pool = cands.where((F.col("in_safe_div") == 0) & (F.col(score) >= tau_add) & ~F.isnan(score) & ok)
    both = near_parents(pool.select("dataset", "t", "p_id", *[f"p_{c}" for c in AXES]).unionByName(kept.select("dataset", "t", "p_id", *[f"p_{c}" for c in AXES])))
    barred = both.join(kept.select(F.col("p_id").alias("other")), "other", "left_semi").select("p_id").union(kept.select("p_id")).distinct()
    pool = scratch.keep(pool.join(barred, "p_id", "left_anti").join(kept.select("d2_id").distinct(), "d2_id", "left_anti"), "pool")
    return scratch.keep(pool.join(spread_apart(pool, scratch), ["p_id", "d2_id"], "left_semi").drop("rank"), "adds"), removes


def cap_additions(adds: DataFrame, det: DataFrame, links: DataFrame, kept: DataFrame, scale: float = 1.0, score: str = "score") -> DataFrame:
    """Additions within what the safe divisions kept(dataset, t, p_id) leave of the budgets, the highest scores first.

    Budgets: max(1, part of the frame's detections) and max(1, part of the dataset's links before divisions).
    """
    frames = det.groupBy("dataset", "t").agg(F.greatest(F.lit(1), F.bround(F.count("*") * (FRAME_PART * scale))).alias("cap"))
    have = kept.groupBy("dataset", "t").agg(F.count("*").alias("have"))
    frames = frames.join(have, ["dataset", "t"], "left").select("dataset", "t", (F.col("cap") - F.coalesce("have", F.lit(0))).alias("cap"))
    sets = links.groupBy("dataset").agg(F.greatest(F.lit(1), F.bround(F.count("*") * (EDGE_PART * scale))).alias("cap"))
    sets = sets.join(kept.groupBy("dataset").agg(F.count("*").alias("have")), "dataset", "left").select("dataset", (F.col("cap") - F.coalesce("have", F.lit(0))).alias("cap"))
    order = [F.col(score).desc(), F.col("p_id"), F.col("d2_id")]
    return top_within(top_within(adds, frames, ["dataset", "t"], order), sets, ["dataset"], order)


def numbered_peaks(adds: DataFrame, det: DataFrame) -> DataFrame:
    """(p_id, d2_id, node_id, dataset, t, z, y, x): the new nodes of additions of shape d, with the next free ids by dataset, frame and parent."""
    new = adds.where("shape = 'd'").select("p_id", "d2_id", "dataset", (F.col("t") + 1).alias("t"), *[F.col(f"d2_{c}").alias(c) for c in AXES])
    sizes = new.groupBy("dataset").agg(F.count("*").alias("n"))
    before = sizes.select("dataset", (F.sum("n").over(W.orderBy("dataset")) - F.col("n")).alias("before"))  # one row for each dataset
    rank = F.row_number().over(W.partitionBy("dataset").orderBy("t", "p_id")) - 1
    rows = new.withColumn("k", rank).join(before, "dataset").crossJoin(F.broadcast(next_free_id(det)))  # one row
    return rows.select("p_id", "d2_id", (F.col("next_id") + F.col("before") + F.col("k")).alias("node_id"), "dataset", "t", *AXES)


def apply_edits(det: DataFrame, links: DataFrame, adds: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links after forks are added and safe ones removed, and the new nodes of peaks.

    links(dataset, t, source_id, target_id, safe_division). Errors: a removal that is not there, a daughter that is absent
    or has a parent, a parent without exactly one child.
    """
    scratch = Scratch(det.sparkSession, "apply")
    new_nodes = scratch.keep(numbered_peaks(adds, det), "nodes")
    drop = removes.select(F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id"))
    pair = ["source_id", "target_id"]
    absent = drop.join(links.where("safe_division = 1"), pair, "left_anti")
    left = links.join(drop.withColumn("gone", F.lit(True)), pair, "left").where("gone is null or coalesce(safe_division, 0) <> 1").drop("gone")
    left = scratch.keep(left.select("dataset", "t", *pair, F.coalesce("safe_division", F.lit(0)).alias("safe_division"), F.lit(0).alias("learned_division")), "left")
    named = adds.join(new_nodes.select("p_id", "d2_id", "node_id"), ["p_id", "d2_id"], "left")
    new = named.select("dataset", "t", F.col("p_id").alias("source_id"), F.coalesce("node_id", "d2_id").alias("target_id"), F.lit(1).alias("safe_division"), F.lit(1).alias("learned_division"), "shape")
    new = scratch.keep(new, "new")
    nowhere = new.where("shape <> 'd'").join(det.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    parented = new.join(left.select("target_id"), "target_id", "left_semi").select("target_id").union(new.groupBy("target_id").count().where("count > 1").select("target_id"))
    wrong = new.join(left.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").where("coalesce(n, 0) <> 1").select("source_id").union(new.groupBy("source_id").count().where("count > 1").select("source_id"))
    for rows, what in ((absent, "removals that are not there"), (nowhere, "daughters that are absent"), (parented, "daughters that have a parent"), (wrong, "parents without exactly one child")):
        if (k := rows.count()) > 0:
            raise ValueError(f"{k} {what}")
    return left.unionByName(new.drop("shape")), new_nodes.select("dataset", "node_id", "t", *AXES)


def division_hook(
    det: DataFrame, before: DataFrame, safe: DataFrame, score_fn: Callable[[DataFrame, DataFrame, DataFrame, DataFrame | None], DataFrame], tau_add: float | None, tau_del: float | None,
    geometry: dict | None = None, cap_scale: float | None = 1.0, cache_fn: Callable[[], DataFrame] | None = None, score: str = "score",
) -> tuple[DataFrame, DataFrame]:
    """The links after learned divisions are added and doubtful safe ones removed, and a log (dataset, candidates, adds_before_cap, adds, removes).

    before: links without divisions (with um); safe(dataset, t, p_id, d2_id): the rule-based divisions beside them. score_fn
    takes candidates, detections, these links and what cache_fn gives, and returns the candidates with a score column; a
    negative or null score is never added. cap_scale: of the budgets, None for no budget. No node is added.
    """
    scratch = Scratch(det.sparkSession, "hook")
    cache = cache_fn() if cache_fn is not None else None
    cands = edit_filter(enumerate_forks(det, before, safe), **(geometry or {}))
    scored = score_fn(scratch.keep(cands, "candidates"), det, before, cache)
    if score not in scored.columns:
        raise ValueError(f"the scorer gives no {score}")
    scored = scratch.keep(scored, "scored")
    adds, removes = choose(scored, tau_add, tau_del, ("a",), score)
    removes, chosen = scratch.keep(removes.select("dataset", "t", "p_id", "d2_id"), "removes"), adds
    if cap_scale is not None:
        kept = safe.join(removes.select("p_id", "d2_id"), ["p_id", "d2_id"], "left_anti")
        adds = scratch.keep(cap_additions(adds, det, before, kept, cap_scale, score), "capped")
    pair = lambda rows, flag: rows.select("dataset", "t", "source_id", "target_id", F.lit(flag).alias("safe_division"))
    links = pair(before, 0).unionByName(pair(safe.select("dataset", "t", F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id")), 1))
    out, _ = apply_edits(det, links, adds, removes)
    count = lambda rows, name: rows.groupBy("dataset").agg(F.count("*").alias(name))
    log = det.select("dataset").distinct()
    for rows, name in ((scored, "candidates"), (chosen, "adds_before_cap"), (adds, "adds"), (removes, "removes")):
        log = log.join(count(rows, name), "dataset", "left")
    return out, log.fillna(0)


def replay(det: DataFrame, links: DataFrame, decisions: DataFrame, plan: str, tolerance: float = 1e-3) -> DataFrame:
    """The links after recorded decisions of one plan in place of scores.

    decisions(dataset, plan, action (add, remove), p_id, p_t, p_z.., d2_id, d2_t, d2_z..): each must name nodes that are
    where they were, within the tolerance, else it is an error. links as for apply_edits.
    """
    mine = decisions.where(F.col("plan") == plan)
    for p in ("p", "d2"):
        at = det.select("dataset", F.col("node_id").alias(f"{p}_id"), F.col("t").alias("_t"), *[F.col(c).alias(f"_{c}") for c in AXES])
        off = F.col("_t").isNull() | (F.col("_t") != F.col(f"{p}_t"))
        for c in AXES:
            off = off | (F.abs(F.col(f"_{c}") - F.col(f"{p}_{c}")) > tolerance)
        if k := mine.join(at, ["dataset", f"{p}_id"], "left").where(off).count():
            raise ValueError(f"{k} decisions do not fit their {p} nodes")
    rows = mine.withColumn("t", F.col("p_t")).withColumn("shape", F.lit("a"))
    return apply_edits(det, links, rows.where("action = 'add'"), rows.where("action = 'remove'"))[0]


def source_geometry(links: DataFrame, det: DataFrame, order: list[Column], most_parent: float = 10.5, most_sister: float = 8.0, single: bool = True) -> DataFrame:
    """Links whose sources keep their two best ones if these make a division by distance, else the best one (single) or all.

    Two links do if both are at most most_parent long, lead to the next frame, and their targets are at most most_sister apart.
    """
    at = lambda key, p: det.select(F.col("node_id").alias(key), F.col("t").alias(f"{p}_t"), *[F.col(c).alias(f"{p}_{c}") for c in AXES])
    ranked = links.withColumn("k", F.row_number().over(W.partitionBy("source_id").orderBy(*order)))
    place = at("target_id", "g").select("target_id", F.col("g_t").alias("at_t"), *[F.col(f"g_{c}").alias(f"at_{c}") for c in AXES])
    two = ranked.where("k <= 2").join(place, "target_id")
    one, other = (two.where(F.col("k") == k).select("source_id", F.col("t").alias("s_t"), F.col("um").alias(f"{p}um"), F.col("at_t").alias(f"{p}t"), *[F.col(f"at_{c}").alias(f"{p}{c}") for c in AXES]) for k, p in ((1, "a_"), (2, "b_")))
    both = one.join(other.drop("s_t"), "source_id")
    good = (F.greatest("a_um", "b_um") <= most_parent) & (distance("a_", "b_") <= most_sister) & (F.col("a_t") == F.col("s_t") + 1) & (F.col("b_t") == F.col("s_t") + 1)
    verdict = both.select("source_id", F.coalesce(good, F.lit(False)).alias("good"))
    rows = ranked.join(verdict, "source_id", "left")
    many = (F.col("k") <= 1) if single else F.lit(True)
    return rows.where(F.col("good").isNull() | (F.col("good") & (F.col("k") <= 2)) | (~F.col("good") & many)).drop("k", "good")
