"""Repairs of the lineage graph: gaps, discarded detections, forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.geometry import AXES, SCALE, angle, distance
from stemline.operators.divisions import only_children, top_within
from stemline.operators.lineage import ends_of_tracks
from stemline.operators.matching import assignment, greedy_matching
from stemline.operators.spatial import frame_spacing, nearest, radius_pairs
from stemline.store import Scratch


def open_ends(det: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections at which a track ends, at which one starts, and those of no track."""
    role = ends_of_tracks(det, links)
    of = lambda k: det.join(role.where(F.col("kind") == k).select("node_id"), "node_id", "left_semi")
    return of("end"), of("start"), of("isolated")


def _neighbour_steps(det: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """With l_z.. (the step into the end) and n_z.. (the step out of the start), micrometres, null without one."""
    at = lambda key, p: det.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    into = links.groupBy(F.col("target_id").alias("a_id")).agg(F.min("source_id").alias("_p")).join(at("_p", "_p_"), "_p").drop("_p")
    out = links.groupBy(F.col("source_id").alias("b_id")).agg(F.min("target_id").alias("_n")).join(at("_n", "_n_"), "_n").drop("_n")
    rows = pairs.join(into, "a_id", "left").join(out, "b_id", "left")
    for c in AXES:
        rows = rows.withColumn(f"l_{c}", (F.col(f"a_{c}") - F.col(f"_p_{c}")) * SCALE[c]).withColumn(f"n_{c}", (F.col(f"_n_{c}") - F.col(f"b_{c}")) * SCALE[c])
    return rows.drop(*[f"{p}{c}" for p in ("_p_", "_n_") for c in AXES])


def _norm(p: str) -> Column:
    return F.sqrt(sum((F.col(f"{p}{c}") * F.col(f"{p}{c}") for c in AXES), F.lit(0.0)))


def _context(rows: DataFrame, frames: int) -> DataFrame:
    """With cos and gap of the neighbouring steps to the step over the gap; cos is null where there is no step or no length."""
    for c in AXES:
        rows = rows.withColumn(f"s_{c}", (F.col(f"b_{c}") - F.col(f"a_{c}")) * SCALE[c] / frames)
    for p in "ln":
        dot = sum((F.col(f"{p}_{c}") * F.col(f"s_{c}") for c in AXES), F.lit(0.0))
        still = (_norm(f"{p}_") <= 0.01) | (_norm("s_") <= 0.01)
        rows = rows.withColumn(f"{p}_cos", F.when(~still, dot / (_norm(f"{p}_") * _norm("s_") + 1e-9))).withColumn(f"{p}_still", still)
        rows = rows.withColumn(f"{p}_off", F.sqrt(sum(((F.col(f"{p}_{c}") - F.col(f"s_{c}")) * (F.col(f"{p}_{c}") - F.col(f"s_{c}")) for c in AXES), F.lit(0.0))))
    return rows


def two_frame_gaps(det: DataFrame, links: DataFrame, most_um: float = 10.2, most_step: float = 4.4) -> DataFrame:
    """Ends and starts three frames later, near and in the direction of a neighbouring step; cost as they compete."""
    ends, starts, _ = open_ends(det, links)
    rows = _context(_neighbour_steps(det, links, radius_pairs(ends, starts, most_um, 3).where(F.col("um") / 3 <= most_step)), 3)
    fits = lambda p: F.coalesce(F.col(f"{p}_still") | ((F.col(f"{p}_cos") > -0.25) & (F.col(f"{p}_off") <= 6.0)), F.lit(False))
    bend = lambda p: F.coalesce(F.greatest(F.lit(0.0), 0.25 - F.col(f"{p}_cos")), F.lit(0.0))
    rows = rows.where(fits("l") | fits("n")).withColumn("cost", F.col("um") + 2.0 * (bend("l") + bend("n")))
    return rows.select("dataset", "t", "a_id", "b_id", "um", "cost", *[f"{p}_{c}" for p in "ab" for c in AXES])


def recover_two_frame_gaps(det: DataFrame, links: DataFrame, frame_part: float = 0.006, link_part: float = 0.0045, most: int = 180) -> DataFrame:
    """(dataset, t, a_id, b_id, m1_z.., m2_z..): the gaps that are closed, within budgets, and the two places between.

    Greedy by cost; budgets: max(1, part of the frame's ends), and min(most, max(1, part of the dataset's links)).
    """
    cands = Scratch(det.sparkSession, "gap2").keep(two_frame_gaps(det, links), "candidates")
    taken = greedy_matching(cands, cost="cost")
    ends = open_ends(det, links)[0].groupBy("dataset", "t").agg(F.greatest(F.lit(1), F.bround(F.count("*") * frame_part)).alias("frame_cap"))
    caps = links.groupBy("dataset").agg(F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.count("*") * link_part))).alias("cap"))
    order = ["cost", "a_id", "b_id"]
    rows = top_within(top_within(taken, ends.withColumnRenamed("frame_cap", "cap"), ["dataset", "t"], order), caps, ["dataset"], order)
    between = [(F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * k / 3).alias(f"m{k}_{c}") for k in (1, 2) for c in AXES]
    return rows.select("dataset", "t", "a_id", "b_id", *between)


def fill_gaps(det: DataFrame, links: DataFrame, peaks: DataFrame, longest: int = 3, step_um: float = 5.0, off_um: float = 3.5, part: float = 0.03) -> DataFrame:
    """(dataset, t, a_id, b_id, gap, peak_ids): ends and starts joined over one to three frames through a free peak in each.

    Every neighbouring step must point the same way (cos > -0.25). For each length, the shortest first, pairs are matched
    at least cost; of two that need one peak the cheaper stays. Peaks up to a part of the dataset's detections are used.
    peaks(dataset, t, node_id, z, y, x).
    """
    scratch = Scratch(det.sparkSession, "gapfill")
    ends, starts, _ = (scratch.keep(x, "ends") for x in open_ends(det, links))
    budget = det.groupBy("dataset").agg(F.floor(F.count("*") * part).alias("left"))
    done = None
    for g in range(1, longest + 1):
        rows = _context(_neighbour_steps(det, links, radius_pairs(ends, starts, step_um * (g + 1), g + 1)), g + 1)
        rows = rows.where("coalesce(l_cos > -0.25, true) and coalesce(n_cos > -0.25, true)")
        rows = scratch.keep(rows.select("dataset", "t", "a_id", "b_id", "um", *[f"{p}_{c}" for p in "ab" for c in AXES]).withColumn("pair", F.xxhash64("a_id", "b_id")), "pairs")
        way = rows.select("dataset", "pair", F.explode(F.sequence(F.lit(1), F.lit(g))).alias("k"), "t", *[f"{p}_{c}" for p in "ab" for c in AXES])
        spots = way.select("dataset", (F.col("t") + F.col("k")).alias("t"), F.struct("pair", "k").alias("node_id"), *[(F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("k") / (g + 1)).alias(c) for c in AXES])
        near = nearest(radius_pairs(spots, peaks, off_um, 0)).groupBy(F.col("a_id.pair").alias("pair")).agg(F.count("*").alias("n"), F.avg("um").alias("off"), F.sort_array(F.collect_list(F.struct("a_id.k", "b_id"))).alias("at")).where(F.col("n") == g)
        rows = scratch.keep(rows.join(near, "pair").select("dataset", "t", "a_id", "b_id", (F.col("um") / (g + 1) + F.col("off")).alias("cost"), F.col("at.b_id").alias("peak_ids")), "costs")
        taken = rows.join(assignment(rows.select("a_id", "b_id", "cost"), cost="cost").select("a_id", "b_id"), ["a_id", "b_id"], "left_semi")
        rank = F.struct("cost", "a_id", "b_id")
        uses = scratch.keep(taken.withColumn("rank", rank), "uses")
        first = uses.select("rank", F.explode("peak_ids").alias("peak")).withColumn("best", F.min("rank").over(W.partitionBy("peak")))
        lost = first.where("best < rank").select("rank").distinct()
        kept = uses.join(lost, "rank", "left_anti").join(budget, "dataset").withColumn("used", F.row_number().over(W.partitionBy("dataset").orderBy("rank")) * g).where("used <= left")
        kept = scratch.keep(kept.select("dataset", "t", "a_id", "b_id", F.lit(g).alias("gap"), "peak_ids"), "kept")
        done = kept if done is None else done.unionByName(kept)
        used = kept.groupBy("dataset").agg((F.count("*") * g).alias("used"))
        budget = scratch.keep(budget.join(used, "dataset", "left").select("dataset", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), "budget")
        ends = scratch.keep(ends.join(kept.select(F.col("a_id").alias("node_id")), "node_id", "left_anti"), "ends")
        starts = scratch.keep(starts.join(kept.select(F.col("b_id").alias("node_id")), "node_id", "left_anti"), "starts")
        peaks = scratch.keep(peaks.join(kept.select(F.explode("peak_ids").alias("node_id")), "node_id", "left_anti"), "peaks")
    return done


def readmit(det: DataFrame, links: DataFrame, peaks: DataFrame, near_um: float = 4.0, free_um: float = 2.0) -> DataFrame:
    """Peaks further than free_um from every detection of their frame that lie near an end in the frame before, or a start in the one behind."""
    ends = det.join(links.select(F.col("source_id").alias("node_id")), "node_id", "left_anti")
    starts = det.join(links.select(F.col("target_id").alias("node_id")), "node_id", "left_anti")
    taken = radius_pairs(peaks, det, free_um, 0).select(F.col("a_id").alias("node_id"))
    wanted = radius_pairs(ends, peaks, near_um, 1).select(F.col("b_id").alias("node_id")).union(radius_pairs(peaks, starts, near_um, 1).select("a_id")).distinct()
    return peaks.join(wanted, "node_id", "left_semi").join(taken, "node_id", "left_anti")


def within_gap_gate(pairs: DataFrame, det: DataFrame, gate_um: float = 10.0, frames: int = 2, gain: float = 0.040, normal_um: float = 6.5, most: float = 0.125) -> DataFrame:
    """Pairs of ends a and starts b within the gate, which is wider in sparse regions and narrower in dense ones."""
    scratch = Scratch(det.sparkSession, "gate")
    pairs = scratch.keep(pairs, "pairs")
    ends = pairs.select(F.col("a_id").alias("node_id")).union(pairs.select("b_id")).distinct()
    space = scratch.keep(frame_spacing(det.join(ends, "node_id", "left_semi"), det), "spacing")
    of = lambda p: space.select(F.col("node_id").alias(f"{p}_id"), F.col("spacing_um").alias(f"{p}_space"))
    rows = pairs.join(of("a"), "a_id").join(of("b"), "b_id")
    change = F.least(F.lit(most), F.greatest(F.lit(-most), gain * ((F.col("a_space") + F.col("b_space")) / 2 - normal_um)))
    return rows.where(F.col("um") <= gate_um + frames * change).drop("a_space", "b_space")


def motion_errors(det: DataFrame, links: DataFrame) -> DataFrame:
    """(q_id, error_um): how far each only child lies from where the step into its parent q leads on; without such a step, from q."""
    at = lambda key, p: det.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    into = links.groupBy(F.col("target_id").alias("q_id")).agg(F.min("source_id").alias("o_id"), F.count("*").alias("n")).where("n = 1").join(at("o_id", "o_"), "o_id").drop("n", "o_id")
    rows = only_children(links).select(F.col("source_id").alias("q_id"), F.col("target_id").alias("c_id")).join(at("q_id", "q_"), "q_id").join(at("c_id", "c_"), "c_id").join(into, "q_id", "left")
    lead = [F.col(f"q_{c}") + F.coalesce(F.col(f"q_{c}") - F.col(f"o_{c}"), F.lit(0.0)) for c in AXES]
    return rows.select("q_id", "c_id", *[e.alias(f"e_{c}") for c, e in zip(AXES, lead)], *[f"c_{c}" for c in AXES]).select("q_id", distance("e_", "c_").alias("error_um"))


def stolen_daughters(det: DataFrame, links: DataFrame, motion: DataFrame, most_pd2: float = 12.0, most_sister: float = 16.0, least_angle: float = 80.0, least_error: float = 3.0) -> DataFrame:
    """(dataset, t, p_id, d1_id, d2_id, q_id): forks whose d2 is the only child of another node q, which its motion does not explain.

    motion(q_id, error_um): how far q's child lies from where q should have moved.
    """
    children = only_children(links)
    kids = det.join(children.select(F.col("target_id").alias("node_id")), "node_id", "left_semi")
    parents = det.join(children.select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
    at = lambda key, p: det.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in AXES])
    rows = radius_pairs(parents, kids, most_pd2).withColumnsRenamed({"a_id": "p_id", "b_id": "d2_id"}).join(children.select(F.col("source_id").alias("p_id"), F.col("target_id").alias("d1_id")), "p_id").where("d1_id <> d2_id")
    rows = rows.join(at("d1_id", "d_"), "d1_id").where((distance("d_", "b_") <= most_sister) & (angle("d_", "a_", "b_") >= least_angle))
    rows = rows.join(children.select(F.col("source_id").alias("q_id"), F.col("target_id").alias("d2_id")), "d2_id").join(motion.where(F.col("error_um") >= least_error).select("q_id"), "q_id", "left_semi")
    return rows.select("dataset", "t", "p_id", "d1_id", "d2_id", "q_id")


def apply_forks(links: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(dataset, t, source_id, target_id, safe_division) after forks are added and rule-based ones removed.

    links(dataset, t, source_id, target_id, safe_division), adds and removes(dataset, t, p_id, d2_id). An addition whose
    daughter has a parent, or whose parent has not exactly one child, and a removal that is not there are errors.
    """
    drop = removes.select(F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id"))
    pair = ["source_id", "target_id"]
    absent = drop.join(links.where("safe_division = 1"), pair, "left_anti")
    left = links.join(drop.withColumn("gone", F.lit(True)), pair, "left").where("gone is null or coalesce(safe_division, 0) <> 1").drop("gone")
    new = adds.select("dataset", "t", F.col("p_id").alias("source_id"), F.col("d2_id").alias("target_id"), F.lit(1).alias("safe_division"))
    # of the links only those at an addition matter, and these are few
    parented = new.join(left.select("target_id").join(new.select("target_id"), "target_id", "left_semi"), "target_id", "left_semi")
    count = left.select("source_id").join(new.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"))
    wrong = new.join(count, "source_id", "left").where("coalesce(n, 0) <> 1")
    for rows, what in ((absent, "removals that are not there"), (parented, "daughters that have a parent"), (wrong, "parents without exactly one child")):
        if (k := rows.count()) > 0:
            raise ValueError(f"{k} {what}")
    return left.select("dataset", "t", *pair, "safe_division").unionByName(new)


def tracks_that_stay(
    tree: DataFrame, links: DataFrame, least: int = 6, rescue: tuple[int, ...] = (4, 5), least_prob: float = 0.88, most_um: float = 3.0, lost_part: float = 0.1, budget_part: float = 0.012, most: int = 120
) -> DataFrame:
    """(dataset, root, n, why) of tracks(node_id, root): kept ones have least nodes or a fork; unchanged where a dataset would keep none.

    Where a dataset loses lost_part of its nodes or more, tracks of the rescue sizes come back, if the mean probability and
    the mean step are good enough: by score, while they fit into min(most, budget_part of the nodes), skipping what does not.
    """
    scratch = Scratch(tree.sparkSession, "tracks")
    fork = links.groupBy(F.col("source_id").alias("node_id")).agg((F.count("*") > 1).alias("fork"))
    step = links.select(F.col("target_id").alias("node_id"), F.coalesce("edge_prob", F.lit(0.0)).alias("prob"), "um", "dataset")
    rows = tree.join(fork, "node_id", "left").join(step, "node_id", "left")
    comp = rows.groupBy("root").agg(F.first("dataset", True).alias("dataset"), F.count("*").alias("n"), F.max(F.coalesce("fork", F.lit(False))).alias("fork"), F.avg("prob").alias("prob"), F.avg("um").alias("um"))
    comp = scratch.keep(comp, "tracks")
    stays = (F.col("n") >= least) | F.col("fork")
    sums = comp.groupBy("dataset").agg(F.sum("n").alias("all"), F.sum(F.when(stays, F.col("n")).otherwise(0)).alias("kept"))
    lost = F.col("all") - F.col("kept") >= lost_part * F.col("all")
    budget = sums.where((F.col("kept") > 0) & lost).select("dataset", F.least(F.lit(most), F.floor(F.col("all") * budget_part)).cast("int").alias("budget"))
    pool = comp.where(~stays & F.col("n").isin(*rescue) & (F.col("prob") >= least_prob) & (F.col("um") <= most_um)).join(budget, "dataset")
    score = F.round(F.col("prob") - 0.02 * F.col("um") + 0.004 * F.col("n"), 9)
    # what is left only shrinks: of one size, the tracks that fit are the first ones, and so at most most / size
    order = W.partitionBy("dataset", "n").orderBy(score.desc(), "root")
    pool = pool.withColumn("s", score).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most // min(rescue)).where(F.col("k") * F.col("n") <= most)
    line = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "root", "n")))
    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<bigint>").alias("got"))
    fits = lambda a, x: F.when(x.n <= a.left, F.struct((a.left - x.n).cast("int").alias("left"), F.array_append(a.got, x.root).alias("got"))).otherwise(a)
    rescued = pool.groupBy("dataset", "budget").agg(line.alias("o")).select(F.explode(F.aggregate("o", start, fits).got).alias("root"))
    empty = sums.where("kept = 0").select("dataset")
    why = comp.where(stays).select("root", F.lit("kept").alias("why")).unionByName(comp.where(~stays).join(empty, "dataset", "left_semi").select("root", F.lit("unchanged").alias("why"))).unionByName(rescued.select("root", F.lit("rescued").alias("why")))
    return comp.join(why, "root").select("dataset", "root", "n", "why")
