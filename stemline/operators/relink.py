"""Motion relinking: links between neighbouring frames that follow the motion of the neighbourhood.

For a transition, confident matches come first (within a narrow gate); their steps form a field, and all detections are
matched again where the field predicts them, tightly and then more loosely. The confident matches themselves start from
the field of the transition before, which makes the definition sequential in time.

Here a task goes through the times of its movies, and solves the transitions of all of them at one time together, as arrays:
small frames are many, and each would cost Python milliseconds. It holds two frames of each of its movies, of any size.

Ties: by detection ids. Where a jump of the whole frame is known (kinds), its common shift is estimated by votes of all
near pairs and added to the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.functions.geometry import AXES, SCALE
from stemline.functions.pairing import best_pairs
from stemline.functions.places import Places, first_of_groups, fullest, group_medians, group_nearest, group_pairs
from stemline.functions.runs import whole_groups
from stemline.operators.lineage import keep_and_fill
from stemline.operators.matching import assignment
from stemline.operators.spatial import radius_pairs
from stemline.store import Scratch

#: Votes for a step that are all compared; of more, cubes are counted first, with the same result.
MOST_COUNTED = 10_000
#: Detections of a frame that a task may hold when it matches seeds.
MOST_HELD = 100_000
PASSES = ("tight", "relaxed")
#: Fixed values, micrometres: gates of confident, tight and loose matches; the gate of tight ones without a field.
SEED, TIGHT, RELAXED, TIGHT_ALONE = 5.5, 7.0, 10.0, 5.5
#: Samples of the field at a place, their reach, the distance below which a sample is one's own, and the least number.
FLOW_K, FLOW_REACH, FLOW_OWN, FLOW_LEAST = 12, 40.0, 1.5, 4
OWN_STEP = 0.5
#: Fixed value: the widest gate of confident matches in a jump.
WIDEST_SEED = 15.0


@dataclass(frozen=True)
class Variant:
    """bonus: weight of learned probabilities; keep: existing links stay, and others come only between free ends; in jumps,
    shift: add the common shift to the prediction; widen: confident matches within (k + 1) gates; rounds: of the field."""

    bonus: float = 1.0
    keep: bool = False
    shift: bool = False
    widen: bool = False
    rounds: int = 1


#: The variants by name.
VARIANTS = {
    "base": Variant(), "bonus0": Variant(bonus=0.0), "bonus05": Variant(bonus=0.5), "bonus2": Variant(bonus=2.0), "bonus4": Variant(bonus=4.0), "keep_ilp": Variant(keep=True),
    "b1b": Variant(widen=True, rounds=2), "b1c": Variant(shift=True), "b1d": Variant(shift=True, widen=True, rounds=2),
}


def flow_at(of_at: np.ndarray, at: np.ndarray, of_start: np.ndarray, start: np.ndarray, step: np.ndarray, own: float) -> np.ndarray:
    """The median step of the nearest samples of its group at each place; NaN where there is none in reach, or too few in the group."""
    some = np.flatnonzero(np.bincount(of_start)[of_start] >= FLOW_LEAST) if len(start) else np.zeros(0, np.int64)
    if not len(some):
        return np.full((len(at), 3), np.nan)
    i, j, d = group_nearest(of_at, at, of_start[some], start[some], FLOW_REACH, FLOW_K + 1)
    keep = np.flatnonzero(d >= own)  # one's own is among the nearest
    keep = keep[first_of_groups(i[keep], FLOW_K)]
    i, j = i[keep], some[j[keep]]
    return group_medians(len(at), i, step[j], FLOW_K)


def densest(votes: np.ndarray, band: float) -> np.ndarray:
    """The median of the votes around the one that has most others within the band; of equal ones the least by z, y, x."""
    votes = votes[np.lexsort((votes[:, 2], votes[:, 1], votes[:, 0]))]
    near = Places(votes, band)
    if len(votes) > MOST_COUNTED:
        first = fullest(votes, band)
    else:
        count = np.zeros(len(votes), np.int64)
        for i, _, _ in near.around(votes, band):
            count += np.bincount(i, minlength=len(votes))
        first = int(count.argmax())
    _, j, _ = near.pairs(votes[[first]], band)
    return np.median(votes[j], axis=0)


def agreed_step(src: np.ndarray, tgt: np.ndarray, shift: np.ndarray, reach: float, least: int) -> np.ndarray | None:
    """The median step of those that are each other's nearest once src is shifted; None where they are too few."""
    there = Places(tgt, reach).nearest(src + shift)
    here = Places(src + shift, reach).nearest(tgt)
    both = np.flatnonzero(here[there] == np.arange(len(src)))
    return np.median(tgt[there[both]] - src[both], axis=0) if len(both) >= least else None


def common_shift(src: np.ndarray, tgt: np.ndarray, reach: float = 16.0, band: float = 1.5, rounds: int = 6, least: int = 4) -> np.ndarray | None:
    """The step that two point sets agree on best, or None where fewer than least points of each, or pairs, speak for one.

    It is a fixed point: shifting src by it, the median step of mutual nearest neighbours is the same again, to 1e-6. The
    search starts from the densest of all steps up to reach, and the last of so many rounds stands where none is reached,
    or where a later one has too few pairs.
    """
    if min(len(src), len(tgt)) < least:
        return None
    i, j, _ = Places(tgt, reach).pairs(src, reach)
    steps = [densest(tgt[j] - src[i], band) if len(i) else np.zeros(3)]
    while len(steps) <= rounds and (new := agreed_step(src, tgt, steps[-1], reach, least)) is not None:
        steps.append(new)
        if np.allclose(*steps[-2:][::-1], atol=1e-6):
            break
    return steps[-1] if len(steps) > 1 else None


def solve_transitions(of_src: np.ndarray, src: np.ndarray, of_tgt: np.ndarray, tgt: np.ndarray, bonus: tuple[np.ndarray, np.ndarray, np.ndarray], of_start: np.ndarray, start: np.ndarray, step: np.ndarray, own: np.ndarray, jumps: dict[int, int], variant: Variant = VARIANTS["b1c"]) -> tuple[np.ndarray, ...]:
    """(source, target, raw, motion, bonus, place of the pass in PASSES) of a transition of each of many movies, as indices and micrometres.

    of_src, of_tgt, of_start: the movie of each row, as small numbers that ascend. bonus: (source, target, value), each pair
    once; start, step: the fields of the transitions before; own: the last step of each source, NaN without one; jumps: frozen
    transitions before a jump, of the movies that have one here.
    """
    m, movies = max(1, len(tgt)), 1 + max([int(x[-1]) for x in (of_src, of_tgt, of_start) if len(x)], default=0)
    count = lambda x: np.bincount(x, minlength=movies)
    order = np.argsort(bonus[0] * m + bonus[1])
    keys, values = (bonus[0] * m + bonus[1])[order], bonus[2][order]
    jumps = {g: k for g, k in jumps.items() if g < movies}
    leaps, seed_gate = np.zeros(movies, bool), np.full(movies, SEED)
    for g, k in jumps.items():
        leaps[g] = True
        if variant.widen:
            seed_gate[g] = min(SEED * (k + 1), WIDEST_SEED)
    reach = max(RELAXED, float(seed_gate.max()))
    near = group_pairs(of_src, src, of_tgt, tgt, reach)

    def attempt(free_s, free_g, gate, flow, predicted, ahead):
        within = [(i * m + j)[(d <= gate[of_src[i]]) & ok[of_src[i]]] for (i, j, d), ok in ((near, np.ones(movies, bool)), (ahead, flow))]
        i, j = np.divmod(np.unique(np.concatenate(within)), m)
        ok = free_s[i] & free_g[j]
        i, j = i[ok], j[ok]
        extra = np.zeros(len(i))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, i * m + j), len(keys) - 1)
            extra = np.where(keys[at] == i * m + j, values[at], 0.0)
        motion = np.sqrt(((predicted[i] - tgt[j]) ** 2).sum(axis=1))
        got = best_pairs(i, j, motion - variant.bonus * extra)
        i, j = i[got], j[got]
        return i, j, np.sqrt(((src[i] - tgt[j]) ** 2).sum(axis=1)), motion[got], extra[got]

    alone = src + np.where(np.isnan(own), 0.0, OWN_STEP * own)
    before = flow_at(of_src, src, of_start, start, step, 0.0)
    seed_prediction, has_prior = np.where(np.isnan(before), alone, src + before), count(of_start) >= FLOW_LEAST
    for g in jumps if variant.shift else ():
        (a, b), (p, q) = (np.searchsorted(x, [g, g + 1]) for x in (of_src, of_tgt))
        base = src[a:b] + np.where(np.isnan(before[a:b]), 0.0, before[a:b])
        shift = common_shift(base, tgt[p:q])
        if shift is not None:
            seed_prediction[a:b], has_prior[g] = base + shift, True
    every = np.ones(movies, bool)
    s0, g0, *_ = attempt(every[of_src], every[of_tgt], seed_gate, has_prior, seed_prediction, group_pairs(of_src, seed_prediction, of_tgt, tgt, reach))
    found, open_ = None, every
    for k in range(variant.rounds if jumps else 1):
        o = np.argsort(s0)
        s0, g0 = s0[o], g0[o]
        known = count(of_src[s0]) >= FLOW_LEAST
        if k:  # only jumps go on, and not where too few matches refine the field
            open_ = open_ & leaps & known
        field = flow_at(of_src, src, of_src[s0], src[s0], tgt[g0] - src[s0], FLOW_OWN)
        predicted = np.where(np.isnan(field), alone, src + field)
        ahead = group_pairs(of_src, predicted, of_tgt, tgt, RELAXED)
        free_s, free_g, parts = open_[of_src], open_[of_tgt], []
        for name, gate in ((0, np.where(known, TIGHT, TIGHT_ALONE)), (1, np.full(movies, RELAXED))):
            got = attempt(free_s, free_g, gate, known, predicted, ahead)
            free_s[got[0]], free_g[got[1]] = False, False
            parts.append((*got, np.full(len(got[0]), name)))
        new = [np.concatenate(c) for c in zip(*parts)]
        if found is not None:
            stay = ~open_[of_src[found[0]]]
            new = [np.r_[x[stay], y] for x, y in zip(found, new)]
        found = new
        s0, g0 = found[:2]
    return tuple(found)


def solve_transition(src: np.ndarray, tgt: np.ndarray, bonus: tuple[np.ndarray, np.ndarray, np.ndarray], start: np.ndarray, step: np.ndarray, own: np.ndarray, jump: int | None, variant: Variant = VARIANTS["b1c"]):
    """(source, target, raw, motion, bonus, pass) of the transition of one movie; jump: frozen transitions before, None where this is none."""
    of = [np.zeros(len(x), np.int64) for x in (src, tgt, start)]
    found = solve_transitions(of[0], src, of[1], tgt, bonus, of[2], start, step, own, {} if jump is None else {0: jump}, variant)
    return [(*row, PASSES[p]) for *row, p in zip(*[c.tolist() for c in found])]


@dataclass
class Frames:
    """What many movies have at a time: detections by movie and id; learned probabilities of links from there on; jumps."""

    t: int
    movie: np.ndarray
    id: np.ndarray
    at: np.ndarray
    probs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    jumps: dict[int, int]

    def find(self, movie: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is there) of detections of movies."""
        if not len(self.id):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        known = np.unique(self.id)
        code = lambda m, x: m * len(known) + np.minimum(np.searchsorted(known, x), len(known) - 1)
        row = np.minimum(np.searchsorted(code(self.movie, self.id), code(movie, ids)), len(self.id) - 1)
        return row, (self.movie[row] == movie) & (self.id[row] == ids)

    def bonus(self, after: Frames) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row here, row there, probability) of the links whose ends are both there."""
        movie, source, target, prob = self.probs
        (i, a), (j, b) = self.find(movie, source), after.find(movie, target)
        return i[a & b], j[a & b], prob[a & b]


def parts(det: DataFrame, probs: DataFrame | None, kinds: DataFrame | None, without: DataFrame | None = None) -> DataFrame:
    """Detections (role 0), probabilities (1) and jumps (2) as rows of one table, for frames(): whole movies in a partition, by time.

    So a task goes through its movies side by side, and holds two frames of each. without: datasets that are left out.
    """
    none = F.lit(None)
    row = lambda role, rows, id_, other, at: rows.select("dataset", "t", F.lit(role).alias("role"), id_.cast("long").alias("id"), other.cast("long").alias("other"), *[x.cast("double").alias(c) for c, x in zip(AXES, at)])
    rows = row(0, det, F.col("node_id"), none, [F.col(c) * SCALE[c] for c in AXES])
    if probs is not None:
        rows = rows.unionByName(row(1, placed(det, probs), F.col("source_id"), F.col("target_id"), [F.col("prob"), none, none]))
    if kinds is not None:
        rows = rows.unionByName(row(2, kinds.where("kind = 'jump'"), none, F.col("k") if "k" in kinds.columns else F.lit(0), [none] * 3))
    if without is not None:
        rows = rows.join(without, "dataset", "left_anti")
    # so many partitions even for few rows: the work lies in Python
    return rows.repartition(int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dataset").sortWithinPartitions("t")


def placed(det: DataFrame, probs: DataFrame) -> DataFrame:
    """probs(source_id, target_id, prob) with the dataset and t of the source; as they are, where they have them."""
    return probs if "t" in probs.columns else probs.join(det.select("dataset", "t", F.col("node_id").alias("source_id")), "source_id")


def frames(batches: Iterator[pa.RecordBatch], names: dict[str, int]) -> Iterator[Frames]:
    """The frames of a partition of parts(), a time after the other; names: gets the number of each dataset."""
    for table in whole_groups(batches, "t"):
        coded = table.column("dataset").chunk(0).dictionary_encode()
        movie = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        t, role, id_, other = (table.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("t", "role", "id", "other"))
        at = np.stack([table.column(c).fill_null(0.0).to_numpy() for c in AXES], axis=1)
        o = np.lexsort((other, id_, movie, role, t))
        t, role, movie, id_, other, at = t[o], role[o], movie[o], id_[o], other[o], at[o]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(t)]):
            p, q = a + np.searchsorted(role[a:b], [1, 2])
            yield Frames(int(t[a]), movie[a:p], id_[a:p], at[a:p], (movie[p:q], id_[p:q], other[p:q], at[p:q, 0]), dict(zip(movie[q:b].tolist(), other[q:b].tolist())))


def seed_steps(det: DataFrame, probs: DataFrame | None = None, most: int = MOST_HELD) -> DataFrame:
    """(dataset, t, um) of the seeds of each transition: detections matched one to one within the seed gate, without motion.

    probs(source_id, target_id, prob), each pair once: learned probabilities, a bonus. Of movies with a frame of more than most
    detections the pairs are found and solved as tables.
    """
    spark = det.sparkSession
    vast = Scratch(spark, "seeds").keep(det.groupBy("dataset", "t").count().where(F.col("count") > most).select("dataset").distinct(), "vast")
    some = vast.limit(1).count() > 0

    def solve(batches):
        names, last = {}, None
        for here in frames(batches, names):
            if last is not None and last.t + 1 == here.t:
                i, j, um = group_pairs(last.movie, last.at, here.movie, here.at, SEED)
                m = max(1, len(here.id))
                s, g, prob = last.bonus(here)
                o = np.argsort(s * m + g)
                keys, extra = (s * m + g)[o], np.zeros(len(i))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, i * m + j), len(keys) - 1)
                    extra = np.where(keys[at] == i * m + j, prob[o][at], 0.0)
                got = best_pairs(i, j, um - extra)
                yield pa.RecordBatch.from_arrays([pa.array(list(names)).take(pa.array(last.movie[i[got]])), pa.array(np.full(len(got), last.t, np.int32)), pa.array(um[got])], ["dataset", "t", "um"])
            last = here

    steps = parts(det, probs, None, vast if some else None).mapInArrow(solve, "dataset string, t int, um double")
    return steps.unionByName(_seed_steps_of_tables(det.join(vast, "dataset", "left_semi"), probs)) if some else steps


def _seed_steps_of_tables(det: DataFrame, probs: DataFrame | None) -> DataFrame:
    pairs = radius_pairs(det, det, SEED, width=4).select("dataset", "t", "a_id", "b_id", "um")
    bonus = F.lit(0.0)
    if probs is not None:
        pairs = pairs.join(probs.select(F.col("source_id").alias("a_id"), F.col("target_id").alias("b_id"), "prob"), ["a_id", "b_id"], "left")
        bonus = F.coalesce("prob", F.lit(0.0))
    pairs = Scratch(det.sparkSession, "seeds").keep(pairs.select("dataset", "t", "a_id", "b_id", "um", (F.col("um") - bonus).alias("cost")), "pairs")
    return pairs.join(assignment(pairs, cost="cost").select("a_id", "b_id"), ["a_id", "b_id"], "left_semi").select("dataset", "t", "um")


ROWS = "dataset string, t int, source_id long, target_id long, um double, motion_um double, motion_pass string, edge_prob double"


def relink(det: DataFrame, probs: DataFrame | None = None, kinds: DataFrame | None = None, most: int | None = None, existing: DataFrame | None = None, variant: Variant = VARIANTS["b1c"]) -> DataFrame:
    """(dataset, t, source_id, target_id, um, motion_um, motion_pass, edge_prob) of the links that motion supports.

    probs(source_id, target_id, prob), each pair once: learned probabilities, a bonus; kinds(dataset, t, kind[, k]): what the
    variant says of jumps holds for transitions of kind jump, with k frozen ones before (0 if not given). All movies are
    relinked, whatever their size, unless most is given: then those with a frame of more detections are not, and keep the links
    existing(dataset, t, source_id, target_id, um, edge_prob), with the pass raw and no motion_um. Variants that keep links take them from there.
    """
    some = False
    if most is not None:
        crowded = Scratch(det.sparkSession, "relink").keep(det.groupBy("dataset", "t").count().where(F.col("count") > most).select("dataset").distinct(), "crowded")
        some = crowded.limit(1).count() > 0

    def solve(batches):
        names, last, field = {}, None, None
        for here in frames(batches, names):
            if last is not None and last.t + 1 == here.t:
                if field is None:
                    field = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros((0, 3))
                own = np.full((len(last.id), 3), np.nan)
                own[field[1]] = field[3]
                i, j, raw, motion, extra, name = solve_transitions(last.movie, last.at, here.movie, here.at, last.bonus(here), field[0], field[2], field[3], own, last.jumps, variant)
                columns = [pa.array(list(names)).take(pa.array(last.movie[i])), pa.array(np.full(len(i), last.t, np.int32)), pa.array(last.id[i]), pa.array(here.id[j]), pa.array(raw), pa.array(motion), pa.array(list(PASSES)).take(pa.array(name)), pa.array(extra)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])
                o = np.argsort(j)  # by movie and target
                i, j = i[o], j[o]
                field = here.movie[j], j, last.at[i], here.at[j] - last.at[i]
            else:
                field = None
            last = here

    links = parts(det, probs, kinds, crowded if some else None).mapInArrow(solve, ROWS)
    if existing is None or not (some or variant.keep):
        return links
    there = existing if variant.keep else existing.join(crowded, "dataset", "left_semi")
    there = there.select("dataset", "t", "source_id", "target_id", "um", F.lit(None).cast("double").alias("motion_um"), F.lit("raw").alias("motion_pass"), F.coalesce("edge_prob", F.lit(0.0)).alias("edge_prob"))
    return keep_and_fill(there, links) if variant.keep else links.unionByName(there)
