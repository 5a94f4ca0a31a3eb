import numpy as np
import pytest

from stemline.functions import places
from stemline.operators import transitions
from stemline.operators.relink import PASSES, VARIANTS, common_shift, relink, seed_steps, solve_transition, solve_transitions

SCALE = np.array([1.625, 0.40625, 0.40625])


def movie(seed, n=64, frames=12, step=4.5, freeze_at=None):
    """A drifting jittered grid; with a repeated frame, motion goes on behind it, so that the next step is twice as long."""
    rng = np.random.default_rng(seed)
    grid = np.stack(np.meshgrid([20.0], np.arange(8) * 9.0, np.arange(n // 8) * 9.0, indexing="ij"), -1).reshape(-1, 3) + rng.normal(0, 0.6, (n, 3))
    way = np.array([0.0, 0.8, 0.6]) * step
    shown = [t - 1 if freeze_at is not None and t == freeze_at + 1 else t for t in range(frames)]
    noise = rng.normal(0, 0.15, (frames, n, 3))
    return np.stack([grid + way * s + noise[s] for s in shown])


def table(spark, p):
    rows = [("m_1", t, 1000 * t + i, *map(float, p[t, i] / SCALE)) for t in range(p.shape[0]) for i in range(p.shape[1])]
    return spark.createDataFrame(rows, "dataset string, t int, node_id long, z double, y double, x double")


def right(rows, t):
    own = [r for r in rows if r.t == t]
    return sum(r.source_id % 1000 == r.target_id % 1000 for r in own) / 64


def one_by_one(p):
    start, step, last, out = np.zeros((0, 3)), np.zeros((0, 3)), {}, set()
    for t in range(len(p) - 1):
        own = np.array([last.get(i, [np.nan] * 3) for i in range(p.shape[1])])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = solve_transition(p[t], p[t + 1], none, start, step, own, None)
        a, b = [m[0] for m in found], [m[1] for m in found]
        start, step = p[t][a], p[t + 1][b] - p[t][a]
        # samples in the order of the ids that they lead to
        o = np.argsort(b)
        start, step = start[o], step[o]
        last = {j: p[t + 1][j] - p[t][i] for i, j in zip(a, b)}
        out |= {(1000 * t + i, 1000 * (t + 1) + j) for i, j in zip(a, b)}
    return out


def test_rounds_give_the_sequential_result(spark):
    p = movie(1, frames=6)
    p[3] += np.random.default_rng(8).normal(0, 1.5, p[3].shape)
    p = np.round(p / SCALE * 1024) / 1024 * SCALE  # as stored
    assert {(r.source_id, r.target_id) for r in relink(table(spark, p)).collect()} == one_by_one(p)


def test_a_jump_behind_a_repeated_frame(spark):
    p = movie(5, freeze_at=5)
    n = table(spark, p)
    kinds = spark.createDataFrame([("m_1", 5, "frozen"), ("m_1", 6, "jump")], "dataset string, t int, kind string")
    plain, aware = relink(n).collect(), relink(n, kinds=kinds).collect()
    assert right(plain, 6) < 0.5 and right(aware, 6) >= 0.9
    assert all(right(aware, t) == 1 for t in (5,)) and right(aware, 2) >= 0.9


def test_common_shift():
    # a sheet of nuclei 8 um apart that moves by more than half of that; wrong neighbours would be nearer
    z, y, x = np.meshgrid([0.0, 9.0], np.arange(11) * 8.0, np.arange(10) * 8.5, indexing="ij")
    sheet = np.stack([z, y, x], -1).reshape(-1, 3) + np.sin(np.arange(660)).reshape(-1, 3)
    moved = sheet[::-1][15:] + [-2.5, 5.25, 4.0]
    stray = np.array([[40.0, 3.0 * k, 500.0] for k in range(9)])
    for tgt in (moved, np.vstack([stray, moved])):
        assert np.abs(common_shift(sheet, tgt) - [-2.5, 5.25, 4.0]).max() < 1e-9
    assert common_shift(sheet, stray[:3]) is None and common_shift(sheet[:3], moved) is None


def test_crowded_and_empty(spark):
    n = table(spark, movie(2, frames=2))
    assert relink(n, most=10).count() == relink(n.limit(0)).count() == 0
    probs = spark.createDataFrame([(0, 1000, 1.0), (0, 77, 1.0)], "source_id long, target_id long, prob double")
    assert relink(n, probs).where("source_id = 0 and target_id = 1000 and edge_prob = 1").count() == pytest.approx(1)


def test_seed_medians_come_from_detections(spark):
    # steps of 2 um along x, and of 4.5 um after frame 2; no link is given
    shift = np.cumsum([0.0, 2.0, 2.0, 4.5, 2.0])
    rows = [("m_1", t, 10 * t + i, 0.0, 100.0 * i, float(x / SCALE[2])) for t, x in enumerate(shift) for i in range(4)]
    rows += [("m_1", 1, 99, 0.0, 0.0, float(1.5 / SCALE[2]))]
    rows = [r for r in rows if r[2] != 43]  # three seeds in the last transition give no median
    n = spark.createDataFrame(rows, "dataset string, t int, node_id long, z double, y double, x double")
    got = {t: sorted(round(r.um, 3) for r in seed_steps(n).collect() if r.t == t) for t in range(4)}
    assert got == {0: [1.5, 2.0, 2.0, 2.0], 1: [2.0] * 4, 2: [4.5] * 4, 3: [2.0] * 3}
    probs = spark.createDataFrame([(0, 10, 0.9)], "source_id long, target_id long, prob double")
    assert [round(r.um, 3) for r in seed_steps(n, probs).collect() if r.t == 0] == [2.0] * 4
    kinds = {r.t: r for r in transitions.kinds(transitions.frozen(n), seed_steps(n)).collect()}
    assert (kinds[2].kind, kinds[2].reason) == ("jump", "seed_median") and kinds[3].step_um is None and kinds[0].kind == "normal"


def test_crowded_movies_keep_their_links(spark):
    rows = [("m_1", t, 10 * t + i, 0.0, 100.0 * i, 0.0) for t in range(2) for i in range(4)] + [("m_2", t, 100 + t, 0.0, 0.0, 0.0) for t in range(2)]
    n = spark.createDataFrame(rows, "dataset string, t int, node_id long, z double, y double, x double")
    had = [("m_1", 0, 0, 10, 0.0, None), ("m_1", 0, 1, 12, 40.0, 0.5), ("m_2", 0, 100, 100, 9.0, 0.5)]
    existing = spark.createDataFrame(had, "dataset string, t int, source_id long, target_id long, um double, edge_prob double")
    got = {(r.dataset, r.source_id, r.target_id, r.motion_pass, r.edge_prob) for r in relink(n, most=3, existing=existing).collect()}
    assert got == {("m_1", 0, 10, "raw", 0.0), ("m_1", 1, 12, "raw", 0.5), ("m_2", 100, 101, "tight", 0.0)}


def test_variants(spark):
    p = movie(5, freeze_at=5)
    n = table(spark, p)
    kinds = spark.createDataFrame([("m_1", 5, "frozen", 0), ("m_1", 6, "jump", 1)], "dataset string, t int, kind string, k int")
    share = {v: right(relink(n, kinds=kinds, variant=VARIANTS[v]).collect(), 6) for v in ("base", "b1d")}
    assert share["base"] < 0.5 and share["b1d"] >= 0.9
    # a wrong link of high probability wins only with a large bonus; what is there stays where it is kept
    two = spark.createDataFrame([("m", 0, 1, 0.0, 0.0, 0.0), ("m", 1, 2, 0.0, 0.0, 2.0), ("m", 1, 3, 0.0, 0.0, 6.0)], "dataset string, t int, node_id long, z double, y double, x double")
    probs = spark.createDataFrame([(1, 3, 0.9)], "source_id long, target_id long, prob double")
    pick = lambda v, **more: {(r.source_id, r.target_id, r.motion_pass) for r in relink(two, probs, variant=VARIANTS[v], **more).collect()}
    assert pick("base") == pick("bonus0") == {(1, 2, "tight")} and pick("bonus4") == {(1, 3, "tight")}
    had = spark.createDataFrame([("m", 0, 1, 3, 2.4, None)], "dataset string, t int, source_id long, target_id long, um double, edge_prob double")
    assert pick("keep_ilp", existing=had) == {(1, 3, "raw")}


def test_places_with_and_without_a_grid(monkeypatch):
    rng = np.random.default_rng(3)
    points, at = rng.uniform(-30, 30, (90, 3)), rng.uniform(-35, 35, (40, 3))
    few = places.Places(points, 5.0)
    dense = [few.pairs(at, r) for r in (2.0, 5.0, 13.0)], few.nearest(at)
    monkeypatch.setattr(places, "FEW", 0)
    grid = [few.pairs(at, r) for r in (2.0, 5.0, 13.0)], few.nearest(at)
    for a, b in zip(dense[0], grid[0]):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert len(dense[0][2][0]) > 50 and np.array_equal(dense[1], grid[1]) and len(places.Places(points[:0], 5.0).pairs(at, 2.0)[0]) == 0


@pytest.mark.parametrize("variant", ["b1c", "b1d", "bonus2"])
def test_movies_side_by_side_as_each_alone(variant):
    rng = np.random.default_rng(11)
    movies, jumps = [], {}
    for g in range(40):  # the last two are compared by a grid
        n = int(rng.integers(0, 30)) if g < 38 else 300
        src = rng.uniform(0, 12 * max(n, 1) ** (1 / 3), (n, 3))
        far = 9.0 if g % 5 == 0 else 1.0
        tgt = (src + [far, 0.5, 0.0] + rng.normal(0, 0.5, src.shape))[rng.random(n) < 0.9]
        some = rng.random(n) < 0.7
        start, step = src[some] - [1.0, 0, 0], np.tile([1.0, 0.2, 0.0], (int(some.sum()), 1)) + rng.normal(0, 0.2, (int(some.sum()), 3))
        own = np.full((n, 3), np.nan)
        own[some] = step
        pairs = np.array([(i, j) for i in range(n) for j in range(len(tgt)) if rng.random() < 0.05], np.int64).reshape(-1, 2)
        movies.append((src, tgt, (pairs[:, 0], pairs[:, 1], rng.random(len(pairs))), start, step, own))
        if g % 5 == 0:
            jumps[g] = 1
    first = [np.cumsum([0] + [len(m[c]) for m in movies]) for c in range(2)]
    of = lambda c: np.repeat(np.arange(40), [len(m[c]) for m in movies])
    whole = lambda c: np.concatenate([m[c] for m in movies])
    bonus = tuple(np.concatenate([m[2][c] + (first[c][g] if c < 2 else 0) for g, m in enumerate(movies)]) for c in range(3))
    got = solve_transitions(of(0), whole(0), of(1), whole(1), bonus, of(3), whole(3), whole(4), whole(5), jumps, VARIANTS[variant])
    got = sorted((*row, PASSES[p]) for *row, p in zip(*[c.tolist() for c in got]))
    alone = [(i + first[0][g], j + first[1][g], *rest) for g, m in enumerate(movies) for i, j, *rest in solve_transition(*m, jumps.get(g), VARIANTS[variant])]
    assert len(got) > 400 and got == sorted(alone) and {r[5] for r in got} == set(PASSES)


def test_seeds_of_vast_frames(spark):
    n = table(spark, movie(3, n=24, frames=4))
    probs = spark.createDataFrame([(1000 * t + i, 1000 * t + 1000 + i, 0.4) for t in range(3) for i in range(24)], "source_id long, target_id long, prob double")
    few, vast = ([(r.t, round(r.um, 9)) for r in seed_steps(n, probs, **more).collect()] for more in ({}, {"most": 10}))
    assert len(few) > 60 and sorted(few) == sorted(vast)


def test_missing_frames_and_ids_of_two_movies(spark):
    # movie b lacks frame 2, so that nothing leads over it; its ids are between those of a
    rows = [(d, t, 10 * t + k, 0.0, 0.0, 2.0 * t) for d, k in (("a", 0), ("b", 1), ("a", 2)) for t in range(5) if (d, t) != ("b", 2)]
    n = spark.createDataFrame([(d, t, i, z, 50.0 * (i % 10), x) for d, t, i, z, y, x in rows], "dataset string, t int, node_id long, z double, y double, x double")
    got = {(r.dataset, r.t, r.source_id, r.target_id) for r in relink(n).collect()}
    assert got == {("a", t, 10 * t + k, 10 * t + 10 + k) for t in range(4) for k in (0, 2)} | {("b", t, 10 * t + 1, 10 * t + 11) for t in (0, 3)}
