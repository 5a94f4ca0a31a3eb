import itertools
import random

import numpy as np
import pytest

from stemline.functions.pairing import best_pairs
from stemline.operators.divisions import choose_forks
from stemline.operators.matching import assignment, crowds, greedy_matching


def least_cost(c):
    i, j = np.nonzero(np.isfinite(c))
    got = best_pairs(i, j, c[i, j])
    return list(zip(i[got].tolist(), j[got].tolist()))


@pytest.mark.parametrize("seed", range(30))
def test_least_cost_as_exhaustive(seed):
    rng = np.random.default_rng(seed)
    n, m = map(int, rng.integers(1, 6, 2))
    c = rng.integers(-6, 20, (n, m)).astype(float)
    c[rng.random((n, m)) < 0.4] = np.inf
    best = (0, 0.0)
    small, big = (n, m) if n <= m else (m, n)
    for p in itertools.permutations(range(big), small):
        pairs = [(i, j) if n <= m else (j, i) for i, j in enumerate(p)]
        v = [c[i, j] for i, j in pairs if np.isfinite(c[i, j])]
        best = max(best, (len(v), -sum(v)))
    got = least_cost(c)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert (len(got), -sum(c[i, j] for i, j in got)) == best


def pairs(seed, n=60):
    rnd = random.Random(seed)
    return list({(a, b): (a, b, float(rnd.randrange(1, 30))) for a, b in ((rnd.randrange(n), 1000 + rnd.randrange(n)) for _ in range(3 * n // 2))}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_and_assignment_on_tables(spark, seed):
    rows = pairs(seed)
    df = spark.createDataFrame(rows, "a_id long, b_id long, um double")
    used, want = set(), set()
    for a, b, c in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a_id, r.b_id) for r in greedy_matching(df).collect()} == want
    ls, rs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m = np.full((len(ls), len(rs)), np.inf)
    for a, b, c in rows:
        m[ls.index(a), rs.index(b)] = c
    best = least_cost(m)
    got = assignment(df).collect()
    assert len({r.a_id for r in got}) == len({r.b_id for r in got}) == len(got) == len(best)
    assert sum(r.um for r in got) == sum(m[i, j] for i, j in best)


def test_large_component_of_few_pairs():
    rng = np.random.default_rng(4)
    n = 1500  # a ladder: each row may go straight on or to the next column
    i, j = np.r_[np.arange(n), np.arange(n - 1)], np.r_[np.arange(n), np.arange(1, n)]
    cost = np.r_[np.full(n, 5.0), rng.uniform(0, 4, n - 1)]
    got = best_pairs(i, j, cost)
    assert len(got) == n and cost[got].sum() == 5.0 * n  # most pairs come first


def test_crowds(spark):
    rows = [(1, 11, 1.0), (2, 12, 1.0), (2, 13, 1.0), (3, 13, 2.0), (4, 13, 1.0)]
    assert {tuple(r) for r in crowds(spark.createDataFrame(rows, "a_id long, b_id long, um double")).collect()} == {(1, 1), (4, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "a_id long, b_id long, um double")
    assert greedy_matching(df).count() == assignment(df).count() == 0


def one_by_one(rows, tau):
    best, opts, pos = {}, {}, {}
    for ds, t, p, d2, m, s, z, y, x in rows:
        if s >= tau:
            best[p] = max(best.get(p, s), s)
            opts.setdefault(p, set()).add((m, d2))
            pos[p] = (ds, t, z * 1.625, y * 0.40625, x * 0.40625)
    used, anchors, out = set(), [], set()
    for p in sorted(best, key=lambda p: (-best[p], p)):
        free = [d for _, d in sorted(opts[p]) if d not in used]
        a = pos[p]
        if free and not any(q[0] == a[0] and abs(q[1] - a[1]) <= 1 and sum((u - v) ** 2 for u, v in zip(q[2:], a[2:])) <= 100 for q in anchors):
            used.add(free[0])
            anchors.append(a)
            out.add((p, free[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forks_as_one_by_one(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for p in range(120):
        at = (f"m{rnd.randrange(2)}", rnd.randrange(4))
        z, y, x = (float(rnd.randrange(k)) for k in (10, 90, 90))
        s = rnd.choice([0.4, 0.6, 0.7, 0.9])
        rows += [(*at, p, 1000 + rnd.randrange(70), float(rnd.randrange(9)), s, z, y, x) for _ in range(rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, "dataset string, t int, p_id long, d2_id long, mirror_um double, score double, p_z double, p_y double, p_x double")
    assert {(r.p_id, r.d2_id) for r in choose_forks(df, 0.5).collect()} == one_by_one(rows, 0.5)
    assert choose_forks(df, 2.0).count() == 0
