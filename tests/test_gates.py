import math
import random

import pytest

from stemline.operators import repair, spatial

SCALE = (1.625, 0.40625, 0.40625)
U = 1 / 0.40625
NODE = "dataset string, t int, node_id long, z double, y double, x double"


def test_gap_gate_follows_the_spacing(spark):
    # in each movie an end 0 and a start 1 two frames later; others around at a spacing
    rows, pairs = [], []
    for k, (um, gap, others) in enumerate([(10.2, 15.0, 3), (9.9, 2.0, 3), (10.2, 2.0, 3), (10.2, 90.0, 3), (10.2, 0.0, 0), (10.0, 0.0, 0), (10.2, 30.0, 1), (9.9, 2.0, 2)]):
        m, at = f"m_{k}", 100 * k
        for j, t in ((0, 0), (1, 2)):
            here = um * j * U
            rows += [(m, t, at + j, 0.0, 0.0, here)] + [(m, t, at + 10 * (j + 1) + i, 0.0, gap * U * (1 + i / 100), here) for i in range(others)]
        pairs.append((m, 0, at, at + 1, um))
    det = spark.createDataFrame(rows, NODE)
    got = repair.within_gap_gate(spark.createDataFrame(pairs, "dataset string, t int, a_id long, b_id long, um double"), det)
    assert {r.a_id // 100 for r in got.collect()} == {0, 3, 5, 6}


def test_stolen_daughters_by_motion(spark):
    # q moves on by 4 um a frame to d2 (steady), or comes to a sudden stop (moved 4 um, then stays)
    for q0, stolen in ((-4.0, False), (4.0, True)):
        p = [(1, 1, 0.0, 0.0), (2, 2, 0.0, -4.0), (3, 0, 4.0 + q0, 4.0), (4, 1, 4.0, 4.0), (5, 2, 8.0 if not stolen else 4.0, 4.0)]
        det = spark.createDataFrame([("m_1", t, i, 0.0, y * U, x * U) for i, t, x, y in p], NODE)
        links = spark.createDataFrame([("m_1", t, a, b, 4.0) for t, a, b in ((1, 1, 2), (0, 3, 4), (1, 4, 5))], "dataset string, t int, source_id long, target_id long, um double")
        error = {r.q_id: r.error_um for r in repair.motion_errors(det, links).collect()}
        assert error[4] == pytest.approx(4.0 if stolen else 0.0) and error[1] == pytest.approx(4.0)
        assert (4 in {r.q_id for r in repair.stolen_daughters(det, links, repair.motion_errors(det, links)).collect()}) == stolen


def test_wide_cells_give_the_same_pairs(spark):
    det = spark.createDataFrame([("m_1", t, 100 * t + i, i % 3 * 1.0, (i * 37 % 50) * 1.0 - 20, (i * 17 % 60) * 1.0 - 30) for t in range(2) for i in range(60)], NODE)
    of = lambda w: {(r.a_id, r.b_id) for r in spatial.radius_pairs(det, det, 5.5, width=w).collect()}
    assert of(4) == of(1) and of(1)


def test_nearest_anywhere_as_brute_force(spark):
    rnd = random.Random(6)
    rows = [("m", 0, i, 0.0, round(rnd.gauss(0, 400) * 8) / 8, round(rnd.gauss(0, 400) * 8) / 8) for i in range(150)] + [("m", 1, 200 + i, 0.0, float(i * i), 3.0) for i in range(90)]
    rows += [("s", 0, 900, 0.0, 0.0, 0.0), ("s", 0, 901, 0.0, 9e6, 0.0), ("s", 1, 902, 0.0, 5.0, 0.0), ("lone", 0, 990, 0.0, 0.0, 0.0)]
    n = spark.createDataFrame(rows, "dataset string, t int, node_id long, z double, y double, x double")
    um = lambda a, b: math.dist([v * s for v, s in zip(a[3:], SCALE)], [v * s for v, s in zip(b[3:], SCALE)])
    for frames, k in ((1, 1), (0, 3)):
        got = {(r.a_id, r.rank, r.b_id) for r in spatial.nearest_anywhere(n, n, frames, k, start_um=4.0).collect()}
        want = set()
        for a in rows:
            near = sorted((um(a, b), b[2]) for b in rows if a[0] == b[0] and b[1] == a[1] + frames and a[2] != b[2])[:k]
            want |= {(a[2], j + 1, b) for j, (_, b) in enumerate(near)}
        assert got == want
