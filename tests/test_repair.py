import pytest

from stemline.operators import repair
from stemline.operators.lineage import links as make_links
from tests.test_lineage import U, detections, edges


def track(start, first, y, n, skip=()):
    return [(start + k, first + k, 10.0, y, 50.0 + k * U) for k in range(n) if k not in skip]


def chain(rows):
    ids = sorted(r[0] for r in rows)
    return [(a, b) for a, b in zip(ids, ids[1:]) if b == a + 1]


def test_gaps_of_two_frames(spark):
    rows = track(100, 0, 50.0, 9, skip=(4, 5)) + track(200, 0, 150.0, 9)
    n = detections(spark, rows)
    l = make_links(edges(spark, chain(rows[:7]) + chain(rows[7:])), n)
    (r,) = repair.recover_two_frame_gaps(n, l).collect()
    assert (r.a_id, r.b_id) == (103, 106) and r.m1_x == pytest.approx(50 + 4 * U) and r.m2_x == pytest.approx(50 + 5 * U)


def test_gaps_filled_through_peaks(spark):
    rows = track(100, 0, 50.0, 8, skip=(4,)) + track(200, 0, 150.0, 9, skip=(3, 4)) + track(400, 0, 250.0, 60)
    n = detections(spark, rows)
    own = [r for r in rows if r[0] < 200], [r for r in rows if 200 <= r[0] < 400], [r for r in rows if r[0] >= 400]
    l = make_links(edges(spark, [e for o in own for e in chain(o)]), n)
    peaks = detections(spark, [(900, 4, 10.0, 51.0, 50 + 4 * U), (901, 3, 10.0, 151.0, 50 + 3 * U)])
    (r,) = repair.fill_gaps(n, l, peaks).collect()  # the second track lacks a peak in one of its two frames
    assert (r.a_id, r.b_id, r.gap, r.peak_ids) == (103, 105, 1, [900])


def test_readmission(spark):
    rows = track(100, 0, 50.0, 4)
    n = detections(spark, rows)
    l = make_links(edges(spark, chain(rows)), n)
    peaks = detections(spark, [(900, 4, 10.0, 50.0, 50 + 4 * U), (901, 3, 10.0, 50.0, 50 + 3 * U + 1), (902, 4, 10.0, 90.0, 50.0), (903, 2, 10.0, 50.0, 50 + 9 * U)])
    assert [r.node_id for r in repair.readmit(n, l, peaks).collect()] == [900]


def test_apply_forks(spark):
    l = spark.createDataFrame([("m", 1, 11, 21, 0), ("m", 1, 11, 22, 1), ("m", 1, 41, 42, 0)], "dataset string, t int, source_id long, target_id long, safe_division int")
    fork = lambda *rows: spark.createDataFrame([("m", 1, *r) for r in rows], "dataset string, t int, p_id long, d2_id long")
    none = fork((0, 0)).limit(0)
    got = {(r.source_id, r.target_id) for r in repair.apply_forks(l, fork((41, 44)), fork((11, 22))).collect()}
    assert got == {(11, 21), (41, 42), (41, 44)}
    for adds, removes, what in ((fork((41, 21)), none, "have a parent"), (fork((11, 50)), none, "exactly one child"), (none, fork((41, 42)), "not there")):
        with pytest.raises(ValueError, match=what):
            repair.apply_forks(l, adds, removes)
