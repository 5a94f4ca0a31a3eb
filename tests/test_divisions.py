import pytest

from stemline.operators import divisions, scoring

FORK = "dataset string, t int, p_id long, d2_id long, mirror_um double, score double, p_z double, p_y double, p_x double"


def fork(p, d2, x, score, t=3, mirror=1.0):
    return ("m_1", t, p, d2, mirror, score, 0.0, 0.0, float(x))


def test_choice_beside_safe_forks(spark):
    safe = spark.createDataFrame([fork(1, 101, 0, None)], FORK)
    # beside the safe one a frame later; its parent; its daughter, then another; two frames later; far away
    rows = [fork(2, 102, 20, 0.9, 4), fork(1, 103, 0, 0.9), fork(3, 101, 900, 0.9, mirror=0.5), fork(3, 104, 900, 0.9), fork(4, 105, 20, 0.9, 5), fork(5, 106, 500, 0.2)]
    cands = spark.createDataFrame(rows, FORK)
    got = {(r.p_id, r.d2_id) for r in divisions.choose_forks(cands, 0.05, safe=safe).collect()}
    assert got == {(3, 104), (4, 105), (5, 106)}


def test_thresholds_fitted_on_one_embryo_and_counted_on_the_other(spark):
    schema = "embryo string, score double, label string"
    adds = [("a", 0.9, "tp"), ("a", 0.8, "tp"), ("a", 0.7, "fp"), ("a", 0.3, "fp"), ("a", 0.2, "fp"), ("b", 0.95, "fp"), ("b", 0.5, "tp"), ("b", 0.1, "ignored")]
    safe = [("a", 0.1, "fp"), ("a", 0.4, "tp"), ("a", None, "tp"), ("b", 0.05, "tp"), ("b", 0.5, "tp")]
    sweeps = scoring.division_sweeps(spark.createDataFrame(adds, schema), spark.createDataFrame(safe, schema))
    at = {(r.kind, r.embryo, r.tau): r for r in sweeps.collect()}
    r = at["add", None, 0.5]
    assert (r.n, r.tp, r.fp, r.ignored, r.precision_add) == (5, 3, 2, 0, 0.6)
    r = at["del", "a", 0.5]
    assert (r.n, r.tp, r.fp, r.kept_tp_frac) == (2, 1, 1, 0.5)  # the one without score stays, and counts as kept
    got = {(r.kind, r.fit_embryo, r.test_embryo): r for r in scoring.division_thresholds(sweeps, spark.createDataFrame([("a",), ("b",)], "embryo string")).collect()}
    assert len(got) == 6
    r = got["add", "a", "b"]
    assert (r.tau, r.n, r.tp, r.fp) == (0.05, 3, 1, 1) and r.precision_add == pytest.approx(0.5)
    assert got["add", "b", "a"].tau is None and got["add", "b", "a"].n is None
    r = got["del", "a", "b"]
    assert (r.tau, r.n, r.tp, r.kept_tp_frac) == (0.4, 1, 1, 0.5)
    assert got["del", "b", "a"].tau is None and got["add", None, None].tau == 0.05 and got["del", None, None].tau is None
