import pytest

from stemline.operators import divisions, lineage, scoring, smoothing, transitions

U = 1 / 0.40625  # voxels of a micrometre in the plane


def detections(spark, rows):
    return spark.createDataFrame([("m_1", *r, None, None) for r in rows], "dataset string, node_id long, t int, z double, y double, x double, gap_synthetic int, readmitted int")


def edges(spark, rows):
    return spark.createDataFrame([(i, s, g, None, None, None, None, None) for i, (s, g) in enumerate(rows)], "edge_id long, source_id long, target_id long, edge_prob double, distance_um double, motion_pass string, gap_closed int, safe_division int")


# The small graph with one division that the project's fixtures give, and what comes out of it.
SMALL = [(10, 0, 20.0, 100.0, 100.0), (11, 1, 20.0, 100.0, 100.0), (21, 2, 20.0, 100 - 5 * U, 100.0), (22, 2, 20.0, 100 + 5 * U, 100.0), (31, 3, 20.0, 100 - 7 * U, 100.0), (32, 3, 20.0, 100 + 7 * U, 100.0), (40, 0, 20.0, 200.0, 200.0), (41, 1, 20.0, 200.0, 200.0), (42, 2, 20.0, 200 - 2 * U, 200.0), (43, 3, 20.0, 200.0, 200.0)]
LINKS = [(10, 11), (11, 21), (21, 31), (22, 32), (40, 41), (41, 42), (42, 43)]


def test_fork_candidates(spark):
    n = detections(spark, SMALL)
    (r,) = divisions.fork_candidates(n, lineage.links(edges(spark, LINKS), n)).collect()
    assert (r.p_id, r.d1_id, r.d2_id, r.mirror_rank) == (11, 21, 22, 0)
    assert r.angle_deg == pytest.approx(180) and r.p_d2_um == pytest.approx(5) and r.mirror_um == pytest.approx(0, abs=1e-9) and r.t2_gain_um == pytest.approx(4)
    assert divisions.safe_divisions(n, lineage.links(edges(spark, LINKS), n)).count() == 1


#: Of track 110 the parent and both daughters lie in one place.
STILL = [(110, 1, 20.0, 300.0, 300.0), (121, 2, 20.0, 300.0, 300.0), (122, 2, 20.0, 300.0, 300.0), (131, 3, 20.0, 300 - 2 * U, 300.0), (132, 3, 20.0, 300 + 2 * U, 300.0)]
STILL_LINKS = [(110, 121), (121, 131), (122, 132)]


def test_daughters_in_the_place_of_their_parent(spark):
    n = detections(spark, SMALL + STILL)
    l = lineage.links(edges(spark, LINKS + STILL_LINKS), n)
    assert [(r.p_id, r.d1_id, r.d2_id) for r in divisions.safe_divisions(n, l).collect()] == [(11, 21, 22)]


@pytest.mark.parametrize("pairs,kind", [([(1, 3), (2, 3)], "dt"), ([(1, 2), (1, 3), (1, 4)], "multi_branch"), ([(1, 5)], "dt"), ([(1, 1)], "self_loop"), ([(1, 99)], "dangling"), ([(1, 3), (6, 3)], "merge")])
def test_violations(spark, pairs, kind):
    n = detections(spark, [(1, 0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 0.0), (5, 2, 0.0, 0.0, 0.0), (6, 0, 0.0, 0.0, 0.0)])
    assert kind in {r.kind for r in lineage.violations(edges(spark, pairs), n).collect()}
    assert lineage.violations(edges(spark, [(1, 2), (2, 5)]), n).count() == 0


def test_much_filler_and_null_ends(spark):
    n = detections(spark, [(k, k % 2, 0.0, 0.0, float(k)) for k in range(600)])
    rows = [(k, k + 1) for k in range(0, 600, 2)] + [(-1, k) for k in range(600)] + [(k, -1) for k in range(600)] + [(None, 3), (3, None), (-1, -1)]
    e = edges(spark, rows)
    found = lineage.links(e, n)
    assert {(r.source_id, r.target_id) for r in found.collect()} == {(k, k + 1) for k in range(0, 600, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("source_id") and "(source_id" in plan and ">= 0)" in plan[plan.index("Join"):]
    kinds = [r.kind for r in lineage.violations(e, n).collect()]
    assert kinds.count("dangling") == 1201 and kinds.count("self_loop") == 1


@pytest.mark.parametrize("hot", [0, 600])
def test_bare_forest(spark, hot):
    n = detections(spark, [(k, k % 3, 0.0, 0.0, float(k % 7)) for k in range(900)])
    rows = [(k, g) for k in range(900) if k % 3 < 2 for g in (k + 1, k + 4, k + 10)] + [(3, 3 * k + 1) for k in range(hot)] + [(0, 1)] * hot + [(-1, 1), (None, 1), (1, 900)]
    e = edges(spark, rows + rows[:50])
    found, want = lineage.bare_forest(e, n), lineage.forest(lineage.links(e, n))
    columns = ["dataset", "t", "source_id", "target_id", "um"]
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.select(columns).collect()) and len({r[3] for r in got}) == len(got) > 300
    children = {s: sum(r[2] == s for r in got) for s in {r[2] for r in got}}
    assert {r.source_id for r in found.where("only").collect()} == {s for s, k in children.items() if k == 1}


def test_transition_kinds(spark):
    rows = [(10 * t + k, t, 1.0 + k, 5.0 * (1 if t == 2 else t), float(k)) for t in range(5) for k in range(4)]
    n = detections(spark, rows)
    steps = [(0, 2.0), (1, 0.0), (2, 4.5), (3, 2.2)]
    l = spark.createDataFrame([("m_1", t, um) for t, um in steps for _ in range(4)], "dataset string, t int, um double")
    got = {r.t: (r.kind, r.reason, r.k) for r in transitions.kinds(transitions.frozen(n), l).collect() if r.t < 4}
    assert got == {0: ("normal", "", 0), 1: ("frozen", "frozen", 0), 2: ("jump", "after_frozen", 1), 3: ("normal", "", 0)}
    still = spark.createDataFrame([("m_1", t, False) for t in range(3)], "dataset string, t int, frozen boolean")
    l = spark.createDataFrame([("m_1", t, um) for t, um in [(0, 2.0), (1, 4.1), (2, 2.0)] for _ in range(4)], "dataset string, t int, um double")
    assert {r.t: (r.kind, r.reason) for r in transitions.kinds(still, l).collect()}[1] == ("jump", "seed_median")


def test_line_fit_over_a_jump(spark):
    rows = [(i, i, 10.0, 50.0 + (6 * U if i >= 4 else 0), 20.0 + i) for i in range(7)]
    n = detections(spark, rows)
    l = lineage.links(edges(spark, [(i, i + 1) for i in range(6)]), n, None)
    kinds = spark.createDataFrame([("m_1", 3, "jump")], "dataset string, t int, kind string")
    shifts = spark.createDataFrame([("m_1", 3, 0.0, 6.0, 0.0)], "dataset string, t int, dz double, dy double, dx double")
    y = lambda *a: {r.node_id: r.y for r in smoothing.line_fit(n, l, *a).collect()}
    plain, cut, shifted = y(), y(kinds), y(kinds, shifts)
    assert abs(plain[3] - 50) > 1 + abs(cut[3] - 50)
    assert shifted[3] == pytest.approx(50) and shifted[4] == pytest.approx(50 + 6 * U)
    assert plain[0] == pytest.approx(50) and {r.node_id: r.x for r in smoothing.line_fit(n, l).collect()}[3] == pytest.approx(23)


def test_consensus(spark):
    rows = [(i, i, 10.0, 50.0, 20.0 + (i if i < 4 else i - 1) + (0.5 if i == 4 else 0)) for i in range(7)]
    n = detections(spark, rows)
    l = lineage.links(edges(spark, [(i, i + 1) for i in range(6)]), n, None)
    kinds = spark.createDataFrame([("m_1", 3, "frozen")], "dataset string, t int, kind string")
    got = {r.node_id: r for r in smoothing.consensus(n, n, l, kinds).collect()}
    assert {k for k, r in got.items() if r.moved} == {3, 4} and got[3].x == got[4].x == pytest.approx(23.25)
    far = spark.createDataFrame([("m_1", 2, "frozen")], "dataset string, t int, kind string")
    assert not any(r.moved for r in smoothing.consensus(n, n, lineage.links(edges(spark, [(2, 6)]), n, None), far).collect())


def test_scores(spark):
    truth = spark.createDataFrame([("m_1", 1, 2), ("m_1", 2, 3), ("m_1", 2, 4)], "dataset string, source_id long, target_id long")
    nodes = spark.createDataFrame([(i, i) for i in range(1, 5)], "pred_id long, true_id long")
    count = spark.createDataFrame([("m_1", 4)], "dataset string, n long")

    def report(pred):
        p = spark.createDataFrame([("m_1", *e) for e in pred], "dataset string, source_id long, target_id long")
        rows = scoring.score_report(scoring.edge_confusion(p, truth, nodes), scoring.division_confusion(p, truth, nodes), count, count).collect()
        return next(r for r in rows if r.level == "all")

    best = report([(1, 2), (2, 3), (2, 4)])
    assert best.score == 1.1 and best.edge_jaccard == 1
    lost = report([(1, 2), (2, 3)])
    assert lost.division_jaccard == 0 and lost.fn == 1
    assert report([(1, 2), (2, 3), (2, 4), (8, 9)]).fp == 0  # far from any annotation
    assert report([(1, 2), (2, 3), (2, 4), (1, 9)]).fp == 1


def test_thresholds(spark):
    rows = [(k, s, l) for k, (s, l) in enumerate([(0.8, "tp"), (0.7, "fp"), (0.6, "tp"), (0.4, "fp"), (0.35, "fp"), (0.2, "fp"), (0.9, "tp"), (0.9, "ignored"), (0.9, None), (0.1, "fp"), (0.1, "fp")])]
    s = spark.createDataFrame(rows, "fork_id long, score double, label string")
    add = {r.tau: r for r in scoring.sweep_additions(s).collect()}
    assert (add[0.6].added_tp, add[0.6].added_fp, add[0.6].added_ignored, add[0.6].added) == (3, 1, 1, 6)
    picked = {r.kind: r.tau for r in scoring.pick_thresholds(scoring.sweep_additions(s), scoring.sweep_removals(s)).collect()}
    assert picked == {"add": 0.15, "del": 0.6}
    q = scoring.ranking_quality(s).first()
    assert q.roc_auc == pytest.approx(17 / 18, abs=1e-6)


def test_capped_additions_as_a_loop(spark):
    import random

    rnd = random.Random(3)
    adds = [("m", rnd.randrange(6), p, 500 + p, rnd.random()) for p in range(60)]
    links = [("m", t, 100 * t + k, i) for i, (t, k) in enumerate((t, k) for t in range(6) for k in range(60))]
    a = spark.createDataFrame(adds, "dataset string, t int, p_id long, d2_id long, score double")
    l = spark.createDataFrame(links, "dataset string, t int, source_id long, edge_id long")
    got = {r.p_id for r in divisions.capped(a, l, l, frame_part=0.05, edge_part=0.02).collect()}
    per, want = {}, set()
    for _, t, p, _, s in sorted(adds, key=lambda r: -r[4]):
        if per.get(t, 0) < 3 and len(want) < 7:
            per[t] = per.get(t, 0) + 1
            want.add(p)
    assert got == want
