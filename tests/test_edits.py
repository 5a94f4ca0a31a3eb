import math
import random

import pytest

from stemline.operators import edits

SCALE = (1.625, 0.40625, 0.40625)
CANDS = ("dataset string, t int, shape string, p_id long, d1_id long, d2_id long, p_z double, p_y double, p_x double, d2_z double, d2_y double, d2_x double, "
         "mirror_um double, p_d2_um double, angle_deg double, in_safe_div int, score double, broken_track_d2_um double")  # fmt: skip
NODES = "dataset string, t int, node_id long, z double, y double, x double"
LINKS = "dataset string, t int, source_id long, target_id long, um double, safe_division int"


def rows(seed, n=70):
    rnd = random.Random(seed)
    place = {p: (rnd.choice("ab"), rnd.randrange(3), 0.0, round(rnd.uniform(0, 120)), round(rnd.uniform(0, 120))) for p in range(n)}
    out, own = [], set()
    for p, (ds, t, z, y, x) in place.items():
        score = rnd.randrange(100) / 100
        for d in rnd.sample(range(100, 140), rnd.randrange(1, 4)):
            d2 = 10_000 * "ab".index(ds) + 1000 * t + d
            safe = int(rnd.random() < 0.15 and d2 not in own and not any(r[3] == p and r[15] for r in out))
            own |= {d2} if safe else set()
            out.append((ds, t, "a" if rnd.random() < 0.7 else "d", p, 5000 + p, d2, z, float(y), float(x), 0.0, 0.0, 0.0, rnd.randrange(900) / 100, 5.0, 95.0, safe, score, rnd.choice([None, 3.0, 9.0, math.nan])))
    return out


def near(a, b):
    return a[0] == b[0] and abs(a[1] - b[1]) <= 1 and math.dist([v * s for v, s in zip(a[6:9], SCALE)], [v * s for v, s in zip(b[6:9], SCALE)]) <= 10


def choose_one_by_one(rs, tau, drop, shapes):
    safe = [r for r in rs if r[15]]
    removed, kept = [r for r in safe if r[16] < drop], [r for r in safe if r[16] >= drop]
    used, anchors, adds = {r[5] for r in kept}, list(kept), []
    pool = [r for r in rs if not r[15] and r[2] in shapes and r[16] >= tau and r[3] not in {k[3] for k in kept}]
    for p in sorted({r[3] for r in pool}, key=lambda p: (-max(r[16] for r in pool if r[3] == p), p)):
        for r in sorted((r for r in pool if r[3] == p), key=lambda r: (r[12] + 1000 * (r[2] == "d"), r[5])):
            if r[5] in used:
                continue
            if not any(near(r, a) for a in anchors):
                adds.append(r)
                used.add(r[5])
                anchors.append(r)
            break
    return {(r[3], r[5]) for r in adds}, {(r[3], r[5]) for r in removed}


def stronger_one_by_one(rs, tau, drop):
    order = lambda r: (-r[16], r[3], r[5])
    safe = sorted((r for r in rs if r[15]), key=order)
    removed, kept = [r for r in safe if r[16] < drop], []
    for r in (r for r in safe if r[16] >= drop):
        (removed if any(near(r, k) for k in kept) else kept).append(r)
    anchors, adds = list(kept), []
    for r in sorted((r for r in rs if not r[15] and r[16] >= tau), key=order):
        broken = r[17] is not None and r[17] <= 4
        if not broken and not any(r[3] == a[3] or r[5] == a[5] or near(r, a) for a in anchors):
            adds.append(r)
            anchors.append(r)
    return {(r[3], r[5]) for r in adds}, {(r[3], r[5]) for r in removed}


def pairs(df):
    got = [(r.p_id, r.d2_id) for r in df.select("p_id", "d2_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_as_one_by_one(spark, seed):
    rs = rows(seed)
    cands = spark.createDataFrame(rs, CANDS)
    adds, removes = edits.choose(cands, 0.4, 0.3)
    assert (pairs(adds), pairs(removes)) == choose_one_by_one(rs, 0.4, 0.3, "ad")
    adds, removes = edits.choose_stronger(cands, 0.4, 0.3)
    assert (pairs(adds), pairs(removes)) == stronger_one_by_one(rs, 0.4, 0.3)


def test_choice_without_thresholds_and_empty(spark):
    cands = spark.createDataFrame(rows(3, 20), CANDS)
    adds, removes = edits.choose(cands, None, None)
    assert adds.count() == removes.count() == 0
    for part in (*edits.choose(cands.limit(0), 0.4, 0.3), *edits.choose_stronger(cands.limit(0), 0.4, 0.3)):
        assert part.count() == 0


def test_filter_keeps_safe_divisions_and_shape_a(spark):
    base = ("m", 0, "a", 1, 2, 3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    rs = [base + (9.0, 5.0, 95.0, 1, 0.1, None), base + (1.0, 5.0, 95.0, 0, 0.1, None), base + (9.0, 5.0, 95.0, 0, 0.1, None), base + (math.nan, 5.0, 95.0, 0, 0.1, None), base[:2] + ("d",) + base[3:] + (1.0, 5.0, 95.0, 0, 0.1, None)]
    got = edits.edit_filter(spark.createDataFrame(rs, CANDS), most_mirror=6.0, least_angle=90.0).collect()
    assert sorted((r.mirror_um, r.in_safe_div, r["shape"]) for r in got) == [(1.0, 0, "a"), (9.0, 1, "a")]


def test_budgets(spark):
    nodes = spark.createDataFrame([("m", t, 1000 * t + i, 0.0, 0.0, float(i)) for t in range(2) for i in range(300)], NODES)
    links = spark.createDataFrame([("m", 0, i, 1000 + i, 1.0, 0) for i in range(300)] + [("m", 0, i, 2000 + i, 1.0, 0) for i in range(500)], LINKS)
    base = ("m", 0, "a")
    rs = [base + (p, 9, 100 + p) + (0.0,) * 6 + (1.0, 1.0, 95.0, 0, p / 10, None) for p in range(5)] + [("m", 1, "a", 1003, 9, 200) + (0.0,) * 6 + (1.0, 1.0, 95.0, 0, 0.05, None)]
    none = spark.createDataFrame([], "dataset string, t int, p_id long, d2_id long")
    one = spark.createDataFrame([("m", 0, 77, 88)], "dataset string, t int, p_id long, d2_id long")
    cands = spark.createDataFrame(rs, CANDS)
    # two for each frame of 300 detections, three for 800 links; what is kept counts against both
    assert pairs(edits.cap_additions(cands, nodes, links, none)) == {(4, 104), (3, 103), (1003, 200)}
    assert pairs(edits.cap_additions(cands, nodes, links, one)) == {(4, 104), (1003, 200)}
    assert pairs(edits.cap_additions(cands, nodes, links, none, scale=0.5)) == {(4, 104), (1003, 200)}


def graph(spark):
    nodes = spark.createDataFrame([("m", 0, 1, 0.0, 40.0, 40.0), ("m", 1, 2, 0.0, 30.0, 40.0), ("m", 1, 3, 0.0, 50.0, 40.0), ("m", 1, 4, 0.0, 90.0, 40.0)], NODES)
    return nodes, spark.createDataFrame([("m", 0, 1, 2, 4.0, 0)], LINKS)


def cand(shape, d2, p=1):
    return ("m", 0, shape, p, 2, d2, 0.0, 40.0, 40.0, 1.0, 50.0, 40.0, 0.5, 4.0, 180.0, 0, 0.9, None)


def test_application_with_a_new_node_and_errors(spark):
    nodes, links = graph(spark)
    none = spark.createDataFrame([], "p_id long, d2_id long")
    out, new = edits.apply_edits(nodes, links, spark.createDataFrame([cand("d", -8)], CANDS), none)
    assert {(r.source_id, r.target_id, r.safe_division, r.learned_division) for r in out.collect()} == {(1, 2, 0, 0), (1, 5, 1, 1)}
    assert [tuple(r) for r in new.collect()] == [("m", 5, 1, 1.0, 50.0, 40.0)]
    for bad in ([cand("a", 77)], [cand("a", 2)], [cand("a", 3, 4)], [cand("a", 3), cand("a", 4)]):
        with pytest.raises(ValueError):
            edits.apply_edits(nodes, links, spark.createDataFrame(bad, CANDS), none)
    with pytest.raises(ValueError):
        edits.apply_edits(nodes, links, spark.createDataFrame([cand("a", 3)], CANDS), spark.createDataFrame([(1, 2)], "p_id long, d2_id long"))


def test_replay_checks_places(spark):
    nodes, links = graph(spark)
    kind = "dataset string, plan string, action string, p_id long, p_t int, p_z double, p_y double, p_x double, d2_id long, d2_t int, d2_z double, d2_y double, d2_x double"
    row = ("m", "x", "add", 1, 0, 0.0, 40.0, 40.0, 3, 1, 0.0, 50.0, 40.0)
    got = edits.replay(nodes, links, spark.createDataFrame([row, ("m", "other") + row[2:]], kind), "x")
    assert {(r.source_id, r.target_id) for r in got.collect()} == {(1, 2), (1, 3)}
    for off in (row[:5] + (0.01,) + row[6:], row[:9] + (2,) + row[10:], row[:8] + (99,) + row[9:]):
        with pytest.raises(ValueError):
            edits.replay(nodes, links, spark.createDataFrame([off], kind), "x")


def test_hook_from_end_to_end(spark):
    # one parent with a child and a free detection behind it, on a line through the parent
    um = lambda z, y, x: (z / SCALE[0], y / SCALE[1], x / SCALE[2])
    spots = {1: (0, um(0, 40, 40)), 2: (1, um(0, 36, 40)), 3: (1, um(0, 44, 40)), 4: (2, um(0, 33, 40)), 5: (2, um(0, 47, 40)), 6: (0, um(0, 200, 200)), 7: (1, um(0, 203, 200)), 8: (1, um(0, 197, 200))}
    nodes = spark.createDataFrame([("m", t, k, *p) for k, (t, p) in spots.items()], NODES)
    links = spark.createDataFrame([("m", 0, 1, 2, 4.0, 0), ("m", 1, 2, 4, 3.0, 0), ("m", 1, 3, 5, 3.0, 0), ("m", 0, 6, 7, 3.0, 0)], LINKS)
    safe = spark.createDataFrame([("m", 0, 6, 8)], "dataset string, t int, p_id long, d2_id long")
    seen = {}

    def score(cands, det, before, cache):
        seen["cache"] = cache.count()
        return cands.selectExpr("*", "case when p_id = 1 then 0.9 else 0.05 end score")

    out, log = edits.division_hook(nodes, links, safe, score, 0.5, 0.1, {"least_angle": 90.0}, cache_fn=lambda: nodes)
    assert {(r.source_id, r.target_id, r.learned_division) for r in out.collect()} == {(1, 2, 0), (2, 4, 0), (3, 5, 0), (6, 7, 0), (1, 3, 1)}
    assert [(r.candidates, r.adds_before_cap, r.adds, r.removes) for r in log.collect()] == [(2, 1, 1, 1)] and seen["cache"] == 8
    with pytest.raises(ValueError):
        edits.division_hook(nodes, links, safe, lambda c, *_: c, 0.5, 0.1)
    out, _ = edits.division_hook(nodes, links, safe, score, None, None, cache_fn=lambda: nodes)
    assert out.count() == 5
