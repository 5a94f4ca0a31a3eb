import random

from stemline.operators.labelling import division_proxy, label_forks, next_mark
from stemline.store import Scratch

LINK = "dataset string, source_id long, target_id long"


def _links(spark, pairs):
    return spark.createDataFrame([("m", a, b) for a, b in pairs], LINK)


def _match(spark, pairs):
    return spark.createDataFrame(pairs, "pred_id long, true_id long")


# true: 1 -> 2 -> {3, 4}, 3 -> 5, 4 -> 6; a second track 11 -> 12 -> 13
TRUTH = [(1, 2), (2, 3), (2, 4), (3, 5), (4, 6), (11, 12), (12, 13)]
SAME = [(i, i) for i in (1, 2, 3, 4, 5, 6, 11, 12, 13)]


def _labels(spark, cands, base, match=SAME):
    rows = spark.createDataFrame(cands, "fork_id long, p_id long, d1_id long, d2_id long")
    times = spark.createDataFrame([(i, 2 * i) for i in range(200)], "node_id long, t int")
    out = label_forks(rows, _links(spark, base), _links(spark, TRUTH), _match(spark, match), Scratch(spark, "test"), times, times).collect()
    there = dict(match)
    for r in out:  # the columns beside the label
        p = next(c[1] for c in cands if c[0] == r.fork_id)
        assert r.gt_p_id == there.get(p, -1) and r.timing_vs_gt in (None, 2 * (p - r.gt_divider_id))
        assert (r.gt_p_outdeg == -1) == (r.gt_p_id == -1) and (r.timing_vs_gt is None) == (r.gt_divider_id == -1)
    return {r.fork_id: (r.label, r.fp_reason, None if r.gt_divider_id == -1 else r.gt_divider_id) for r in out}


def test_labels(spark):
    base = [(1, 2), (2, 3), (3, 5), (4, 6), (11, 12), (12, 13), (50, 51)]
    got = _labels(spark, [(1, 2, 3, 4), (2, 2, 3, 13), (3, 11, 12, 60), (4, 50, 51, 60), (5, 2, 3, 6), (6, 2, 3, 60), (7, None, 3, 4), (8, 2, 3, 3), (9, 12, 13, 60), (1, 2, 3, 4)], base)
    assert got == {
        1: ("tp", "", 2), 2: ("fp", "malformed", None), 3: ("fp", "annotated_continuing", None), 4: ("ignored", "", None), 5: ("fp", "malformed", None),
        6: ("fp", "near_gt_division", 2), 8: ("fp", "malformed", None), 9: ("fp", "annotated_continuing", None),
    }


def test_label_across_trees_and_held_divisions(spark):
    assert _labels(spark, [(1, 2, 3, 11)], [(1, 2), (2, 3)])[1] == ("fp", "cross_gt_tracks", None)
    held = [(1, 2), (2, 3), (2, 4), (3, 5), (4, 6)]
    assert _labels(spark, [(1, 2, 3, 4)], held)[1] == ("tp", "", 2)  # the fork itself frees its division
    assert _labels(spark, [(1, 1, 2, 7)], held)[1] == ("fp", "near_gt_division", 2)


def test_empty(spark):
    none = _links(spark, [])
    assert division_proxy(none, none, _match(spark, []), Scratch(spark, "test")).count() == 0
    assert _labels(spark, [(1, 2, 3, 4)], [], [])[1] == ("ignored", "", None)


def test_proxy(spark):
    run = lambda pred, match=SAME: sorted((r.true_id, r.outcome) for r in division_proxy(_links(spark, pred), _links(spark, TRUTH), _match(spark, match), Scratch(spark, "test")).collect())
    assert run([(1, 2), (2, 3), (2, 4)]) == [(2, "tp")]
    assert run([(1, 2), (2, 3), (4, 6)]) == [(2, "fn")]
    # a fork one frame late still joins both lineages
    assert run([(1, 2), (2, 3), (3, 5), (3, 6)]) == [(2, "tp"), (3, "fp")]
    assert run([(11, 12), (11, 99)]) == [(2, "fn"), (11, "fp")]


def test_next_mark_in_buckets(spark):
    rnd = random.Random(5)
    marks = [(k, rnd.randrange(200)) for k in "ab" for _ in range(12)]
    asked = [(k, rnd.randrange(200), i) for i, k in enumerate("abc" * 40)]
    out = next_mark(spark.createDataFrame(asked, "k string, at long, i long"), spark.createDataFrame(marks, "k string, at long"), ["k"], bucket=7)
    want = {i: min((m for j, m in marks if j == k and m >= at), default=None) for k, at, i in asked}
    assert {r.i: r.next for r in out.collect()} == want
