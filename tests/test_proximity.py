import math
import random

import pytest

from stemline.operators.proximity import near_points, points_in_boxes

NODES = "node_id long, dataset string, t int, z double, y double, x double, strip string"
BOXES = "crop_id long, dataset string, t int, z_lo double, z_hi double, y_lo double, y_hi double, x_lo double, x_hi double, id int"
SCALE = (1.625, 0.40625, 0.40625)


def near(rows, distance):
    ok = {r[0]: r for r in rows if None not in r[:6] and not any(math.isnan(v) for v in r[3:6])}
    rows = list(ok.values())
    return {
        (min(a[0], b[0]), max(a[0], b[0]))
        for i, a in enumerate(rows) for b in rows[i + 1 :]
        if a[1:3] == b[1:3] and sum(((p - q) * s) ** 2 for p, q, s in zip(a[3:6], b[3:6], SCALE)) <= distance**2
    }


def inside(rows, boxes):
    ok = {r[0]: r for r in rows if None not in r[:6] and not any(math.isnan(v) for v in r[3:6])}
    return {(r[0], b[0]) for r in ok.values() for b in boxes if None not in b[:9] and r[1:3] == b[1:3] and all(b[3 + 2 * k] <= r[3 + k] < b[4 + 2 * k] for k in range(3))}


def points(seed, n, spread):
    rnd = random.Random(seed)
    at = lambda s: round(rnd.uniform(-s, s) * 16) / 16
    rows = [(i, f"m{rnd.randrange(2)}", rnd.randrange(2), at(spread / 4), at(spread), at(spread), "s") for i in range(n)]
    rows += [(n + i, "m0", 0, 1.0, 64.0, 256.0 - i % 3, "same place") for i in range(12)]
    odd = [(900, None, 0, 1.0, 1.0, 1.0, "s"), (901, "m0", None, 1.0, 1.0, 1.0, "s"), (902, "m0", 0, None, 1.0, 1.0, "s"), (903, "m0", 0, math.nan, 1.0, 1.0, "s"), (904, "m0", 0, math.inf, 1.0, 1.0, "s")]
    return rows + odd + rows[:20]


@pytest.mark.parametrize("seed,n,spread,distance", [(1, 250, 60, 3.25), (2, 300, 20, 3.25), (3, 120, 300, 26.0)])
def test_near_as_brute_force(spark, seed, n, spread, distance):
    rows = points(seed, n, spread)
    got = [tuple(r) for r in near_points(spark.createDataFrame(rows, NODES), distance, ["dataset", "t"]).collect()]
    assert len(got) == len(set(got)) and set(got) == near(rows, distance)


def test_sweep_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = points(4, 200, 25)
        assert {tuple(r) for r in near_points(spark.createDataFrame(rows, NODES), 3.25, ["dataset", "t"]).collect()} == near(rows, 3.25)
        boxes = [(k, "m0", 0, -10.0, 10.0, -20.0 + k, 30.0, -30.0, 5.0 * k, 0) for k in range(8)]
        assert {tuple(r) for r in points_in_boxes(spark.createDataFrame(rows, NODES), spark.createDataFrame(boxes, BOXES), ["dataset", "t"]).collect()} == inside(rows, boxes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boxes_wide_narrow_and_odd(spark):
    rnd = random.Random(9)
    rows = points(5, 300, 80)
    boxes = [(k, f"m{k % 2}", k % 2, -20.0, 20.0, *sorted((rnd.uniform(-90, 90), rnd.uniform(-90, 90))), *sorted((rnd.uniform(-90, 90), rnd.uniform(-90, 90))), 0) for k in range(30)]
    boxes += boxes[:5] + [(50, "m0", 0, -1e12, 1e12, -1e12, 1e12, -1e12, 1e12, 0), (51, "m0", 0, None, 1.0, 0.0, 1.0, 0.0, 1.0, 0), (52, "m0", 0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0), (53, None, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0)]
    n, b = spark.createDataFrame(rows, NODES), spark.createDataFrame(boxes, BOXES)
    got = [tuple(r) for r in points_in_boxes(n, b, ["dataset", "t"]).collect()]
    assert len(got) == len(set(got)) and set(got) == inside(rows, boxes)
    assert points_in_boxes(n.limit(0), b, ["dataset", "t"]).count() == points_in_boxes(n, b.limit(0), ["dataset", "t"]).count() == 0
    assert near_points(n.limit(0), 3.25, ["dataset", "t"]).count() == 0
