import numpy as np

import __spark_entry__ as entry
from stemline.functions import places
from stemline.operators.relink import densest, relink

SCALE = np.array([1.625, 0.40625, 0.40625])
SMALLEST = "/root/testdata/sf0.001"


def crowd(n=2704, frames=3):
    """(t, node_id, z, y, x) of a sheet of detections 12 um apart that moves by 2 um along x."""
    side = int(n**0.5)
    p = np.stack(np.meshgrid([9.0], np.arange(side) * 12.0, np.arange(side) * 12.0, indexing="ij"), -1).reshape(-1, 3)
    return [(t, 10_000_000 * (t + 1) + i, *map(float, (at + [0, 0, 2.0 * t]) / SCALE)) for t in range(frames) for i, at in enumerate(p)]


def followed(rows, n=2704, frames=3):
    return {(r.t, r.source_id, r.target_id) for r in rows} == {(t, 10_000_000 * (t + 1) + i, 10_000_000 * (t + 2) + i) for t in range(frames - 1) for i in range(n)}


def test_movies_with_large_frames_are_relinked(spark):
    n = spark.createDataFrame([("m_1", *r) for r in crowd()], "dataset string, t int, node_id long, z double, y double, x double")
    assert followed(relink(n).collect())


def test_the_query_relinks_movies_with_large_frames(spark, tmp_path):
    nodes = spark.read.parquet(f"{SMALLEST}/nodes.parquet")
    more = spark.createDataFrame([("crowded_1", *r) for r in crowd()], "dataset string, t int, node_id long, z double, y double, x double")
    nodes.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.read.parquet(f"{SMALLEST}/edges.parquet").write.parquet(f"{tmp_path}/edges.parquet")
    query = entry.queries()["relinked"]
    got, alone = query(spark, str(tmp_path)).collect(), query(spark, SMALLEST).collect()
    assert followed([r for r in got if r.dataset == "crowded_1"])
    assert sorted(map(str, alone)) == sorted(str(r) for r in got if r.dataset != "crowded_1") and "raw" not in {r.motion_pass for r in got}


def test_the_fullest_place_by_counted_cubes():
    rng = np.random.default_rng(4)
    for n, peak, width in ((1500, 200, 0.5), (1500, 200, 0.0), (900, 0, 1.0), (1, 0, 1.0)):
        votes = np.concatenate([rng.uniform(-6, 6, (n, 3)), [1.0, -2.0, 0.5] + rng.normal(0, 1, (peak, 3)) * width])
        votes = np.round(votes * 2) / 2 if not peak else votes  # many are equally full, and just as far apart as the band
        near = (np.sqrt(((votes[:, None] - votes[None]) ** 2).sum(axis=2)) <= 1.5).sum(axis=1)
        assert places.fullest(votes, 1.5) == near.argmax()


def test_a_step_of_many_votes(monkeypatch):
    rng = np.random.default_rng(6)
    votes = np.concatenate([rng.uniform(-6, 6, (1500, 3)), [1.0, -2.0, 0.5] + rng.normal(0, 0.4, (200, 3))])
    compared = densest(votes, 1.5)
    monkeypatch.setattr("stemline.operators.relink.MOST_COUNTED", 0)
    assert np.array_equal(densest(votes, 1.5), compared)


def test_nearest_of_large_groups(monkeypatch):
    rng = np.random.default_rng(5)
    at, points = rng.uniform(0, 60, (500, 3)), np.r_[rng.uniform(0, 60, (400, 3)), rng.uniform(200, 400, (40, 3))]
    at[:20] += 170
    of_at, of_point = np.repeat([0, 1, 2], [100, 399, 1]), np.repeat([0, 1, 3], [60, 379, 1])
    i, j, d = places.group_pairs(of_at, at, of_point, points, 40.0)
    first = places.first_of_groups(i, 13)
    for most in (1 << 23, 0):
        monkeypatch.setattr(places, "WIDENED", most)
        got = places.group_nearest(of_at, at, of_point, points, 40.0, 13)
        assert all(np.array_equal(x, y[first]) for x, y in zip(got, (i, j, d)))
