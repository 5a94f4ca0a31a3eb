import random
from collections import Counter

from pyspark.sql import functions as F

from stemline.llm.splits import assign_splits, names_of, related_groups, unit
from stemline.store import Scratch

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def brute(rows):
    label = {}
    moved = True
    while moved:
        moved = False
        for d, e in rows:
            m = min(label.get(("d", d), e), label.get(("e", e), e), e)
            for k in (("d", d), ("e", e)):
                if label.get(k) != m:
                    label[k] = m
                    moved = True
    return {d: label["d", d] for d, _ in rows}


def test_groups_as_brute_force_with_a_hub_and_salted_lists(spark):
    rnd = random.Random(3)
    rows = [(f"d{rnd.randrange(150)}", f"e{rnd.randrange(140)}") for _ in range(170)] + [(f"h{i}", "hub") for i in range(90)]
    names = spark.createDataFrame(rows, "dataset string, embryo string")
    got = related_groups(names, Scratch(spark, "t"), part=10).collect()
    assert len(got) == len({r.dataset for r in got})
    assert {r.dataset: r.group_id for r in got} == brute(rows)


def test_names(spark):
    rows = [(" A_1.ZARR\t", "A"), ("a_1", None), ("b_2.geff", " \t"), (None, "x"), ("a_1", "C "), ("a_1", "C ")]
    got = {tuple(r) for r in names_of(spark.createDataFrame(rows, "dataset string, embryo_id string")).collect()}
    assert got == {("a_1", "a"), ("b_2", "b"), ("a_1", "c")}
    empty = spark.createDataFrame([], "dataset string, embryo_id string, label string")
    assert related_groups(names_of(empty), Scratch(spark, "t")).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(5)
    rows = [(f"d{i}", f"g{min(rnd.randrange(400), rnd.randrange(400))}") for i in range(3000)] + [(f"big{i}", "g_big") for i in range(900)]
    groups = spark.createDataFrame(rows, "dataset string, group_id string")
    got = assign_splits(groups, spark.createDataFrame(TARGETS, "split_name string, share double"), Scratch(spark, "t")).collect()
    assert len(got) == len({r.unit for r in got})
    where = {r.unit: r.split_name for r in got}
    split = {r.group_id: where[r.unit] for r in groups.select("group_id", unit(F.col("group_id")).alias("unit")).distinct().collect()}
    assert len(split) == len({g for _, g in rows})
    n = Counter(split[g] for _, g in rows)
    for name, share in TARGETS:
        assert abs(n[name] / len(rows) - share) < 0.02
    assert assign_splits(groups.limit(0), spark.createDataFrame(TARGETS, "split_name string, share double"), Scratch(spark, "t")).count() == 0
    none = spark.createDataFrame([("train", None), (None, -1.0)], "split_name string, share double")
    assert assign_splits(groups, none, Scratch(spark, "t")).count() == 0
