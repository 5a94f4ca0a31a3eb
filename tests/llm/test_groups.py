import random

import pytest

from stemline.llm.groups import consolidate, group_all, matched_nodes


def brute(pairs):
    label = {}
    for a, b in pairs:
        label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                moved = True
    return label


@pytest.mark.parametrize("bound", [1_000_000, 16])
@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
def test_as_brute_force(spark, kind, bound):
    rnd = random.Random(kind)
    ids = rnd.sample(range(10_000), 120)
    if kind == "random":
        pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(90)]
    elif kind == "chain":
        pairs = list(zip(ids, ids[1:]))
    else:
        pairs = [(ids[0], v) for v in ids[1:80]] * 2 + [(v, ids[90]) for v in ids[100:]]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = consolidate(spark.createDataFrame(pairs, "a long, b long"), bound=bound).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.group for r in got} == brute(pairs)


def test_strings_and_a_node_as_hub_of_a_third(spark):
    pairs = [("hub", f"n{i}") for i in range(60)] + [(f"a{i}", f"a{i + 1}") for i in range(120)]
    got = {r.node: r.group for r in consolidate(spark.createDataFrame(pairs, "a string, b string"), bound=10).collect()}
    assert got == brute(pairs)


def test_defined_cases(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (None, 1, "y"), (3, 3, "z"), (3, 99, "z"), (-1, 3, "f")], "source_id long, target_id long, node string")
    nodes = spark.createDataFrame([(1, "r"), (2, "r"), (3, None), (2, "again"), (None, "n")], "node_id long, root string")
    pairs = matched_nodes(edges, nodes)
    assert {tuple(r) for r in consolidate(pairs).collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in group_all(nodes, pairs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert consolidate(pairs.limit(0)).count() == 0


def test_levels_grow_with_the_logarithm(spark):
    chunks, width = 64, 100
    pairs = [(k * width + j, (k + 1) * width + j) for k in range(chunks) for j in range(width)]  # ids in the order of frames
    sizes = []
    got = {r.node: r.group for r in consolidate(spark.createDataFrame(pairs, "a long, b long"), bound=width, sizes=sizes).collect()}
    assert got == {v: v % width for v in range((chunks + 1) * width)}
    assert len(sizes) <= 12 and sum(sizes) <= 3 * len(pairs)


def test_hub_among_stars(spark):
    pairs = [(0, v) for v in range(1, 400)] + [(v, v + 1000) for v in range(1, 400)] + [(v + 1000, v + 2000) for v in range(1, 400)]
    sizes = []
    got = {r.node: r.group for r in consolidate(spark.createDataFrame(pairs, "a long, b long"), bound=20, sizes=sizes).collect()}
    assert set(got.values()) == {0} and len(got) == 1198
