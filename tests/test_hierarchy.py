import random
from collections import defaultdict, deque

import pytest

from stemline.operators.hierarchy import Hierarchies, existing_links, full_hierarchy, full_paths, hierarchy_table, paths
from stemline.store import Scratch


def brute(links):
    kids, parents = defaultdict(set), defaultdict(set)
    for p, c in links:
        kids[p].add(c)
        parents[c].add(p)
    nodes = set(kids) | set(parents)

    def bfs(start):
        dist, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for c in kids[v]:
                if c not in dist:
                    dist[c] = dist[v] + 1
                    queue.append(c)
        return dist

    out, rooted = set(), set()
    for r in nodes:
        if not parents[r]:
            for v, d in bfs(r).items():
                out.add((v, r, d))
                rooted.add(v)
    on = {v for v in nodes if any(v in bfs(c) for c in kids[v])}
    out |= {(v, -1, -1) for v in on}
    behind = set().union(*[set(bfs(v)) for v in on]) if on else set()
    return out | {(v, -2, -2) for v in behind - on - rooted}


def graph(kind, seed):
    rnd = random.Random(seed)
    n = 60
    ids = rnd.sample(range(1000), n)
    if kind == "forest":
        return [(ids[rnd.randrange(max(0, i - 5), i)], ids[i]) for i in range(1, n) if rnd.random() < 0.95]
    if kind == "chain":
        return list(zip(ids, ids[1:]))
    if kind == "hub":
        return [(ids[0], v) for v in ids[1:40]] + [(ids[5], v) for v in ids[40:]]
    if kind == "rings":
        out = []
        for k in range(0, n, 6):
            ring = ids[k : k + 3]
            out += list(zip(ring, ring[1:] + ring[:1])) + [(ring[0], ids[k + 3]), (ids[k + 3], ids[k + 4])]
        return out
    out = [(ids[rnd.randrange(0, i)], ids[i]) for i in range(1, n) if rnd.random() < 0.9]
    return out + [(rnd.choice(ids), rnd.choice(ids)) for _ in range(8)]


@pytest.mark.parametrize("kind,seed,bound", [("any", 6, 1_000_000), ("hub", 3, 9), ("any", 5, 20)])
def test_rows_as_brute_force(spark, kind, seed, bound):
    links = graph(kind, seed)
    df = spark.createDataFrame(links, "p long, c long").repartition(3)
    got = [tuple(r) for r in Hierarchies(df, bound, bucket=5).rows().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(links)


@pytest.mark.parametrize("bound", [1_000_000, 12])
def test_nested_sets_and_paths(spark, bound):
    links = graph("forest", 11) + [(5000, 5001), (5001, 5000)]
    df = spark.createDataFrame(links, "p long, c long")
    table = hierarchy_table(df, bound)
    scratch = Scratch(spark, "t")
    table = scratch.keep(table, "t")
    rows = {r.node_id: r for r in table.collect()}
    parent = {c: p for p, c in links if p < 5000}
    by_root = defaultdict(list)
    for r in rows.values():
        by_root[r.root_id].append(r)
    for group in by_root.values():
        assert sorted(r.pre for r in group) == list(range(len(group)))
        for a in group:
            below = {r.node_id for r in group if a.pre < r.pre <= a.last}
            assert len(below) == a.n_descendants

            def under(v):
                while v in parent:
                    v = parent[v]
                    if v == a.node_id:
                        return True
                return False

            if a.node_id < 5000:
                assert below == {r.node_id for r in group if under(r.node_id)}
    assert sum(r.on_cut for r in rows.values()) >= 1
    for r in paths(table, scratch, segment=4).collect():
        want, v = [r.node_id], r.node_id
        while v in parent:
            v = parent[v]
            want.append(v)
        if r.node_id < 5000:
            assert r.path == want[::-1] and len(r.path) == r.depth + 1


def test_empty_nulls_and_extra_columns(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (None, 2, "b"), (2, None, None), (2, 9, "c"), (1, 2, "d"), (3, 3, "e")], "source_id long, target_id long, p string")
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (2, 5)], "node_id long, c int")
    got = {tuple(r) for r in Hierarchies(existing_links(edges, nodes)).rows().collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, -1, -1)}
    assert Hierarchies(existing_links(edges.limit(0), nodes)).rows().count() == 0


@pytest.mark.parametrize("kind,seed,bound", [("any", 6, 1_000_000), ("any", 5, 20), ("rings", 2, 1_000_000)])
def test_full_paths_and_descendants_over_merges(spark, kind, seed, bound):
    links = graph(kind, seed)
    # rootless: a cycle, a merge below it, and a second cycle behind both
    links += [(5000, 5001), (5001, 5000), (5000, 5002), (5001, 5002), (5002, 5003), (5003, 5003), (5003, 5004)]
    df = spark.createDataFrame(links, "p long, c long").repartition(3)
    known, below = set(links), defaultdict(set)
    for v in {v for link in links for v in link}:
        todo = [v]
        while todo:
            at = todo.pop()
            new = {c for p, c in links if p == at} - below[v]
            below[v] |= new
            todo += new
    want = {r for r in brute(links) if r[1] >= 0}
    rooted = {r[0] for r in want}
    got = full_paths(df, bound, segment=4).collect()
    assert len({(r.node_id, r.root_id) for r in got}) == len(got)
    assert {(r.node_id, r.root_id, r.depth) for r in got if not r.rootless} == want
    assert {r.node_id for r in got if r.rootless} == set(below) - rooted
    for r in got:
        assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.depth + 1
        assert set(zip(r.path, r.path[1:])) <= known
        assert not r.rootless or r.root_id in below[r.root_id]
    table = full_hierarchy(df, bound, segment=4).collect()
    assert {(r.node_id, r.root_id, r.depth, r.rootless) for r in table} == {(r.node_id, r.root_id, r.depth, r.rootless) for r in got}
    assert len(table) == len(got)
    depth = {(r.node_id, r.root_id): r.depth for r in table}
    for r in table:
        assert r.n_descendants == len(below[r.node_id] - {r.node_id})
        assert r.on_cycle == (r.node_id in below[r.node_id])
        listed = {o.node_id for o in table if (o.tree_id == r.tree_id and r.pre < o.pre <= r.last) or o.tree_id in r.trees_below}
        assert listed - {r.node_id} == below[r.node_id] - {r.node_id}
        if r.depth:
            assert (r.parent_id, r.node_id) in known and depth[r.parent_id, r.root_id] == r.depth - 1
        else:
            assert r.parent_id is None
