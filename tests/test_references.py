from datetime import datetime as D

from stemline.operators.references import orphan_report, orphans, parent_intervals, references
from stemline.skew import hot_keys, lookup

EDGES = "edge_id long, source_id long, target_id long, recorded_at timestamp_ntz, key string, at int"
NODES = "node_id long, recorded_at timestamp_ntz, deleted_at timestamp_ntz, present string"
JAN, FEB, MAR = D(2025, 1, 10), D(2025, 2, 10), D(2025, 3, 10)


def test_cases(spark):
    nodes = [(1, FEB, None, "x"), (1, JAN, None, "x"), (2, MAR, None, "x"), (3, JAN, FEB, "x"), (3, JAN, MAR, "x"), (4, None, None, "x"), (5, MAR, JAN, "x"), (None, JAN, None, "x")]
    edges = [
        (10, 1, 2, FEB, "k", 0), (10, 1, 2, MAR, "k", 0),  # delivered twice: the earliest counts, so 2 is late
        (11, 3, -1, FEB, "k", 0), (12, 99, None, None, "k", 0), (13, 3, 2, None, "k", 0), (14, 4, 5, FEB, None, None), (15, None, -1, FEB, "k", 0),
    ]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    found = orphans(references(e, "edges", "edge_id", ["source_id", "target_id"]), parent_intervals(n, "node_id"))
    got = {tuple(r) for r in found.select("row_id", "ref_field", "reason", "period").collect()}
    assert got == {(10, "target_id", "late", "2025-02"), (11, "source_id", "deleted", "2025-02"), (12, "source_id", "missing", "none"), (14, "target_id", "deleted", "2025-02"), (14, "target_id", "late", "2025-02")}
    assert sum(r.n_references for r in orphan_report(found).collect()) == 5
    empty = references(e.limit(0), "edges", "edge_id", ["source_id", "target_id"])
    assert orphans(empty, parent_intervals(n, "node_id")).count() == 0
    assert orphans(references(e, "edges", "edge_id", ["source_id"]), parent_intervals(n.limit(0), "node_id")).select("reason").distinct().count() == 1


def test_hot_keys_are_salted_and_whole(spark):
    rows = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then 8 else id end as k")
    hot = hot_keys(rows, "k")
    assert set(hot) == {7, 8}
    keys = spark.range(0, 30_000).selectExpr("id as k", "id * 2 as v")
    for how in ("left", "left_semi", "left_anti", "inner"):
        a, b = lookup(rows, keys, "k", rows.id, how), rows.join(keys, "k", how)
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0
