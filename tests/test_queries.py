import os

import pytest

from stemline.plans import catalog
from tests.oracle import same
from tests.test_lineage import LINKS, SMALL, STILL, STILL_LINKS, detections, edges

SOME = ["p4_found", "p5_found", "links_14um", "forest_violations", "best_parents", "knn3_spacing", "fork_candidates", "transition_kinds", "line_fit", "components", "score_report", "ranking_quality", "run_stats_pivot", "user_sessions", "hourly_events_stream"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_catalogue():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


def test_applied_forks_where_daughters_lie_in_the_place_of_their_parent(spark, tmp_path):
    detections(spark, SMALL + STILL).write.parquet(f"{tmp_path}/nodes.parquet")
    edges(spark, LINKS + STILL_LINKS).write.parquet(f"{tmp_path}/edges.parquet")
    same(spark, catalog.QUERIES["applied_forks"], catalog.SQL["applied_forks"], str(tmp_path))
    rows = catalog.QUERIES["applied_forks"](spark, str(tmp_path)).where("safe_division = 1").collect()
    assert [(r.source_id, r.target_id) for r in rows] == [(11, 22)]


def shuffle_bytes(spark):
    """What the shuffle files of this machine take."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_applied_forks_leaves_no_shuffles_of_its_tables(spark):
    folder = "/root/testdata/sf0.01"
    before = set(shuffle_bytes(spark))
    rows = catalog.QUERIES["applied_forks"](spark, folder)
    left = sum(n for name, n in shuffle_bytes(spark).items() if name not in before)
    assert left < 0.1 * sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("nodes", "edges"))
    assert rows.count() > 0


def test_applied_forks_against_sql(spark):
    same(spark, catalog.QUERIES["applied_forks"], catalog.SQL["applied_forks"], "/root/testdata/sf0.01")
