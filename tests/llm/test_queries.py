import pytest

from stemline.llm import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p2_found", "p2_splits", "p2_shares"])
def test_against_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", ["p6_ids", "p7_mix", "p7_report", "p8_found", "p8_pieces"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
