"""A registered query and its SQL over the same tables, compared as row multisets."""

import glob
import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def cell(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def same(spark, query, sql, folder=FOLDER):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(repr(cell(r[c])) for c in names) for r in df.collect())
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = sorted(tuple(repr(cell(r[columns.index(c)])) for c in names) for r in res.fetchall())
    assert names == sorted(columns)
    assert got == want
