"""Joins that hold when one key has a third of all rows.

Keys that are frequent in a small random sample are salted: the long side gets a salt from a column that differs
between its rows, the unique side is repeated once for each salt, for those keys only. The sample only decides how rows
are spread, never which rows come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of the sampled rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.02
SAMPLE = 0.02
SALTS = 64


def hot_ends(df: DataFrame, columns: list[str], share: float = HOT_SHARE, fraction: float = SAMPLE) -> dict[str, list]:
    """For each of some columns of one type, the values that make up at least a share of its sampled rows: at most 1 / share values.

    One pass over a sample; give it a table that is cheap to read, such as a scan or a written table.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
    counts = df.select(*columns).sample(fraction, seed=7).select(ends.alias("end")).where("end.v is not null").groupBy("end.c", "end.v").agg(F.count("*").alias("n"))
    total = counts.groupBy("c").agg(F.sum("n").alias("total"))
    # a sample of a few rows says nothing, and few rows need no salt
    rows = counts.join(F.broadcast(total), "c").where((F.col("total") >= 500) & (F.col("n") >= share * F.col("total")))
    hot: dict[str, list] = {c: [] for c in columns}
    for r in rows.select("c", "v").limit(len(columns) * int(1 / share)).collect():
        hot[r.c].append(r.v)
    return hot


def hot_keys(df: DataFrame, column: str, share: float = HOT_SHARE, fraction: float = SAMPLE) -> list:
    """The values of one column that make up at least a share of its sampled rows."""
    return hot_ends(df, [column], share, fraction)[column]


def salted(df: DataFrame, column: str, by: Column, hot: list, salts: int = SALTS) -> DataFrame:
    """The long side: column ``_salt``, 0 but for hot keys."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    return df.withColumn("_salt", F.when(F.col(column).isin(hot), salt).otherwise(0) if hot else F.lit(0))


def spread(df: DataFrame, column: str, hot: list, salts: int = SALTS) -> DataFrame:
    """The unique side: rows of hot keys once for each salt."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    every = F.array(*[F.lit(i) for i in range(salts)])
    return df.withColumn("_salt", F.explode(F.when(F.col(column).isin(hot), every).otherwise(F.array(F.lit(0)))))


def lookup(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "left", hot: list | None = None, merge: bool = True) -> DataFrame:
    """Join a long table to one with unique keys (left, inner, left_semi, left_anti), by sort and merge.

    merge: without it and without hot keys Spark may broadcast the right side, by its own check of the size.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge") if merge else right, key, how)
    return salted(left, key, by, hot).join(spread(right, key, hot).hint("merge"), [key, "_salt"], how).drop("_salt")
