"""References to records that do not exist.

References and parent keys are brought to the same partitions by key, sorted there, and merged in one linear pass
(Spark's sort-merge join; hot keys are salted). Each parent has an interval of validity, from its arrival to its
deletion, against which the time of the reference is held.

Defined cases: a reference is a value that is neither null nor negative; a row without time can only be ``missing``;
a parent without arrival is never late, one without deletion never deleted; one reference can be both deleted and late
and then gives two rows. Rows of one id count once, with their earliest time. Empty tables give an empty result, extra
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.skew import lookup


def parent_intervals(parents: DataFrame, key: str, arrived: str = "recorded_at", deleted: str = "deleted_at") -> DataFrame:
    """One row for each key: earliest arrival and earliest deletion."""
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(arrived).alias("arrived"), F.min(deleted).alias("deleted"))
        .withColumn("present", F.lit(True))
    )


def references(table: DataFrame, name: str, row_id: str, fields: list[str], time: str = "recorded_at") -> DataFrame:
    """(ref_table, row_id, ref_field, key, at) of each reference of a table, deliveries of one row taken together."""
    once = (
        table.select(F.col(row_id).alias("row_id"), F.col(time).alias("at"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
        .where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"f{i}") >= 0, F.lit(False)) for i in range(len(fields))]))
        .groupBy("row_id", *[f"f{i}" for i in range(len(fields))])
        .agg(F.min("at").alias("at"))
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f"f{i}").alias("key")) for i, f in enumerate(fields)])
    return (
        once.select("row_id", "at", F.explode(pairs).alias("r"))
        .select(F.lit(name).alias("ref_table"), "row_id", "r.ref_field", "r.key", "at")
        .where(F.col("key") >= 0)
    )


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_table, row_id, ref_field, key, reason, period) of references without a valid parent at their time."""
    joined = lookup(refs, parents, "key", F.col("row_id"))
    at = F.col("at")
    reasons = F.when(F.col("present").isNull(), F.array(F.lit("missing"))).otherwise(
        F.array_compact(F.array(F.when(F.col("deleted") <= at, "deleted"), F.when(F.col("arrived") > at, "late")))
    )
    month = F.concat(F.lpad(F.year(at).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(at).cast("string"), 2, "0"))
    return joined.select(
        "ref_table", "row_id", "ref_field", "key", F.explode(reasons).alias("reason"), F.coalesce(month, F.lit("none")).alias("period")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts for each table, field, reason and month."""
    return found.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count("*").alias("n_references"))
