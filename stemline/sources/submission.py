"""Lineage graphs as tagged CSV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "dataset", "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id")
SCHEMA = "id long, dataset string, row_type string, node_id long, t long, z long, y long, x long, source_id long, target_id long"


def write_submission(rows: DataFrame, path: str) -> None:
    """One CSV part for each range of (dataset, row type, ids), numbered from 0 in that order.

    Row numbers come from the counts of the parts, so that no part waits for another one or holds all rows.
    """
    order = ["dataset", F.col("row_type").desc(), "node_id", "source_id", "target_id"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = parts.persist()
    try:
        counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row for each part
        before, total = {}, 0
        for k in sorted(counts):
            before[k], total = total, total + counts[k]
        offset = F.lit(0).cast("long")
        if before:
            offset = F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv])[F.col("_part").cast("long")]
        parts.withColumn("id", offset + F.col("_k")).select(*COLUMNS).write.mode("overwrite").csv(path, header=True)
    finally:
        parts.unpersist()


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """The rows; a missing column is an error."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in COLUMNS if c not in header]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", False).csv(path)


def graphs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the rows."""
    nodes = rows.where("row_type = 'node'").select("dataset", "node_id", F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in "zyx"])
    return nodes, rows.where("row_type = 'edge'").select("dataset", "source_id", "target_id")


def uncovered(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected datasets without a row."""
    return expected.select("dataset").distinct().join(rows.select("dataset"), "dataset", "left_anti")
