"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table and reading it back. The folder comes from the session's
``spark.checkpoint.dir``, or from the context's checkpoint directory. Only a local master without either gets a temporary
folder of its machine; on a cluster that would lose rows without a word, and is an error. A written table survives the loss
of any executor.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-stemline-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


#: Whether Spark deletes the shuffle files of a query at its end, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named tables of one operator call. tidy: the shuffle files of a table are deleted as soon as it is written."""

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and give the written table."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stemline_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._stemline_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
