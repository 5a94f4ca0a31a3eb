"""Event-time windows and per-key state over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.store import Scratch


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream; their schema comes from the table itself."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Events counted by window and type; later ones than the watermark allows are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """All that is there now, through the stream; each batch writes the rows that it changed, the last of each key counts."""
    scratch = Scratch(stream.sparkSession, "stream")
    out = f"{scratch.root}/out"

    def write(rows: DataFrame, batch: int) -> None:  # a batch that is run again replaces what it wrote
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    written = stream.sparkSession.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
