"""Incremental ingest of the append-only extraction log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.extraction import done_windows
from scriptorium.sources.records import EXTRACTION


def follow_log(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = EXTRACTION) -> StreamingQuery:
    """Accepted records of new log files appended to the table `out`, each micro-batch once; a window keeps its last one."""

    def write(batch: DataFrame, number: int) -> None:
        done_windows(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_followed(spark: SparkSession, out: str) -> DataFrame:
    """The followed log, one record a window."""
    return done_windows(spark.read.parquet(out)).drop("batch")
