"""Streaming inputs and the keyed, replay-safe output the queries read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quantloom.operators.merge import keep_last
from quantloom.session import scratch_path

BATCH = "batch_id"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A Parquet table of a folder, one file or a directory of them, as a stream.

    All files there are at the start form one micro-batch: the order of files says nothing about event times, so a watermark between them would drop rows.
    The braces make the path a pattern, which the source takes for a file and for a directory.
    """
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{name}}}")


def ticks(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Positive-valued events as ticks with an event-time column."""
    raw = table_stream(spark, folder, name, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    return raw.filter(F.col("value") > 0).select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("ticker"), "value", "event_id"
    )


def run_keyed(stream: DataFrame, name: str, mode: str = "update", out: str | None = None) -> str:
    """Run a stream over what is available; every micro-batch replaces its own folder, so a replayed batch changes nothing.

    Pass an earlier ``out`` to go on from its checkpoint.
    """
    out = out or scratch_path(stream.sparkSession, name)
    checkpoint = f"{out}-checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def latest_by_key(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Last update of every key over the batches written so far."""
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType())])).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return keep_last(rows, keys, [BATCH]).drop(BATCH)
