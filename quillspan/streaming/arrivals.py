"""Incremental processing of arriving files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and kind; rows later than ``late`` are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = stamped.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), kind, "n", "total")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark's reach."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; the checkpoint makes the next run continue there."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
