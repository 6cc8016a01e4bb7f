"""Streaming inbox: an extension, batch is the main form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def windowed_counts(events: DataFrame, key: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n, total per window; rows later than the watermark go. Works on batches too."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    g = e.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_per_key(events: DataFrame, key: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """One row per key within the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    return e.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else e.dropDuplicates([key])
