"""Structured Streaming over table folders: windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(df: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start``, the keys, ``n`` and ``total`` for tumbling windows; rows later than ``late`` may be dropped by a stream."""
    moment = F.col(f"`{time}`").cast("timestamp")
    rows = df.withColumn("__time", moment)
    if df.isStreaming:
        rows = rows.withWatermark("__time", late)
    out = rows.groupBy(F.window("__time", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")
