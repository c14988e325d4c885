"""Event-time windows: each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(df: DataFrame, time: str, late: str | None = None) -> DataFrame:
    """df with time as a timestamp, and a watermark of late on streams."""
    out = df.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if late and df.isStreaming else out


def windowed(df: DataFrame, time: str, width: str, slide: str | None = None, keys: Sequence[str] = (), value: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, stop, keys, n and total of tumbling (or, with slide, sliding) windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events(df, time, late).groupBy(w.alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *keys, "n", *(["total"] if value else []))


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """start, stop, keys, n of runs of events that follow each other within gap."""
    return events(df, time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *keys, "n")


def first_of_each(df: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """One event a key; on streams within the watermark, so state stays bounded."""
    e = events(df, time, late)
    return e.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else e.dropDuplicates(list(keys))


def new_files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """Parquet files that arrive at path, as a stream with the schema of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
