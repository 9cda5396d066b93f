"""Counts that arrive over time.  Sums and counts are kept by Structured Streaming
unchanged; exact distinct counts aren't incremental and have an approximate form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_depth(stream: DataFrame) -> DataFrame:
    """Reads and present cells per sample so far (update or complete mode)."""
    return stream.groupBy("sample").agg(F.sum(F.col("n").cast("bigint")).alias("depth"), F.count_if(F.col("n") > 0).alias("n_nonzero"))


def running_census(stream: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Rows per tag, and samples and values to within a relative error."""
    return stream.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("srr", rsd).alias("n_samples"), F.approx_count_distinct("value", rsd).alias("n_values"))


def windowed_counts(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than ``late`` are left out."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
