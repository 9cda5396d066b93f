"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "compostat", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; cluster sizes come from ``conf``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
