"""Sinks: clustered Parquet, single-file CSV results, JSON cells, checkpoints of runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str, partitions: int | None = None) -> None:
    """The long table without zeros, rows of a sample together and sorted by taxon, so that
    scans by sample skip row groups.  Taxa that are zero throughout vanish."""
    rows = counts.filter("n != 0")
    rows = rows.repartitionByRange(partitions, "sample") if partitions else rows.repartitionByRange("sample")
    rows.sortWithinPartitions("sample", "taxon").write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_result(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A small result as one CSV with header; maps and arrays as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    flat = flat.orderBy(*order) if order else flat
    flat.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Results of one finished run under its own partition: repeating a run replaces only
    itself."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_text(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where a local master leaves it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="compostat-cut-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def cut(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows starts from the files, and the
    shuffle files that it took are deleted.  ``batch_rows`` bounds the rows that a Python worker gets
    at once, for rows that hold a block of a table each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        values["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, old in before.items():
            spark.conf.unset(k) if old is None else spark.conf.set(k, old)
    return spark.read.schema(df.schema).parquet(path)
