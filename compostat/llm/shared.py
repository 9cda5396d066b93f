"""The folder that the driver and all executors share, and tables written there.

Lineage is cut by writing a table below ``spark.checkpoint.dir``.  The setting is
read from the session.  Only a local master, whose executors are the driver itself,
may leave it unset: a temporary folder is made then.  Elsewhere that is an error, as
every executor would write to a disk of its own.

Operators delete what they no longer need; what a lazy result still reads is deleted
when the interpreter ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_LEFT: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="compostat-shared-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; deleted when the interpreter ends, at the latest."""
    if not _LEFT:
        atexit.register(_clear)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def _clear() -> None:
    for path, spark in list(_LEFT.items()):
        # The session may have ended before the interpreter.
        with contextlib.suppress(Exception):
            drop_path(spark, path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (``__`` for a dot) for the jobs run inside, restored after."""
    before = {k: spark.conf.get(k, None) for k in (name.replace("__", ".") for name in values)}
    try:
        for name, value in values.items():
            spark.conf.set(name.replace("__", "."), str(value))
        yield
    finally:
        for k, old in before.items():
            if old is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: later jobs
    start from the files, so a lost executor never re-runs what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.pop(path, None)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, from file sizes where it is a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(df: DataFrame, file_bytes: int = 32 << 20) -> int:
    """A file for every ``file_bytes`` of the table, at least 8; where Spark doesn't know the
    size of ``df``, as many as it has partitions."""
    size = table_bytes(df)
    return max(8, -(-size // file_bytes)) if size < 1 << 60 else df.rdd.getNumPartitions()


def text_bytes(col: str):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")
