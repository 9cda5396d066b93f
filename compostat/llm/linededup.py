"""Line deduplication against levelled sorted runs of line hashes.

The index is a log-structured one: runs of ``(h1, h2, owner)`` rows, one row for
each line key, bucketed and sorted by hash, one file a bucket.  Every new batch of
documents

1. takes the smallest document id for each line key of its own,
2. merge-anti-joins these with all runs, one after the other (the runs' files are read in
   bucket and sort order: no shuffle and no sort over a run), and
3. adds what is new as a run of level 0.

Once ``fan_out`` runs of a level have gathered they are compacted into one run of the
next level, bucket by bucket without a shuffle, and their files are deleted.  A line
stays where its document owns the key; batches come in ascending id order, so the owner
is the smallest id overall.  In the end the lines are merge-anti-joined with the runs in
the same way, each run taking out the lines that stay.

Lines are split and hashed once, into a table of hashes (two independent 64-bit ones),
ids and line numbers.  A key that holds a large share of all lines would land in one
bucket; such keys (at most 1,000, found by a sketch) are decided by a broadcast join
instead.  The texts meet their dropped line numbers in one join by row.  All of it is
DataFrame operations.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code
points are never dropped; a key occurring several times in its owner stays there each
time; rows with the same id count as one document; null ids count as one document
after all others; equal rows get equal results; very long texts are split like any other
(a text must fit a row); an empty table gives an empty one; columns other than the two
named are carried by ``clean`` as they are, whatever their names, but for ``__kept``,
``__n_lines`` and ``__n_dropped``, which it replaces.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_path, files_for, settings, shared_path

_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = (1 << 63) - 1
_MADE = ("__kept", "__n_lines", "__n_dropped")
#: Keys that are decided by a broadcast join, at most.
_HOT_KEYS = 1_000


def line_key(line: Column) -> Column:
    """The line stripped of ASCII blanks, in ASCII lower case."""
    bare = F.btrim(line, F.lit(_BLANK))
    # lower() also changes other letters, so only pure ASCII lines may take it.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


class LineRuns:
    """The levelled runs; each is a table bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = 3):
        self.spark, self.fan_out, self.buckets = spark, fan_out, buckets
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def planned(self):
        """Settings under which runs are merged: shuffles deal into the runs' buckets, and
        one-file buckets are read one a task and in their order."""
        return settings(
            self.spark, spark__sql__shuffle__partitions=self.buckets, spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
            spark__sql__legacy__bucketedTableScan__outputOrdering="true",
        )

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{len(self.paths)}"
        self.paths[table] = shared_path(self.spark, table)
        # Rows come as one partition a bucket, and so make one file a bucket.
        rows.coalesce(self.buckets).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[table]).saveAsTable(table)
        return table

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")
            drop_path(self.spark, self.paths[table])

    def close(self) -> None:
        """Deletes all runs."""
        self._drop(self.runs())
        self.levels = []

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def unseen(self, owners: DataFrame) -> DataFrame:
        """``owners`` without the keys that a run holds; under ``planned()``."""
        for table in self.runs():
            owners = owners.join(self.spark.table(table).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return owners

    def strangers(self, lines: DataFrame) -> DataFrame:
        """``lines`` (h1, h2, doc, ...) without those whose document owns their key; under
        ``planned()``."""
        for k, table in enumerate(self.runs()):
            run = self.spark.table(table).toDF("r1", "r2", f"owner{k}").hint("merge")
            # An owner is never above a document that holds the key, so this is equality, kept
            # out of the join keys: those are the runs' buckets.
            lines = lines.join(run, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col(f"owner{k}") >= F.col("doc")), "left_anti")
        return lines

    def add(self, owners: DataFrame) -> None:
        """Merge-anti-join ``owners`` (h1, h2, owner) with the runs and add what is new."""
        with self.planned():
            level, table = 0, self._write(self.unseen(owners))
            while True:
                while len(self.levels) <= level:
                    self.levels.append([])
                self.levels[level].append(table)
                if len(self.levels[level]) < self.fan_out:
                    break
                old, self.levels[level] = self.levels[level], []
                # A union of rows (not of column batches) keeps the buckets: each is one task.
                with settings(self.spark, spark__sql__parquet__enableVectorizedReader="false"):
                    table = self._write(functools.reduce(DataFrame.unionByName, map(self.spark.table, old)))
                self._drop(old)
                level += 1


def line_hashes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``(doc, row, pos, h1, h2)`` of the lines long enough; ``row`` is a hash of the text."""
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), _text(text_col).alias("text"))
    # Two steps, so that exploded rows carry no text and don't hash it again.
    cut = rows.select("doc", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    lines = cut.select("doc", "row", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def owners_of(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))


def dropped_lines(lines: DataFrame, batches: int, fan_out: int, hot_lines: int, bucket_lines: int = 500_000) -> DataFrame:
    """``(doc, row, drop)``: the line numbers that go, of the texts that lose any.  The runs
    have a bucket for every ``bucket_lines`` lines, at least 4, and as many as Spark allows
    at most."""
    spark = lines.sparkSession
    cuts = ", ".join(str(k / batches) for k in range(1, batches)) or "0.5"
    n, top, bounds = lines.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {_HOT_KEYS}, {10 * _HOT_KEYS})"), F.expr(f"percentile_approx(doc, array({cuts}))")).first()
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    runs = LineRuns(spark, min(most, max(4, -(-n // bucket_lines))), fan_out)
    limits = [None, *sorted(set(bounds or []) if batches > 1 else []), None]
    for low, high in zip(limits, limits[1:], strict=False):
        part = lines
        if low is not None:
            part = part.filter(F.col("doc") > low)
        if high is not None:
            part = part.filter(F.col("doc") <= high)
        runs.add(owners_of(part))
    hot = [r["item"] for r in top or [] if r["count"] >= max(hot_lines, n / _HOT_KEYS)]
    cold = lines.filter(~F.col("h1").isin(hot)) if hot else lines
    gone = runs.strangers(cold).select("doc", "row", "pos")
    if hot:
        frequent = lines.filter(F.col("h1").isin(hot))
        gone = gone.unionByName(frequent.join(F.broadcast(owners_of(frequent)), ["h1", "h2"]).filter("owner < doc").select("doc", "row", "pos"))
    drops = shared_path(spark, "line-drops")
    with runs.planned():
        gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("drop")).coalesce(runs.buckets).write.parquet(drops)
    runs.close()
    return spark.read.schema("doc bigint, row bigint, drop array<int>").parquet(drops)


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fan_out: int = 3, hot_lines: int = 100_000) -> DataFrame:
    """All columns of ``df`` with ``__kept`` (the lines that stay, joined by a line
    feed), ``__n_lines`` and ``__n_dropped``.  ``df`` is taken in ``batches`` ranges
    of ids, each of about as many lines."""
    spark, at = df.sparkSession, shared_path(df.sparkSession, "line-hashes")
    line_hashes(df, id_col, text_col, min_chars).coalesce(files_for(df)).write.parquet(at)
    lines = spark.read.schema("doc bigint, row bigint, pos int, h1 bigint, h2 bigint").parquet(at)
    drops = dropped_lines(lines, batches, fan_out, hot_lines)
    drop_path(spark, at)
    names = [c for c in df.columns if c not in _MADE]
    whole = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), _text(text_col).alias("text"))
    stays = F.expr("transform(array_except(sequence(0, size(lines) - 1), drop), i -> lines[i])")
    return (
        whole.withColumn("row", F.xxhash64("text"))
        .join(drops, ["doc", "row"], "left")
        .withColumn("lines", F.split("text", "\n", -1))
        .select(
            *(F.col(f"c{k}").alias(c) for k, c in enumerate(names)),
            F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("__kept"),
            F.size("lines").cast("bigint").alias("__n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("__n_dropped"),
        )
    )
