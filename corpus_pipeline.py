"""Raw documents to token ids: language ID, line dedup, near-dedup, benchmark
decontamination, byte-level BPE.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.  A stage that joins texts with its
decisions gives no more partitions than it read, so that filtering a small table
doesn't leave a file for every shuffle partition.

Defined cases, in every stage: columns beyond those of ``documents`` are left out, whatever
their names; an empty table gives an empty one; repeated rows stay repeated unless a line
above says otherwise; very long texts are handled whole.  By stage:

* language ID: null texts, texts without a letter and texts whose margin is below the
  calibrated one go; a null language isn't learned from, and ``lang`` isn't changed.
* line dedup: a null or empty text becomes an empty one; ``n_chars`` follows the text.
* near-dedup: texts without a word have fingerprint 0 and are one group; decisions go by
  id, so rows that share an id stay or go together, and rows without an id stay only where
  no row of their group has one.
* benchmark decontamination: decides by id too: where rows share an id (or have none), one
  contaminated row takes the others along.
* byte-level BPE: a null or empty text has no token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compostat.llm import bpe, decontam, langid, linededup, simhash
from compostat.llm.queries import language_model, pattern, ranks, table
from compostat.llm.shared import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def files_of(docs: DataFrame) -> int:
    """Tasks that read a table.  ``docs`` is a plain scan, so this runs no job."""
    return max(1, docs.rdd.getNumPartitions())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter or with a margin below the one the
    model was calibrated to go."""
    docs = docs.select(COLUMNS)
    found = langid.identify(docs, language_model(docs), keep=COLUMNS[1:])
    return found.filter(~F.col("rejected")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; ``n_chars`` follows the text."""
    done = linededup.clean(docs.select(COLUMNS))
    return done.withColumn("text", F.col("__kept")).withColumn("n_chars", F.char_length("__kept").cast("bigint")).select(COLUMNS).coalesce(files_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays (rows that share that
    id count as one document)."""
    docs = docs.select(COLUMNS)
    found = simhash.near_duplicates(docs, files=files_of(docs))
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["__stays"]), "left_semi").coalesce(files_of(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    docs = docs.select(COLUMNS)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    goes = found.filter("contaminated").select(F.col("doc_id").alias("__goes")).distinct()
    return docs.join(goes, docs["doc_id"].eqNullSafe(goes["__goes"]), "left_anti").coalesce(files_of(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit integers, with their digests."""
    return bpe.encode_documents(docs, ranks(), pattern())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL can't express compression, fingerprints or BPE; the tests run brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
