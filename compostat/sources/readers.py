"""Scans: wide count tables, attribute values, project tables, rule files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import RANKS


def read_header(spark: SparkSession, path: str, key: str = "sample", sep: str = ",") -> list[str]:
    """Column names from the first line alone; the first named one must be ``key``, the
    others must be lineages of six ranks.  An unnamed index column is skipped."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError("the file is empty")
    names = [c.strip().strip('"') for c in first[0].lstrip("﻿").split(sep)]
    named = names[1:] if names and names[0] == "" else names
    if not named or named[0] != key:
        raise ValueError(f"the first column must be {key}")
    short = [t for t in named[1:] if len(t.split(".", len(RANKS) - 1)) != len(RANKS)]
    if short:
        raise ValueError(f"not a lineage of {len(RANKS)} ranks: {short[0]}")
    return names


def read_wide_counts(spark: SparkSession, path: str, key: str = "sample") -> tuple[DataFrame, DataFrame]:
    """``(counts, taxa)`` of a wide CSV: the long table without zeros, and ``(taxon_id,
    taxon, parts)``.  Rows stay in one task from file to long form: the header gives the
    schema, so nothing is inferred, and each row becomes its present cells."""
    names = read_header(spark, path, key)
    at = names.index(key)
    taxa = names[at + 1 :]
    lines = spark.read.option("header", True).schema(", ".join(f"c{i} {'string' if i <= at else 'int'}" for i in range(len(names)))).csv(path, enforceSchema=True)
    cells = F.filter(F.transform(F.array(*(F.col(f"c{at + 1 + i}") for i in range(len(taxa)))), lambda n, i: F.struct(i.alias("taxon_id"), n.alias("n"))), lambda c: c["n"] != 0)
    long = lines.select(F.col(f"c{at}").alias("sample"), F.explode(cells).alias("c")).select("sample", "c.taxon_id", F.col("c.n").cast("bigint").alias("n"))
    table = spark.createDataFrame([(i, t, t.split(".", len(RANKS) - 1)) for i, t in enumerate(taxa)], "taxon_id int, taxon string, parts array<string>")
    return long.join(table.select("taxon_id", "taxon"), "taxon_id").select("sample", "taxon", "n"), table


def read_tags(spark: SparkSession, path: str, columns: Sequence[str] = ("project", "srs", "srr", "tag", "value")) -> DataFrame:
    """A TSV of strings in which quotes are data; ``row_id`` is a text that sorts by file,
    place of the split in the file, and row in it."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").option("escape", "\u0000").schema(", ".join(f"{c} string" for c in columns)).csv(path)
    at = F.format_string("%020d %012d", F.col("_metadata.file_block_start"), F.monotonically_increasing_id() % (1 << 33))
    return df.withColumn("row_id", F.concat_ws(" ", F.col("_metadata.file_path"), at))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of strings, with or without a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_keys(spark: SparkSession, path: str, keys: DataFrame, columns: Sequence[str] | None = None, key: str = "sample") -> DataFrame:
    """Rows of a Parquet table whose key is among ``keys``; only ``columns`` are read."""
    df = spark.read.parquet(path)
    df = df.select(key, *[c for c in columns if c != key]) if columns else df
    return df.join(keys.select(key).distinct(), key, "left_semi")


def not_done(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def load_yaml(text: str) -> dict:
    """Rule and parameter files are small and read by the driver."""
    import yaml

    return yaml.safe_load(text) or {}


def rules_of(config: dict, name: str = "category") -> tuple[list[tuple[list[str], str]], str | None]:
    """``(rules, default)`` of a file with ``rules: [{match: [..], <name>: ..}]``."""
    return [([str(m) for m in r["match"]], r[name]) for r in config.get("rules", [])], config.get("default")


def null_rules_of(config: dict) -> tuple[list[str], dict[str, list[str]]]:
    """``(everywhere, conditional)`` of a null-vocabulary file."""
    return [str(v) for v in config.get("global", [])], {str(k): [str(x) for x in v.get("except", [])] for k, v in (config.get("conditional") or {}).items()}


def priors_of(spark: SparkSession, config: dict) -> DataFrame:
    """``(disease_category, name, direction, priority)``: names that go up come first."""
    rows = []
    for category, sides in config.items():
        for direction in ("up", "down"):
            rows += [(category, str(n), direction, len(rows) + k) for k, n in enumerate((sides or {}).get(direction) or [])]
    return spark.createDataFrame(rows, "disease_category string, name string, direction string, priority int")
