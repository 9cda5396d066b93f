"""Compositional transforms of the long count table.

Centred log-ratios never need the zeros as rows: with T taxa, k of them present in a
sample and pseudocount c, the mean log is (sum(ln n) + (T - k) ln c) / T, and every
absent taxon has the same value, kept once per sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_order


def relative_abundance(counts: DataFrame) -> DataFrame:
    """Share of each sample's own reads; a sample without reads is an error."""
    total = F.sum(F.col("n").cast("double")).over(Window.partitionBy("sample"))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("a sample without reads")).cast("double"))
    return counts.withColumn("__t", checked).select("sample", "taxon", (F.col("n") / F.col("__t")).alias("relative"))


def _with_sample_sums(counts: DataFrame, n_taxa: int | None) -> DataFrame:
    """Present cells with their sample's sum of logs ``s``, ``total`` and number ``k``, and
    the number of ``taxa``: one shuffle by sample, no join back."""
    present, w = counts.filter("n > 0"), Window.partitionBy("sample")
    summed = present.withColumns({"s": F.sum(F.ln("n")).over(w), "total": F.sum(F.col("n").cast("double")).over(w), "k": F.count(F.lit(1)).over(w)})
    if n_taxa is not None:
        return summed.withColumn("taxa", F.lit(n_taxa).cast("bigint"))
    return summed.join(F.broadcast(present.agg(F.count_distinct("taxon").alias("taxa"))))


def clr(counts: DataFrame, pseudocount: float = 0.5, method: str = "additive", n_taxa: int | None = None, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(values, zeros, excluded)``: the CLR of present cells, ``(sample, zero_clr)`` for
    all absent ones, and ``(sample, reason)``.

    additive: zeros take ``pseudocount``.  multiplicative: zeros take pseudocount over
    the sample's total, and present shares shrink to make room.  Samples with no read in
    any taxon are excluded, as are those whose zeros would take everything."""
    if method not in ("additive", "multiplicative"):
        raise ValueError(f"no CLR method {method!r}")
    if pseudocount <= 0:
        raise ValueError("the pseudocount must be positive")
    cells, low = _with_sample_sums(counts, n_taxa), math.log(pseudocount)
    crowded = None
    if method == "additive":
        mean = (F.col("s") + (F.col("taxa") - F.col("k")) * F.lit(low)) / F.col("taxa")
        rows = cells.withColumns({"shift": -mean, "zero_clr": F.lit(low) - mean})
    else:
        # Shares n / N * (1 - z d) with d = pseudocount / N for each of z zeros.
        taken = (F.col("taxa") - F.col("k")) * F.lit(pseudocount) / F.col("total")
        crowded = cells.filter(taken >= 1)
        shrink = F.ln((1 - taken) / F.col("total"))
        zero = F.lit(low) - F.ln("total")
        mean = (F.col("s") + F.col("k") * shrink + (F.col("taxa") - F.col("k")) * zero) / F.col("taxa")
        rows = cells.filter(taken < 1).withColumns({"shift": shrink - mean, "zero_clr": zero - mean})
    values = rows.select("sample", "taxon", (F.ln("n") + F.col("shift")).alias("clr"))
    zeros = rows.groupBy("sample").agg(F.max("zero_clr").alias("zero_clr"))
    excluded = crowded.select("sample").distinct().select("sample", F.lit("zeros take the whole composition").alias("reason")) if crowded is not None else counts.sparkSession.createDataFrame([], "sample string, reason string")
    if samples is not None:
        empty = samples.select("sample").distinct().join(counts.filter("n > 0").select("sample"), "sample", "left_anti").select("sample", F.lit("no reads in any prevalent taxon").alias("reason"))
        excluded = excluded.unionByName(empty)
    return values, zeros, excluded


def dense(values: DataFrame, zeros: DataFrame, taxa: DataFrame, value: str = "clr", zero: str = "zero_clr", keep: Sequence[str] = ()) -> DataFrame:
    """Every (sample, taxon) cell, with columns ``keep`` of ``zeros``; ``taxa`` is the short list of
    prevalent taxa.  A sample's present cells are gathered and its absent ones added in place, so
    only cells that are there are ever shuffled."""
    known = F.broadcast(taxa.select("taxon").distinct())
    present = values.select("sample", "taxon", value).join(known, "taxon", "left_semi").groupBy("sample").agg(F.collect_list(F.struct("taxon", F.col(value).cast("double").alias("v"))).alias("__present"))
    every = F.broadcast(known.agg(F.collect_list("taxon").alias("__taxa")))
    met = zeros.select("sample", *keep, F.col(zero).cast("double").alias("__zero")).join(present, "sample", "left").join(every)
    absent = F.transform(F.array_except("__taxa", F.coalesce(F.col("__present.taxon"), F.array().cast("array<string>"))), lambda t: F.struct(t.alias("taxon"), F.lit(None).cast("double").alias("v")))
    cells = F.concat(F.coalesce("__present", F.array().cast("array<struct<taxon:string,v:double>>")), absent)
    return met.select("sample", *keep, "__zero", F.explode(cells).alias("__c")).select("sample", "__c.taxon", F.coalesce("__c.v", "__zero").alias(value), *keep)


def vectors(values: DataFrame, zeros: DataFrame, taxa: DataFrame, value: str = "clr", zero: str = "zero_clr") -> DataFrame:
    """``(sample, vec array<double>)``, taxa in name order."""
    cells = dense(values, zeros, taxa, value, zero)
    return cells.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("taxon", value))), lambda x: x[value]).alias("vec"))


def log_relative(counts: DataFrame, pseudocount: float = 0.5, n_taxa: int | None = None) -> tuple[DataFrame, DataFrame]:
    """log10 of shares with zeros at the pseudocount: CLR without the centring."""
    cells = _with_sample_sums(counts, n_taxa).withColumn("filled", F.col("total") + (F.col("taxa") - F.col("k")) * F.lit(pseudocount))
    values = cells.select("sample", "taxon", (F.log10("n") - F.log10("filled")).alias("log_relative"))
    return values, cells.groupBy("sample").agg((F.lit(math.log10(pseudocount)) - F.log10(F.max("filled"))).alias("zero_log_relative"))


def hypergeometric(u: float, good: int, total: int, draws: int) -> int:
    """The number of good among ``draws`` of ``total`` without replacement, from a uniform ``u``: the
    least number whose probability and that of all smaller ones is over ``u``.  Probabilities
    are taken around the likeliest number, as far as they matter to a double."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, draws * (good / total) * (1 - good / total) * (total - draws) / max(1, total - 1)))
    reach = int(40 * spread) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=float)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (total - good - draws + k + 1))
    weights = np.exp(np.append(0.0, np.cumsum(steps)) - np.append(0.0, np.cumsum(steps)).max())
    upto = np.cumsum(weights)
    return first + int(np.searchsorted(upto, u * upto[-1], "right"))


def rarefy(counts: DataFrame, depth: int, seed: int = 42) -> DataFrame:
    """Exactly ``depth`` reads of each sample that has as many, without replacement.

    Cell by cell in the order of taxa, a cell's reads among those still to be drawn follow
    the hypergeometric distribution; its uniform number is the MD5 of seed, sample and taxon.  So
    the work is a step a cell, however many reads it has, and a sample's cells pass through
    a task as a stream that holds two numbers."""
    cells = counts.filter("n > 0").select("sample", "taxon", F.col("n").cast("bigint").alias("n"))
    cells = cells.withColumn("total", F.sum("n").over(Window.partitionBy("sample"))).filter(F.col("total") >= depth)
    digits = F.substring(hash_order(seed, F.col("sample"), F.col("taxon")), 1, 13)
    # Hashed partitioning by sample is the window's: no second shuffle.
    cells = cells.withColumn("u", F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))).sortWithinPartitions("sample", "taxon")
    kind = counts.schema["sample"].dataType.simpleString()

    def run(batches):
        now, left, need = None, 0, 0
        for b in batches:
            sample, taken = b.column("sample").to_pylist(), []
            for s, n, total, u in zip(sample, *(b.column(c).to_pylist() for c in ("n", "total", "u")), strict=True):
                if s != now:
                    now, left, need = s, total, depth
                taken.append(hypergeometric(u, n, left, need))
                left, need = left - n, need - taken[-1]
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("taxon"), pa.array(taken, pa.int64())], ["sample", "taxon", "n"])

    return cells.mapInArrow(run, f"sample {kind}, taxon string, n bigint").filter("n > 0")


def edge_weight(relative, scale: float = 1e4):
    return F.log1p(relative * F.lit(scale))


def agreement(a: DataFrame, b: DataFrame, value: str = "clr") -> DataFrame:
    """Correlation per taxon of two versions of the same values."""
    met = a.select("sample", "taxon", F.col(value).alias("x")).join(b.select("sample", "taxon", F.col(value).alias("y")), ["sample", "taxon"])
    return met.groupBy("taxon").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
