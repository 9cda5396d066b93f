"""Aggregates over the long count table ``(sample, taxon, n)``; zeros are absent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_depth(counts: DataFrame) -> DataFrame:
    """Reads and number of taxa of each sample."""
    return counts.groupBy("sample").agg(F.sum(F.col("n").cast("bigint")).alias("depth"), F.count_if(F.col("n") > 0).alias("n_nonzero"))


def taxon_totals(counts: DataFrame) -> DataFrame:
    """Reads and number of samples of each taxon."""
    return counts.groupBy("taxon").agg(F.sum(F.col("n").cast("bigint")).alias("total"), F.count_if(F.col("n") > 0).alias("n_samples"))


def all_totals(counts: DataFrame) -> DataFrame:
    """Row, column and grand totals in one pass (grouping sets)."""
    return counts.groupingSets([["sample"], ["taxon"], []], "sample", "taxon").agg(F.sum(F.col("n").cast("bigint")).alias("total"), F.count_if(F.col("n") > 0).alias("n_nonzero"))


def checksum(counts: DataFrame) -> DataFrame:
    """Grand total, cells, samples and taxa."""
    return counts.agg(F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0).cast("bigint")).alias("total"), F.count_if(F.col("n") > 0).alias("n_cells"), F.count_distinct("sample").alias("n_samples"), F.count_distinct("taxon").alias("n_taxa"))


def prevalence(counts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Share of samples with the taxon; over ``samples`` if given, else over all that
    have any count.  Ranked, most prevalent first."""
    if samples is not None:
        counts = counts.join(samples.select("sample").distinct(), "sample", "left_semi")
    total = (samples if samples is not None else counts).agg(F.count_distinct("sample").alias("n_total"))
    found = counts.filter("n > 0").groupBy("taxon").agg(F.count(F.lit(1)).alias("n_present"))
    # One row a taxon is left by now.
    ranked = Window.orderBy(F.desc("prevalence"), "taxon")
    return found.join(F.broadcast(total)).withColumn("prevalence", F.col("n_present") / F.col("n_total")).withColumn("prevalence_rank", F.row_number().over(ranked)).select("taxon", "n_present", "prevalence", "prevalence_rank")


def prevalent(counts: DataFrame, threshold: float, samples: DataFrame | None = None) -> DataFrame:
    """Counts of taxa whose prevalence is at least ``threshold``."""
    keep = prevalence(counts, samples).filter(F.col("prevalence") >= threshold).select("taxon")
    return counts.join(keep, "taxon", "left_semi").select(counts.columns)


def mean_relative_abundance(counts: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Mean share per taxon over all samples; samples without the taxon count as 0."""
    depth = F.sum(F.col("n").cast("double")).over(Window.partitionBy("sample"))
    shares = counts.withColumn("__d", depth).groupBy("taxon").agg(F.sum(F.col("n") / F.nullif(F.col("__d"), F.lit(0.0))).alias("s"))
    if n_samples is not None:
        return shares.select("taxon", (F.col("s") / F.lit(n_samples)).alias("mean_relative"))
    total = counts.agg(F.count_distinct("sample").alias("n_total"))
    return shares.join(F.broadcast(total)).select("taxon", (F.col("s") / F.col("n_total")).alias("mean_relative"))


def depth_profile(depths: DataFrame) -> DataFrame:
    """Least, tenth, middle, ninetieth and greatest depth and richness."""
    cols = []
    for c in ("depth", "n_nonzero"):
        p = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        cols += [F.min(c).cast("double").alias(f"{c}_min"), p[0].alias(f"{c}_p10"), p[1].alias(f"{c}_median"), p[2].alias(f"{c}_p90"), F.max(c).cast("double").alias(f"{c}_max")]
    return depths.agg(F.count(F.lit(1)).alias("n_samples"), *cols)


def keep_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of the given sample keys."""
    return df.join(samples.select("sample").distinct(), "sample", "left_semi")


def presence(counts: DataFrame) -> DataFrame:
    return counts.filter("n > 0").select("sample", "taxon")


def compare_depths(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many samples two depth tables share, and on how many they differ."""
    return a.select("sample", F.col("depth").alias("x")).join(b.select("sample", F.col("depth").alias("y")), "sample").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("x") != F.col("y")).alias("n_different"))


def to_wide(values: DataFrame, taxa: list[str], value: str = "n") -> DataFrame:
    """One column per taxon, for hand-over to other tools; the taxa are given, so no
    extra pass looks for them."""
    return values.groupBy("sample").pivot("taxon", taxa).agg(F.first(value)).na.fill(0)


def from_wide(wide: DataFrame, key: str = "sample") -> DataFrame:
    """The long table of a wide one, without zeros."""
    taxa = [c for c in wide.columns if c != key]
    # Quoted: taxa have dots in their names.
    long = wide.select(F.col(f"`{key}`").alias("__key"), F.explode(F.array(*(F.struct(F.lit(t).alias("taxon"), F.col(f"`{t}`").alias("n")) for t in taxa))).alias("c")).select(F.col("__key").alias(key), "c.*")
    return long.filter("n != 0").select(F.col(key).alias("sample"), "taxon", F.col("n").cast("bigint").alias("n"))
