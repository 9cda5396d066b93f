"""Quality control with an audit trail, cohorts, and project summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qc_flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``(kept, flow)``: rows that pass all steps, and per step what came in, went and
    stayed.  A step passes unless its condition is exactly false.  All steps are counted
    in one pass."""
    passes = [F.coalesce(condition, F.lit(True)) for _, condition in steps]
    upto, counted = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for k, p in enumerate(passes):
        upto = upto & p
        counted.append(F.count_if(upto).alias(f"c{k + 1}"))
    one = df.agg(*counted)
    rows = F.array(*(F.struct(F.lit(k + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"c{k}").alias("n_in"), (F.col(f"c{k}") - F.col(f"c{k + 1}")).alias("n_removed"), F.col(f"c{k + 1}").alias("n_out")) for k, (name, _) in enumerate(steps)))
    return df.filter(upto), one.select(F.explode(rows).alias("r")).select("r.*")


def label_crosstab(df: DataFrame, labels: Sequence[str] = ("healthy", "case"), projects: DataFrame | None = None, label: str = "disease_label") -> DataFrame:
    """Rows per project and label, zeros included, for all given projects."""
    base = df.filter("project IS NOT NULL")
    counts = base.groupBy("project").agg(*(F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels))
    spine = (projects if projects is not None else base).select("project").distinct()
    return spine.join(counts, "project", "left").na.fill(0)


def within_project_cohort(df: DataFrame, confirmed: DataFrame, min_cases: int = 10, min_controls: int = 10) -> tuple[DataFrame, DataFrame]:
    """Labelled rows of confirmed projects with enough of both, and the projects that
    fell short with their counts."""
    tab = label_crosstab(df.filter("disease_label IS NOT NULL"), projects=confirmed)
    enough = (F.col("n_case") >= min_cases) & (F.col("n_healthy") >= min_controls)
    keep = tab.filter(enough).select("project")
    return df.filter("disease_label IS NOT NULL").join(keep, "project", "left_semi"), tab.filter(~enough)


def labelled_cohort(df: DataFrame) -> DataFrame:
    return df.filter("disease_label IS NOT NULL")


def healthy_baseline(df: DataFrame) -> DataFrame:
    """Controls of projects without any case."""
    none = label_crosstab(df.filter("disease_label IS NOT NULL")).filter("n_case = 0 AND n_healthy > 0").select("project")
    return df.filter("disease_label = 'healthy'").join(none, "project", "left_semi")


def project_summary(df: DataFrame, first: Sequence[str], modes: Sequence[str], order: str = "row_id") -> DataFrame:
    """Per project: size, first non-null value by ``order``, most frequent value (ties:
    least), cases and controls."""
    base = df.filter("project IS NOT NULL")
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return base.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_samples"), *firsts, *(F.mode(c, True).alias(c) for c in modes),
        F.count_if(F.col("disease_label") == "healthy").alias("n_controls"), F.count_if(F.col("disease_label") == "case").alias("n_cases"),
    )


def depth_richness_curve(depths: DataFrame, bins: int = 40) -> DataFrame:
    """Median depth and mean richness in bins of equal width of log10 depth, closed on the
    right, the lowest edge included."""
    logs = depths.withColumn("x", F.log10(F.greatest(F.col("depth"), F.lit(1))))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.ceil((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) - 1).otherwise(0)
    binned = logs.join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int"))
    return binned.groupBy("bin").agg(F.percentile("depth", 0.5).alias("median_depth"), F.avg("n_nonzero").alias("mean_richness"), F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, column: str, bins: int = 5, name: str = "bin") -> DataFrame:
    """Bins between linearly interpolated quantiles, closed on the right, from 0."""
    edges = df.agg(F.percentile(column, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("__e"))
    place = F.size(F.filter(F.slice("__e", 2, bins - 1), lambda e: e < F.col(column)))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), place)).drop("__e")


def histogram(df: DataFrame, column: str, width: float, start: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins ``[start + k width, start + (k + 1) width)``."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by, F.floor((F.col(column) - start) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Counts in bins of equal width on a log10 scale."""
    x = df.filter(F.col(column) > 0).select(F.log10(column).alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))
    return x.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df: DataFrame, x: Column, y: Column, dx: float, dy: float) -> DataFrame:
    """Two-dimensional bin counts."""
    return df.groupBy(F.floor(x / dx).alias("bx"), F.floor(y / dy).alias("by")).agg(F.count(F.lit(1)).alias("n"))
