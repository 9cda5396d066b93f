"""Reports and plot data: small frames formatted by the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3, max_rows: int = MAX_ROWS) -> str:
    """A table of a small result; more than ``max_rows`` rows raise."""
    rows = (df.select(*columns) if columns else df).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows: aggregate first")
    names = list(columns or df.columns)
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def flow_report(flow: DataFrame, sizes: dict[str, int]) -> str:
    out = ["# Sample flow", "", markdown_table(flow.orderBy("step_no"), ["step", "n_in", "n_removed", "n_out"]), "", "## Cohorts", ""]
    return "\n".join([*out, *(f"- {name}: {n}" for name, n in sizes.items()), ""])


def coverage_report(coverage: DataFrame) -> str:
    return "# Coverage\n\n" + markdown_table(coverage.orderBy(F.desc("pct_filled")), ["column_name", "n_filled", "pct_filled"]) + "\n"


def section(text: str, heading: str) -> str:
    """The part of a markdown text under one heading, without it."""
    level = None
    kept: list[str] = []
    for line in text.split("\n"):
        mark = re.match(r"(#+)\s+(.*?)\s*$", line)
        if level is None:
            if mark and mark[2] == heading:
                level = len(mark[1])
        elif mark and len(mark[1]) <= level:
            break
        else:
            kept.append(line)
    return "\n".join(kept).strip()


def demote(text: str, by: int = 1) -> str:
    return re.sub(r"(?m)^(#+)(\s)", lambda m: "#" * (len(m[1]) + by) + m[2], text)


def assemble(title: str, parts: Sequence[tuple[str, str]]) -> str:
    """One report of several, each under its own heading."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{demote(body, 2)}" for name, body in parts)]) + "\n"


def profile_text(profile: DataFrame, per_field: int = 10) -> DataFrame:
    """One line of text per field: its size and most frequent values."""
    w = Window.partitionBy("tag").orderBy(F.desc("n"), "value")
    best = profile.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_field)
    cell = F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return best.groupBy("tag", "n_samples").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", cell.alias("t")))), lambda x: x["t"]), ", ").alias("values")).select("tag", F.concat("tag", F.lit(": "), F.col("n_samples").cast("string"), F.lit(" samples; "), "values").alias("line"))


# Data behind figures; drawing is for whoever has a plotting library.


def prevalence_marks(prevalence: DataFrame, marks: Sequence[float] = (0.5, 0.1, 0.01)) -> DataFrame:
    """How many taxa reach each mark of the prevalence curve."""
    return prevalence.select(F.explode(F.filter(F.array(*(F.lit(float(m)) for m in marks)), lambda m: m <= F.col("prevalence"))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n_taxa"))


def level_counts(df: DataFrame, column: Column, top: int | None = None) -> DataFrame:
    """Counts of levels, null or NA as unresolved; the ``top`` most frequent."""
    level = F.when(column.isNull() | column.isin("NA", ""), F.lit("unresolved")).otherwise(column)
    out = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level")
    return out.limit(top) if top else out


def balance(counts: DataFrame) -> DataFrame:
    """Projects with cases and controls, largest first."""
    return counts.filter("n_case > 0 AND n_healthy > 0").withColumn("total", F.col("n_case") + F.col("n_healthy")).orderBy(F.desc("total"), "project")


def top_taxa(means: DataFrame, k: int = 20) -> DataFrame:
    return means.orderBy(F.desc("mean_relative"), "taxon").limit(k)


def volcano(meta: DataFrame, labels: int = 6) -> DataFrame:
    """Effect against -log10 q, the strongest named."""
    w = Window.partitionBy("disease_category").orderBy("q", F.desc(F.abs("pooled_effect")), "taxon")
    return meta.filter("q IS NOT NULL").select("disease_category", "taxon", "pooled_effect", (-F.log10(F.greatest(F.col("q"), F.lit(1e-300)))).alias("minus_log10_q"), (F.row_number().over(w) <= labels).alias("named"))


def with_metadata(coords: DataFrame, metadata: DataFrame) -> DataFrame:
    return coords.join(metadata, "sample")
