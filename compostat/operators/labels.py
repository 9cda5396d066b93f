"""Labels from curated fields: which values of a field are controls, which cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def subset_with_sum(counts: Sequence[int], target: int) -> list[int] | None:
    """Places of a subset that sums to the target; of several, the one that keeps the
    largest counts first.  Places are tried by falling count, then as given.  A table
    of reachable remainders keeps this from branching without end."""
    if target == 0:
        return []
    order = sorted(range(len(counts)), key=lambda k: (-counts[k], k))
    # reach[i]: sums that the i-th and later items can make.
    reach = [{0}]
    for k in reversed(order):
        reach.insert(0, reach[0] | {s + counts[k] for s in reach[0] if s + counts[k] <= target})
    if target not in reach[0]:
        return None
    chosen, rest = [], target
    for i, k in enumerate(order):
        if rest == 0:
            break
        if counts[k] <= rest and rest - counts[k] in reach[i + 1]:
            chosen.append(k)
            rest -= counts[k]
    return chosen


def resolve_values(counts: dict[str, int], controls: int, cases: int) -> dict[str, str] | None:
    """Value to ``healthy`` or ``case``; None if the counts can't be made up."""
    values = list(counts)
    low = subset_with_sum([counts[v] for v in values], controls)
    if low is None:
        return None
    taken = {values[k] for k in low}
    rest = [v for v in values if v not in taken]
    high = subset_with_sum([counts[v] for v in rest], cases)
    if high is None:
        return None
    return {**{v: "healthy" for v in taken}, **{rest[k]: "case" for k in high}}


def resolved_contrasts(value_counts: DataFrame, review: DataFrame) -> DataFrame:
    """``(project, tag, value, label)`` of confirmed pairs by subset sums.
    ``value_counts (project, tag, value, n, first_row)`` is small per pair (a field has
    few values), so each pair is one group."""
    asked = value_counts.join(review.filter("bucket = 'CONFIRMED'").select("project", F.col("field").alias("tag"), F.col("controls").cast("bigint").alias("controls"), F.col("cases").cast("bigint").alias("cases")), ["project", "tag"])

    def solve(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["n", "first_row"], ascending=[False, True], kind="stable")
        found = resolve_values(dict(zip(pdf["value"], pdf["n"].astype(int), strict=True)), int(pdf["controls"].iloc[0]), int(pdf["cases"].iloc[0])) or {}
        return pd.DataFrame({"project": key[0], "tag": key[1], "value": list(found), "label": list(found.values())}, columns=["project", "tag", "value", "label"])

    return asked.groupBy("project", "tag").applyInPandas(solve, "project string, tag string, value string, label string")


def healthy_only(value_counts: DataFrame, control_tokens: Sequence[str], family_fields: Sequence[str], family_controls: Sequence[str]) -> DataFrame:
    """Values of pairs all of whose values are control words; none of the others."""
    bare = X.clean(F.col("value"))
    fine = F.when(F.col("tag").isin(list(family_fields)), bare.isin(list(family_controls))).otherwise(X.has_any(bare, [t.lower() for t in control_tokens]))
    marked = value_counts.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = marked.groupBy("project", "tag").agg(F.bool_and("fine").alias("ok")).filter("ok").select("project", "tag")
    return marked.join(good, ["project", "tag"], "left_semi").select("project", "tag", "value", F.lit("healthy").alias("label"))


def derive_labels(tags: DataFrame, cleaned: Column, review: DataFrame, control_tokens: Sequence[str], family_fields: Sequence[str], family_controls: Sequence[str], rules: Sequence[tuple[Sequence[str], str]], conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labels, unresolved)`` for all curated pairs in one grouped pass: label, category
    (of cases: by rule, else the project's condition category) and source field."""
    curated = review.filter("bucket IN ('CONFIRMED', 'HEALTHY_ONLY')").select("project", F.col("field").alias("tag"), "bucket", "controls", "cases")
    scoped = tags.join(curated.select("project", "tag", "bucket"), ["project", "tag"]).withColumn("value", cleaned).filter("value IS NOT NULL")
    counts = scoped.groupBy("project", "tag", "bucket", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    split = resolved_contrasts(counts.filter("bucket = 'CONFIRMED'").drop("bucket"), review)
    whole = healthy_only(counts.filter("bucket = 'HEALTHY_ONLY'").drop("bucket"), control_tokens, family_fields, family_controls)
    known = split.unionByName(whole)
    category = F.coalesce(X.first_rule(F.col("value"), rules, None), F.col("condition_category"), F.lit("other"))
    labels = (
        scoped.join(known, ["project", "tag", "value"])
        .join(conditions.select("project", "condition_category"), "project", "left")
        .select("srr", "project", F.col("label").alias("disease_label"), F.when(F.col("label") == "case", category).alias("disease_category"), F.col("tag").alias("disease_field"))
    )
    unresolved = curated.select("project", "tag", "bucket").join(known.select("project", "tag").distinct(), ["project", "tag"], "left_anti")
    return labels, unresolved
