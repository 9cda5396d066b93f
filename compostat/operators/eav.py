"""Entity-attribute-value metadata: ``tags (row_id, project, srr, tag, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parse import is_number


def field_census(tags: DataFrame) -> DataFrame:
    """Rows, samples, projects and distinct values of every tag."""
    return tags.filter("tag IS NOT NULL").groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("srr").alias("n_samples"), F.count_distinct("project").alias("n_projects"), F.count_distinct("value").alias("n_distinct_values"),
    ).orderBy(F.desc("n_rows"), "tag")


def value_counts(tags: DataFrame, by: Sequence[str] = ("tag",)) -> DataFrame:
    return tags.filter("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(tags: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each group, as a JSON list of value and count."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    best = value_counts(tags, by).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return best.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))).alias("top_values"))


def categorical_profile(tags: DataFrame, min_samples: int = 30, value_range: tuple[int, int] = (2, 25)) -> DataFrame:
    """Value counts of tags that look categorical: enough samples, few distinct values."""
    fit = tags.groupBy("tag").agg(F.count_distinct("srr").alias("n_samples"), F.count_distinct("value").alias("n_values")).filter((F.col("n_samples") >= min_samples) & F.col("n_values").between(*value_range))
    return value_counts(tags).join(fit, "tag").select("tag", "n_samples", "n_values", "value", "n")


def without_negatives(df: DataFrame, negatives: DataFrame) -> DataFrame:
    """Without (tag, project) pairs of ``negatives (field, project)``; a null project
    there stands for all."""
    hit = (df["tag"] == negatives["field"]) & (negatives["project"].isNull() | (negatives["project"] == df["project"]))
    return df.join(F.broadcast(negatives.select("field", "project")), hit, "left_anti")


def label_candidates(
    tags: DataFrame,
    projects: DataFrame,
    name_words: Sequence[str],
    abbreviations: dict[str, Sequence[str]],
    control_tokens: Sequence[str],
    case_tokens: Sequence[str],
    review: DataFrame | None = None,
    negatives: DataFrame | None = None,
    value_range: tuple[int, int] = (2, 25),
    top: int = 5,
) -> DataFrame:
    """(project, tag) pairs that may hold case/control labels: by the field's name, by
    an abbreviation of the project's condition in the name, or by values with both a
    control and a case word; and reviewed pairs that weren't found wrong."""
    scoped = tags.filter("project IS NOT NULL AND tag IS NOT NULL")
    low = F.lower("value")
    seen = scoped.groupBy("project", "tag").agg(
        F.count_distinct("value").alias("n_values"), F.count_distinct("srr").alias("n_samples"),
        F.coalesce(F.bool_or(X.has_any(low, control_tokens)), F.lit(False)).alias("has_control"), F.coalesce(F.bool_or(X.has_any(low, case_tokens)), F.lit(False)).alias("has_case"),
    )
    if review is not None:
        reviewed = review.filter("bucket != 'FALSE_POSITIVE'").select("project", F.col("field").alias("tag")).distinct().withColumn("route_reviewed", F.lit(True))
        seen = seen.join(reviewed, ["project", "tag"], "full_outer")
    else:
        seen = seen.withColumn("route_reviewed", F.lit(False))
    pairs = seen.filter(F.col("n_values").between(*value_range) | F.col("route_reviewed"))
    condition = F.lower(F.coalesce("condition", F.lit("")))
    by_phrase = F.lit(False)
    for phrase, short in abbreviations.items():
        by_phrase = by_phrase | (condition.contains(phrase) & F.arrays_overlap(X.name_tokens(F.col("tag")), F.array(*map(F.lit, short))))
    routed = pairs.join(projects.select("project", "condition"), "project", "left").select(
        "project", "tag", F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
        X.name_matches(F.col("tag"), name_words).alias("route_name"), by_phrase.alias("route_condition"),
        F.coalesce(F.col("has_control") & F.col("has_case"), F.lit(False)).alias("route_values"), F.coalesce("route_reviewed", F.lit(False)).alias("route_reviewed"),
    ).filter("route_name OR route_condition OR route_values OR route_reviewed")
    if negatives is not None:
        routed = without_negatives(routed, negatives)
    return routed.join(top_values(scoped, ["project", "tag"], top), ["project", "tag"], "left")


def within_contrasts(tags: DataFrame, candidates: DataFrame, cleaned: Column, review: DataFrame, min_per_side: int = 15) -> DataFrame:
    """Candidates with their review bucket and the values left by the null rules;
    confirmed ones need ``min_per_side`` cases and controls."""
    left = tags.withColumn("value", cleaned).filter("value IS NOT NULL").groupBy("project", "tag").agg(F.count_distinct("value").alias("n_values_after_null"), F.count(F.lit(1)).alias("n_rows_after_null"))
    marked = candidates.select("project", "tag").join(review.withColumnRenamed("field", "tag"), ["project", "tag"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("NEEDS_REVIEW")))
    out = marked.join(left, ["project", "tag"], "left").na.fill(0, ["n_values_after_null", "n_rows_after_null"])
    small = (F.col("bucket") == "CONFIRMED") & ~((F.col("controls") >= min_per_side) & (F.col("cases") >= min_per_side)).eqNullSafe(True)
    return out.filter(~small)


def corruption_census(tags: DataFrame, word_fields: Sequence[str], number_fields: Sequence[str], date_fields: Sequence[str], year: Column) -> DataFrame:
    """Per field: values, bare numbers, non-numbers, and dates that have no year."""
    fields = [*word_fields, *number_fields, *date_fields]
    number = is_number(F.col("value"))
    return tags.filter(F.col("tag").isin(fields) & F.col("value").isNotNull()).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(number).alias("n_numeric"), F.count_if(~number).alias("n_non_numeric"),
        F.count_if(F.col("tag").isin(list(date_fields)) & year.isNull()).alias("n_unparseable"),
    )


def pivot_concepts(tags: DataFrame, tag_map: dict[str, Sequence[str]], cleaned: Column | None = None) -> DataFrame:
    """One row per sample: for every concept the first usable value, by the order of its
    source tags and then of rows, and the tag it came from.  One shuffle for all
    concepts."""
    ranked = [(concept, tag, k) for concept, tags_ in tag_map.items() for k, tag in enumerate(tags_)]
    source = F.broadcast(tags.sparkSession.createDataFrame(ranked, "concept string, tag string, priority int"))
    value = cleaned if cleaned is not None else F.col("value")
    usable = tags.withColumn("value", value).join(source, "tag").withColumn("at", F.when(F.col("value").isNotNull(), F.struct("priority", "row_id")))
    columns = []
    for concept in tag_map:
        mine = F.when(F.col("concept") == concept, F.col("at"))
        columns += [F.min_by("value", mine).alias(concept), F.min_by("tag", mine).alias(f"{concept}_source_tag")]
    wide = usable.filter("at IS NOT NULL").groupBy("srr").agg(*columns)
    return tags.select("srr").distinct().join(wide, "srr", "left")


def self_report(tags: DataFrame, fields: Sequence[str], vocabulary: dict[str, int | None], merges: dict[str, dict[str, int | None]] | None = None) -> DataFrame:
    """Per field the first known evidence (0 to 3) of a sample, and status: 1 for evidence
    3, 0 for 0, else null."""
    names = {f: "".join(c if c.isalnum() else "_" for c in f.lower()).strip("_") for f in fields}
    bare = X.clean(F.col("value"))
    columns = []
    for f in fields:
        words = {**{k.lower(): v for k, v in vocabulary.items()}, **{k.lower(): v for k, v in (merges or {}).get(f, {}).items()}}
        known = {k: v for k, v in words.items() if v is not None}
        level = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[bare].cast("double") if known else F.lit(None).cast("double")
        mine = F.when((F.col("tag") == f) & level.isNotNull(), F.col("row_id"))
        columns.append(F.min_by(level, mine).alias(f"sr_{names[f]}_evidence"))
    wide = tags.groupBy("srr").agg(*columns)
    status = {f"sr_{n}_status": F.when(F.col(f"sr_{n}_evidence") == 3, 1.0).when(F.col(f"sr_{n}_evidence") == 0, 0.0) for n in names.values()}
    return wide.withColumns(status)


def join_spine(spine: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str], suffix: str = "_wide") -> DataFrame:
    """Left joins onto the spine, one row of each part per key.  Clashing columns of a
    part get the suffix.  A repeated key in a part raises, as rows would multiply."""
    out = spine
    for part, key in zip(parts, keys, strict=True):
        renamed = part.select(*(F.col(c).alias(c if c == key or c not in out.columns else c + suffix) for c in part.columns))
        w = Window.partitionBy(key)
        once = renamed.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col(key).isNotNull())
        once = once.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("bigint")).otherwise(F.col("__n")))
        out = out.join(once.filter("__n = 1").drop("__n"), key, "left")
    return out


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count and per cent of each column."""
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(c).alias(c) for c in columns))
    return sums.unpivot("n_rows", list(columns), "column_name", "n_filled").withColumn("pct_filled", F.col("n_filled") * 100.0 / F.col("n_rows"))


def comissingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of missingness for all pairs of columns that vary; one pass."""
    gone = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(gone[c]).alias(f"s_{c}") for c in columns), *(F.sum(gone[a] * gone[b]).alias(f"p_{a}|{b}") for a, b in pairs))
    made = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s_{a}").alias("x"), F.col(f"s_{b}").alias("y"), F.col(f"`p_{a}|{b}`").alias("xy")) for a, b in pairs))
    e = row.select("n", F.explode(made).alias("e")).select("n", "e.*")
    varies = (F.col("x") > 0) & (F.col("x") < F.col("n")) & (F.col("y") > 0) & (F.col("y") < F.col("n"))
    r = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt((F.col("n") * F.col("x") - F.col("x") * F.col("x")) * (F.col("n") * F.col("y") - F.col("y") * F.col("y")))
    return e.filter(varies).select(F.col("a").alias("column_a"), F.col("b").alias("column_b"), r.alias("r"))
