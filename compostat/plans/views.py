"""The engine's tables as views of the driver's: counts, samples, frames, tags, vectors;
each with the SQL that defines the same view elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers are samples, part types with brands taxa, ordered quantities reads."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = load(spark, d, "part").select("p_partkey", F.concat_ws(".", "p_type", "p_brand").alias("taxon"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy(F.col("o_custkey").cast("string").alias("sample"), "taxon").agg(F.sum("l_quantity").cast("bigint").alias("n"))


COUNTS = """counts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS sample, p_type || '.' || p_brand AS taxon, CAST(sum(l_quantity) AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Regions are projects, segments disease categories, balances tell case from control."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    met = c.join(F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select(
        F.col("c_custkey").alias("row_id"), F.col("c_custkey").cast("string").alias("sample"), F.col("r_name").alias("project"), F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("disease_category"), F.when(F.col("c_acctbal") >= 4500, "case").otherwise("healthy").alias("disease_label"), "c_acctbal",
    )


SAMPLES = """samples AS (
  SELECT c_custkey AS row_id, CAST(c_custkey AS VARCHAR) AS sample, r_name AS project, n_name AS nation, c_mktsegment AS disease_category,
         CASE WHEN c_acctbal >= 4500 THEN 'case' ELSE 'healthy' END AS disease_label, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def frame(spark: SparkSession, d: str) -> DataFrame:
    """Every sample under its own category."""
    return samples(spark, d).select("sample", "project", "disease_category", (F.col("disease_label") == "case").cast("int").alias("y"))


FRAME = "frame AS (SELECT sample, project, disease_category, CAST(disease_label = 'case' AS INT) AS y FROM samples)"


def frame_with_covariates(spark: SparkSession, d: str) -> DataFrame:
    """The frame with an age that some samples lack (half of those in one project) and a sex."""
    c = F.col("row_id")
    age = F.when(c % F.when(F.col("project") == "ASIA", 2).otherwise(11) > 0, (c * 37 % 83).cast("double"))
    sex = F.when(c % 19 == 0, F.lit(None).cast("string")).when(c % 3 == 0, "Male").when(c % 17 == 0, "unknown").otherwise("female")
    return samples(spark, d).select("sample", "project", "disease_category", (F.col("disease_label") == "case").cast("int").alias("y"), age.alias("age"), sex.alias("sex"))


FRAME_COV = """framec AS (SELECT sample, project, disease_category, CAST(disease_label = 'case' AS INT) AS y,
  CASE WHEN row_id % CASE WHEN project = 'ASIA' THEN 2 ELSE 11 END > 0 THEN CAST(row_id * 37 % 83 AS DOUBLE) END AS age FROM samples)"""


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Events as attribute values, with the usual words for missing."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    word = F.element_at(F.array(*map(F.lit, TAG_WORDS)), k % len(TAG_WORDS) + 1)
    return load(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("P"), (F.col("user_id") % 6).cast("string")).alias("project"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("srr"),
        F.concat_ws("_", F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "status").otherwise("cd")).alias("tag"), F.when(word == "#", k.cast("string")).otherwise(word).alias("value"),
    )


TAG_WORDS = ["healthy", "Case", " NA ", "none", "control group", "positive", "Not Provided", "#", "no", "17-29 yo", "2011-01-02"]
TAGS = f"""tags AS (
  SELECT event_id AS row_id, 'P' || CAST(user_id % 6 AS VARCHAR) AS project, 'S' || CAST(user_id AS VARCHAR) AS srr,
         event_type || CASE WHEN user_id % 2 = 0 THEN '_status' ELSE '_cd' END AS tag,
         CASE WHEN w = '#' THEN CAST(k AS VARCHAR) ELSE w END AS value
  FROM (SELECT *, list_extract({TAG_WORDS!r}, k % {len(TAG_WORDS)} + 1) AS w
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)))"""


_FIELDS = {
    "age": "CASE event_id % 16 WHEN 0 THEN concat(k, '-', k + 12, ' yo') WHEN 1 THEN concat('>=', k) WHEN 2 THEN concat('<', k) WHEN 3 THEN concat(k, ' Months') WHEN 4 THEN concat(k) WHEN 5 THEN concat(k, '.5') WHEN 6 THEN concat('child ', k, '-year visit') WHEN 7 THEN concat(k + 100) WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN '>abc' WHEN 11 THEN concat(' ', k, ' - ', k + 2, ' weeks') WHEN 12 THEN concat(k, 'y') WHEN 13 THEN concat(k, ' dogs') WHEN 14 THEN concat(k, '-', k + 3) ELSE event_type END",
    "unit": "CASE user_id % 6 WHEN 0 THEN 'years' WHEN 1 THEN 'Weeks ' WHEN 2 THEN NULL WHEN 3 THEN concat(k) WHEN 4 THEN concat(k, '.25') ELSE 'month' END",
    "subjects": "CASE user_id % 5 WHEN 0 THEN 'Preterm Infants' WHEN 1 THEN 'adults' WHEN 2 THEN 'NEONATAL ward' WHEN 3 THEN NULL ELSE event_type END",
    "taken": "CASE event_id % 12 WHEN 0 THEN concat(1985 + k % 40, '-0', 1 + k % 9, '-1', k % 9) WHEN 1 THEN concat(2000 + k % 20, '-01-01/2014-12-31') WHEN 2 THEN concat(1980 + k, '-07') WHEN 3 THEN concat(1980 + k % 45) WHEN 4 THEN '-' WHEN 5 THEN '0000-00-00' WHEN 6 THEN concat(1970 + k, ' or so') WHEN 7 THEN NULL WHEN 8 THEN concat('spring ', 1985 + k % 40) WHEN 9 THEN concat(2000 + k % 20, '/2012') WHEN 10 THEN concat('no ', k) ELSE concat(' ', 1995 + k % 25, ' ') END",
    "host": "concat(CASE user_id % 7 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'human a' WHEN 2 THEN 'infant' WHEN 3 THEN ' HOMO ' WHEN 4 THEN 'mouse' WHEN 5 THEN 'male, 4 months' END, CASE WHEN event_id % 5 = 0 THEN ' mouse' ELSE '' END)",
    "sex": "CASE event_id % 8 WHEN 0 THEN 'male' WHEN 1 THEN 'famale' WHEN 2 THEN concat(k) WHEN 3 THEN 'not providednot provided' WHEN 4 THEN 'Female ' WHEN 5 THEN NULL WHEN 6 THEN 'MALE' ELSE event_type END",
}
_FIELDS_OF = ", ".join(f"{e} AS {c}" for c, e in _FIELDS.items())
FIELDS = f"fields AS (SELECT event_id AS id, {_FIELDS_OF} FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))".replace("concat(CASE user_id", "(CASE user_id").replace("END, CASE WHEN event_id % 5 = 0", "END || CASE WHEN event_id % 5 = 0")


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of messy fields: ages, units, dates, hosts, sexes."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return load(spark, d, "events").withColumn("k", k).selectExpr("event_id AS id", *(f"{e} AS {c}" for c, e in _FIELDS.items()))


_LINEAGE = "concat(p_brand, '.', p_type, '.', CASE WHEN p_partkey % 4 = 0 THEN 'NA' ELSE concat('C', p_size) END, '.', CASE WHEN p_partkey % 6 = 0 THEN 'NA' ELSE concat('O', p_size % 7) END, '.', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, '.', CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE p_name END, CASE WHEN p_partkey % 7 = 0 THEN '.1 [x]' ELSE '' END)"
LINEAGES = f"lineages AS (SELECT p_partkey AS id, {_LINEAGE} AS full_string FROM part)"


def lineages(spark: SparkSession, d: str) -> DataFrame:
    """Parts as dotted lineages of six ranks, some unresolved, some with further dots."""
    return load(spark, d, "part").selectExpr("p_partkey AS id", f"{_LINEAGE} AS full_string")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("project"))


VECTORS = "vectors AS (SELECT vec_id AS sample, CAST(embedding AS DOUBLE[]) AS vec, label AS project FROM embeddings)"
