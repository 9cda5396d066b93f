"""Registered queries: attribute-value metadata, text rules and grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..functions import parse as P
from ..functions import text as X
from ..operators import cohorts as H
from ..operators import eav as E
from ..operators import labels as L
from . import views as V
from .queries_data import r6
from .views import COUNTS, SAMPLES, TAGS, FIELDS

EVERYWHERE = ["na", "not provided", ""]
CONDITIONAL = {"none": ["view_status", "click_cd"], "no": ["view_status"]}
NULLED = """(CASE WHEN lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) IN ('na', 'not provided', '')
  OR (lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) = 'none' AND tag NOT IN ('view_status', 'click_cd'))
  OR (lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) = 'no' AND tag NOT IN ('view_status')) THEN NULL ELSE value END)"""


def nulled():
    return X.apply_null_rules(F.col("value"), F.col("tag"), EVERYWHERE, CONDITIONAL)


@query(f"WITH {TAGS} SELECT tag, count(*) AS n_rows, count(DISTINCT srr) AS n_samples, count(DISTINCT project) AS n_projects, count(DISTINCT value) AS n_distinct_values FROM tags GROUP BY tag")
def field_census(spark, d):
    return E.field_census(V.tags(spark, d))


@query(f"""WITH {TAGS}, f AS (SELECT tag, count(DISTINCT srr) AS n_samples, count(DISTINCT value) AS n_values FROM tags GROUP BY tag HAVING count(DISTINCT srr) >= 30 AND count(DISTINCT value) BETWEEN 2 AND 25)
SELECT tag, n_samples, n_values, value, count(*) AS n FROM tags JOIN f USING (tag) GROUP BY ALL""")
def categorical_profile(spark, d):
    return E.categorical_profile(V.tags(spark, d))


@query(f"WITH {TAGS} SELECT row_id, tag, value, {NULLED} AS cleaned FROM tags")
def null_rules(spark, d):
    return V.tags(spark, d).select("row_id", "tag", "value", nulled().alias("cleaned"))


_TOP = """top AS (SELECT project, tag, to_json(list({'value': value, 'n': n} ORDER BY k)) AS top_values FROM (
  SELECT *, row_number() OVER (PARTITION BY project, tag ORDER BY n DESC, value) AS k FROM (SELECT project, tag, value, count(*) AS n FROM tags GROUP BY 1, 2, 3)) WHERE k <= 3 GROUP BY 1, 2)"""
_REVIEW = "review AS (SELECT * FROM (VALUES ('P0', 'view_status', 'CONFIRMED', 20.0, 20.0), ('P1', 'view_cd', 'FALSE_POSITIVE', 1.0, 1.0), ('P9', 'missing_tag', 'CONFIRMED', 3.0, 30.0), ('P3', 'click_cd', 'HEALTHY_ONLY', NULL, NULL)) AS t(project, field, bucket, controls, cases))"


def _review(spark):
    return spark.createDataFrame([("P0", "view_status", "CONFIRMED", 20.0, 20.0), ("P1", "view_cd", "FALSE_POSITIVE", 1.0, 1.0), ("P9", "missing_tag", "CONFIRMED", 3.0, 30.0), ("P3", "click_cd", "HEALTHY_ONLY", None, None)], "project string, field string, bucket string, controls double, cases double")


def _candidates(spark, d):
    projects = spark.createDataFrame([(f"P{i}", "Crohn disease" if i % 3 == 0 else None) for i in range(6)], "project string, condition string")
    negatives = spark.createDataFrame([("error_status", None), ("click_cd", "P4")], "field string, project string")
    return E.label_candidates(V.tags(spark, d), projects, ["status"], {"crohn": ["cd", "ibd"]}, ["healthy", "control"], ["positive", "case"], _review(spark), negatives, (2, 60), 3)


_CANDIDATES = f"""WITH {TAGS}, {_REVIEW}, {_TOP},
g AS (SELECT project, tag, count(DISTINCT value) AS v, count(DISTINCT srr) AS n_samples, bool_or(contains(lower(value), 'healthy') OR contains(lower(value), 'control')) AS a, bool_or(contains(lower(value), 'positive') OR contains(lower(value), 'case')) AS b FROM tags GROUP BY 1, 2),
s AS (SELECT coalesce(g.project, r.project) AS project, coalesce(g.tag, r.field) AS tag, v, n_samples, a AND b AS route_values, r.field IS NOT NULL AS route_reviewed FROM g FULL JOIN (SELECT * FROM review WHERE bucket <> 'FALSE_POSITIVE') r ON g.project = r.project AND g.tag = r.field),
c AS (SELECT project, tag, coalesce(n_samples, 0) AS n_samples, contains(tag, 'status') AS route_name, project IN ('P0', 'P3') AND len(list_intersect(regexp_split_to_array(lower(tag), '[^a-z0-9]+'), ['cd', 'ibd'])) > 0 AS route_condition, coalesce(route_values, FALSE) AS route_values, route_reviewed FROM s WHERE v BETWEEN 2 AND 60 OR route_reviewed)
"""


@query(_CANDIDATES + "SELECT c.*, top_values FROM c LEFT JOIN top USING (project, tag) WHERE (route_name OR route_condition OR route_values OR route_reviewed) AND tag <> 'error_status' AND NOT (tag = 'click_cd' AND project = 'P4')")
def label_candidates(spark, d):
    return _candidates(spark, d)


@query(_CANDIDATES + f""", k AS (SELECT project, tag FROM c WHERE (route_name OR route_condition OR route_values OR route_reviewed) AND tag <> 'error_status' AND NOT (tag = 'click_cd' AND project = 'P4')),
l AS (SELECT project, tag, count(DISTINCT cleaned) AS dv, count(*) AS dr FROM (SELECT *, {NULLED} AS cleaned FROM tags) WHERE cleaned IS NOT NULL GROUP BY 1, 2)
SELECT k.project, k.tag, coalesce(r.bucket, 'NEEDS_REVIEW') AS bucket, controls, cases, coalesce(dv, 0) AS n_values_after_null, coalesce(dr, 0) AS n_rows_after_null
FROM k LEFT JOIN review r ON k.project = r.project AND k.tag = r.field LEFT JOIN l ON k.project = l.project AND k.tag = l.tag WHERE NOT (coalesce(r.bucket, 'NEEDS_REVIEW') = 'CONFIRMED' AND NOT (controls >= 15 AND cases >= 15))""")
def within_contrasts(spark, d):
    return E.within_contrasts(V.tags(spark, d), _candidates(spark, d), nulled(), _review(spark))


@query(f"""WITH {TAGS} SELECT tag, count(*) AS n_total, count(*) FILTER (WHERE regexp_matches(value, '^[0-9]+(\\.[0-9]+)?$')) AS n_numeric, count(*) FILTER (WHERE NOT regexp_matches(value, '^[0-9]+(\\.[0-9]+)?$')) AS n_non_numeric,
  count(*) FILTER (WHERE tag = 'click_status' AND value <> '2011-01-02') AS n_unparseable FROM tags WHERE tag IN ('view_cd', 'signup_cd', 'click_status') GROUP BY tag""")
def corruption_census(spark, d):
    return E.corruption_census(V.tags(spark, d), ["view_cd"], ["signup_cd"], ["click_status"], P.parse_year(F.col("value"), bounds=(1990, 2022)))


_PIVOT = f"""WITH {TAGS}, m AS (SELECT * FROM (VALUES ('visit', 'view_status', 0), ('visit', 'view_cd', 1), ('trade', 'purchase_cd', 0), ('trade', 'signup_status', 1)) AS t(concept, tag, priority)),
u AS (SELECT srr, concept, tag, cleaned, row_number() OVER (PARTITION BY srr, concept ORDER BY priority, row_id) AS k FROM (SELECT *, {NULLED} AS cleaned FROM tags) JOIN m USING (tag) WHERE cleaned IS NOT NULL),
w AS (SELECT srr, max(cleaned) FILTER (WHERE concept = 'visit') AS visit, max(tag) FILTER (WHERE concept = 'visit') AS visit_source_tag, max(cleaned) FILTER (WHERE concept = 'trade') AS trade, max(tag) FILTER (WHERE concept = 'trade') AS trade_source_tag FROM u WHERE k = 1 GROUP BY srr)"""


def _concepts(spark, d):
    return E.pivot_concepts(V.tags(spark, d), {"visit": ["view_status", "view_cd"], "trade": ["purchase_cd", "signup_status"]}, nulled())


@query(_PIVOT + " SELECT s.srr, visit, visit_source_tag, trade, trade_source_tag FROM (SELECT DISTINCT srr FROM tags) s LEFT JOIN w USING (srr)")
def pivot_concepts(spark, d):
    return _concepts(spark, d)


@query(f"""WITH {TAGS}, e AS (SELECT srr, row_id, tag, CASE lower(trim(value)) WHEN 'healthy' THEN 0.0 WHEN 'case' THEN 3.0 WHEN 'positive' THEN 2.0 WHEN 'control group' THEN CASE WHEN tag = 'view_cd' THEN 0.0 END END AS level FROM tags WHERE tag IN ('view_cd', 'click_status')),
f AS (SELECT srr, tag, CAST(arg_min(level, row_id) AS DOUBLE) AS v FROM e WHERE level IS NOT NULL GROUP BY 1, 2)
SELECT s.srr, a.v AS sr_view_cd_evidence, CASE a.v WHEN 3 THEN 1.0 WHEN 0 THEN 0.0 END AS sr_view_cd_status, b.v AS sr_click_status_evidence, CASE b.v WHEN 3 THEN 1.0 WHEN 0 THEN 0.0 END AS sr_click_status_status
FROM (SELECT DISTINCT srr FROM tags) s LEFT JOIN f a ON a.srr = s.srr AND a.tag = 'view_cd' LEFT JOIN f b ON b.srr = s.srr AND b.tag = 'click_status'""")
def self_report(spark, d):
    return E.self_report(V.tags(spark, d), ["view_cd", "click_status"], {"healthy": 0, "case": 3, "positive": 2}, {"view_cd": {"control group": 0}})


@query(_PIVOT + f""", {SAMPLES}, b AS (SELECT project, count(*) AS n_in_project FROM samples GROUP BY 1)
SELECT s.sample, 'S' || s.sample AS srr, s.project, visit, visit_source_tag, trade, trade_source_tag, n_in_project FROM samples s LEFT JOIN w ON w.srr = 'S' || s.sample LEFT JOIN b ON b.project = s.project""")
def harmonized_join(spark, d):
    spine = V.samples(spark, d).select("sample", F.concat(F.lit("S"), "sample").alias("srr"), "project")
    sizes = V.samples(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n_in_project"))
    return E.join_spine(spine, [_concepts(spark, d), sizes], ["srr", "project"])


@query(_PIVOT + """, h AS (SELECT s.srr, visit, trade, nullif(s.srr, 'S3') AS other FROM (SELECT DISTINCT srr FROM tags) s LEFT JOIN w USING (srr))
SELECT count(*) AS n_rows, 'visit' AS column_name, count(visit) AS n_filled, round(count(visit) * 100.0 / count(*), 6) AS pct_filled FROM h UNION ALL SELECT count(*), 'trade', count(trade), round(count(trade) * 100.0 / count(*), 6) FROM h UNION ALL SELECT count(*), 'other', count(other), round(count(other) * 100.0 / count(*), 6) FROM h""")
def coverage(spark, d):
    df = _concepts(spark, d).withColumn("other", F.nullif("srr", F.lit("S3")))
    return E.coverage(df, ["visit", "trade", "other"]).withColumn("pct_filled", r6(F.col("pct_filled")))


@query(f"""WITH {TAGS}, g AS (SELECT tag, project, CAST(value IN ('none', 'no') AS DOUBLE) AS x, CAST(value = 'none' OR row_id % 4 = 0 AS DOUBLE) AS y FROM tags)
SELECT 'a' AS column_a, 'b' AS column_b, round(corr(x, y), 6) AS r FROM g""")
def comissingness(spark, d):
    df = V.tags(spark, d).select(F.when(~F.col("value").isin("none", "no"), 1).alias("a"), F.when(~((F.col("value") == "none") | (F.col("row_id") % 4 == 0)), 1).alias("b"), F.lit(1).alias("c"))
    return E.comissingness(df, ["a", "b", "c"]).withColumn("r", r6(F.col("r")))


_RULES = [(["red", "blue"], "colour"), ([" ring", "bolt"], "metal"), (["widget"], "thing")]


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' WHEN contains(p_name, ' ring') OR contains(p_name, 'bolt') THEN 'metal' WHEN contains(p_name, 'widget') THEN 'thing' ELSE 'other' END AS category,
  CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' WHEN contains(p_name, ' ring') OR contains(p_name, 'bolt') THEN 'metal' WHEN contains(p_name, 'widget') THEN 'thing' ELSE p_brand END AS with_fallback FROM part""")
def ordered_rules(spark, d):
    return V.load(spark, d, "part").select("p_partkey", X.first_rule(F.col("p_name"), _RULES, "other").alias("category"), F.coalesce(X.first_rule(F.col("p_name"), _RULES, None), F.col("p_brand")).alias("with_fallback"))


_DIGITS, _UNITS = r"(\d+(?:\.\d+)?)", "(days|day|weeks|week|months|month|years|year|yo|y)"


def _unit_sql(x):
    return f"CASE lower(trim({x})) " + " ".join(f"WHEN '{u}' THEN {y!r}" for u, y in P.UNIT_YEARS.items()) + " END"


_SPAN, _EXACT, _BARE = rf"(?i)^{_DIGITS}\s*-\s*{_DIGITS}\s*{_UNITS}?\b", rf"(?i)^{_DIGITS}\s*{_UNITS}\b", r"^\d+(\.\d+)?$"
_part = lambda pattern, k: f"TRY_CAST(regexp_extract(t, '{pattern}', {k}) AS DOUBLE)"


@query(rf"""WITH {FIELDS}, x AS (SELECT id, trim(age) AS t, {_unit_sql('unit')} AS hint, CASE WHEN regexp_matches(coalesce(subjects, ''), '(?i)infant|neonat|newborn') THEN 1 / 12.0::DOUBLE ELSE 1.0::DOUBLE END AS implied FROM fields),
y AS (SELECT id, CASE WHEN regexp_matches(t, '{_SPAN}') THEN ({_part(_SPAN, 1)} + {_part(_SPAN, 2)}) / 2 * coalesce({_unit_sql(f"regexp_extract(t, '{_SPAN}', 3)")}, hint, 1.0) WHEN regexp_matches(t, '^[<>]') THEN {_part('^[<>]=?[ ]*' + _DIGITS, 1)} * coalesce(hint, 1.0)
  WHEN regexp_matches(t, '{_EXACT}') THEN {_part(_EXACT, 1)} * {_unit_sql(f"regexp_extract(t, '{_EXACT}', 2)")} WHEN regexp_matches(t, '{_BARE}') THEN TRY_CAST(t AS DOUBLE) * coalesce(hint, implied) END AS y,
  CASE WHEN regexp_matches(t, '{_SPAN}') THEN 'range' WHEN regexp_matches(t, '^[<>]') THEN 'bound' WHEN regexp_matches(t, '{_EXACT}') THEN 'exact' WHEN regexp_matches(t, '{_BARE}') THEN CASE WHEN hint IS NULL THEN 'inferred' ELSE 'exact' END END AS c FROM x)
SELECT id, CASE WHEN y BETWEEN 0 AND 120 THEN round(y, 6) END AS years, CASE WHEN y BETWEEN 0 AND 120 THEN c END AS confidence FROM y""")
def parse_age(spark, d):
    got = P.parse_age(F.col("age"), F.col("unit"), P.implied_unit_years(F.col("subjects")))
    return V.fields(spark, d).select("id", F.round(got["years"], 6).alias("years"), got["confidence"].alias("confidence"))


@query(rf"""WITH {FIELDS}, x AS (SELECT id, trim(taken) AS t FROM fields), y AS (SELECT id, year(try_strptime(t, ['%Y-%m-%d', '%Y-%m', '%Y'])) AS y, TRY_CAST(regexp_extract(t, '(\d{{4}})', 1) AS INT) AS g FROM x)
SELECT id, CAST(coalesce(y, CASE WHEN g BETWEEN 1990 AND 2022 THEN g END) AS DOUBLE) AS collection_year FROM y""")
def parse_year(spark, d):
    return V.fields(spark, d).select("id", P.parse_year(F.col("taken")).cast("double").alias("collection_year"))


@query(f"""WITH {FIELDS} SELECT id, CASE WHEN contains(lower(host), 'mouse') OR contains(lower(host), 'macaque') THEN FALSE WHEN lower(trim(host)) IN ('homo', 'infant') OR starts_with(lower(trim(host)), 'homo sapiens') OR starts_with(lower(trim(host)), 'human') THEN TRUE END AS is_human FROM fields""")
def host_species(spark, d):
    return V.fields(spark, d).select("id", P.host_is_human(F.col("host"), ["homo sapiens", "human"], ["homo", "infant"], ["mouse", "macaque"]).alias("is_human"))


@query(f"WITH {FIELDS}, x AS (SELECT id, replace(lower(trim(sex)), 'famale', 'female') AS s FROM fields) SELECT id, CASE WHEN s IN ('male', 'female') THEN s END AS sex FROM x")
def repair_sex(spark, d):
    return V.fields(spark, d).select("id", P.repair_sex(F.col("sex"), {"famale": "female"}).alias("sex"))


@query(f"WITH {FIELDS} SELECT id, CASE WHEN regexp_matches(trim(unit), '{_BARE}') THEN NULL ELSE unit END AS unit, TRY_CAST(trim(unit) AS DOUBLE) AS number FROM fields")
def repair_age_unit(spark, d):
    return V.fields(spark, d).select("id", P.repair_unit(F.col("unit")).alias("unit"), P.to_number(F.col("unit")).alias("number"))


@query(f"WITH {FIELDS} SELECT id, CASE WHEN regexp_matches(coalesce(subjects, ''), '(?i)infant|neonat|newborn') THEN round(1 / 12.0::DOUBLE, 6) ELSE 1.0::DOUBLE END AS subjects FROM fields")
def implied_units(spark, d):
    return V.fields(spark, d).select("id", r6(P.implied_unit_years(F.col("subjects"))).alias("subjects"))


@query(f"WITH {TAGS} SELECT DISTINCT tag, trim(regexp_replace(lower(tag || ' (x)'), '[^a-z0-9]+', '_', 'g'), '_') AS sane, len(list_intersect(regexp_split_to_array(lower(tag), '[^a-z0-9]+'), ['cd'])) > 0 AS has_cd FROM tags")
def sanitized_names(spark, d):
    t = F.col("tag")
    return V.tags(spark, d).select(t).distinct().select(t, X.sanitize(F.concat(t, F.lit(" (x)"))).alias("sane"), F.arrays_overlap(X.name_tokens(t), F.array(F.lit("cd"))).alias("has_cd"))


@query("SELECT lang, CASE WHEN trim(source) IN ('', 'src1', 'None') THEN 'unknown' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1, 2")
def unknown_levels(spark, d):
    df = V.load(spark, d, "documents").withColumn("source", F.when(F.col("source") == "src1", " nan ").otherwise(F.col("source")))
    return df.groupBy("lang", X.known_or_unknown(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TAGS}, v AS (SELECT DISTINCT project || '_' || srr || '_' || CAST(row_id % 97 AS VARCHAR) AS project, tag, value, lower(trim(value)) AS bare FROM tags),
g AS (SELECT project, tag, bool_and(coalesce(CASE WHEN tag = 'view_cd' THEN bare = 'none' ELSE contains(bare, 'healthy') OR contains(bare, 'control') END, FALSE)) AS ok FROM v GROUP BY 1, 2) SELECT project, tag, value, 'healthy' AS label FROM v JOIN g USING (project, tag) WHERE ok""")
def healthy_only(spark, d):
    # A field of one subject's visit has few values; all of them are in.
    v = V.tags(spark, d).withColumn("project", F.concat_ws("_", "project", "srr", (F.col("row_id") % 97).cast("string")))
    return L.healthy_only(v.groupBy("project", "tag", "value").agg(F.count(F.lit(1)).alias("n")), ["healthy", "control"], ["view_cd"], ["none"])


@query()
def subset_sum_labels(spark, d):
    counts = V.tags(spark, d).groupBy("project", "tag", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    # Totals that a curator would have noted: controls say control or healthy, cases say case or positive.
    review = counts.groupBy("project", F.col("tag").alias("field")).agg(F.sum(F.when(F.lower("value").rlike("control|healthy"), F.col("n")).otherwise(0)).alias("controls"), F.sum(F.when(F.lower("value").rlike("case|positive"), F.col("n")).otherwise(0)).alias("cases")).withColumn("bucket", F.lit("CONFIRMED"))
    return L.resolved_contrasts(counts, review)


@query()
def derived_labels(spark, d):
    t = V.tags(spark, d)
    counts = t.groupBy("project", "tag", "value").agg(F.count(F.lit(1)).alias("n"))
    review = counts.groupBy("project", F.col("tag").alias("field")).agg(F.sum(F.when(F.lower("value").rlike("control|healthy"), F.col("n")).otherwise(0)).cast("double").alias("controls"), F.sum(F.when(F.lower("value").rlike("case|positive"), F.col("n")).otherwise(0)).cast("double").alias("cases")).withColumn("bucket", F.lit("CONFIRMED"))
    conditions = spark.createDataFrame([(f"P{i}", f"C{i}") for i in range(6)], "project string, condition_category string")
    return L.derive_labels(t, F.col("value"), review, ["healthy"], [], [], [(["positive"], "POS")], conditions)[0]


@query(f"WITH {SAMPLES}, {COUNTS}, t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1) SELECT project, disease_category, CAST(floor(c_acctbal / 500.0) AS BIGINT) AS bin, count(*) AS n FROM samples JOIN t USING (sample) GROUP BY ALL")
def stacked_histogram(spark, d):
    depths = V.counts(spark, d).select("sample").distinct()
    return H.histogram(V.samples(spark, d).join(depths, "sample", "left_semi"), "c_acctbal", 500.0, by=["project", "disease_category"])
