"""Registered queries: counts, compositions, cohorts, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..functions.lineage import genus_label, last_rank, parse_lineage, prefixes
from ..operators import cohorts as H
from ..operators import compose as C
from ..operators import counts as N
from ..operators import sampling as S
from . import views as V
from .views import COUNTS, SAMPLES, LINEAGES


MAX_WIDE = 10_000


def r6(c):
    return (F.round(c, 6) + F.lit(0.0))


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query(f"WITH {COUNTS} SELECT sample, CAST(sum(n) AS BIGINT) AS depth, count(*) AS n_nonzero FROM counts GROUP BY sample")
def sample_depth(spark, d):
    return N.sample_depth(V.counts(spark, d))


@query(f"WITH {COUNTS} SELECT taxon, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_samples FROM counts GROUP BY taxon")
def taxon_totals(spark, d):
    return N.taxon_totals(V.counts(spark, d))


@query(f"WITH {COUNTS} SELECT sample, taxon, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_nonzero FROM counts GROUP BY GROUPING SETS ((sample), (taxon), ())")
def grouping_sets_totals(spark, d):
    return N.all_totals(V.counts(spark, d))


@query(f"WITH {COUNTS} SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_cells, count(DISTINCT sample) AS n_samples, count(DISTINCT taxon) AS n_taxa FROM counts")
def matrix_checksum(spark, d):
    return N.checksum(V.counts(spark, d))


PREVALENCE = """prevalence AS (
  SELECT taxon, count(*) AS n_present, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT sample) FROM counts) AS prevalence FROM counts GROUP BY taxon)"""


@query(f"WITH {COUNTS}, {PREVALENCE} SELECT taxon, n_present, round(prevalence, 6) AS prevalence, CAST(row_number() OVER (ORDER BY prevalence DESC, taxon) AS INT) AS prevalence_rank FROM prevalence")
def taxon_prevalence(spark, d):
    return rounded(N.prevalence(V.counts(spark, d)), "prevalence")


@query(f"WITH {COUNTS}, {PREVALENCE} SELECT sample, taxon, n FROM counts WHERE taxon IN (SELECT taxon FROM prevalence WHERE prevalence >= 0.2)")
def prevalence_filter(spark, d):
    return N.prevalent(V.counts(spark, d), 0.2)


@query(f"WITH {COUNTS}, t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1) SELECT taxon, round(sum(n / CAST(depth AS DOUBLE)) / (SELECT count(*) FROM t), 9) AS mean_relative FROM counts JOIN t USING (sample) GROUP BY taxon")
def mean_relative_abundance(spark, d):
    return N.mean_relative_abundance(V.counts(spark, d)).withColumn("mean_relative", F.round("mean_relative", 9))


@query(f"""WITH {COUNTS}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth, count(*) AS n_nonzero FROM counts GROUP BY 1)
SELECT count(*) AS n_samples, CAST(min(depth) AS DOUBLE) AS depth_min, round(quantile_cont(depth, 0.1), 6) AS depth_p10, round(quantile_cont(depth, 0.5), 6) AS depth_median, round(quantile_cont(depth, 0.9), 6) AS depth_p90, CAST(max(depth) AS DOUBLE) AS depth_max,
  CAST(min(n_nonzero) AS DOUBLE) AS n_nonzero_min, round(quantile_cont(n_nonzero, 0.1), 6) AS n_nonzero_p10, round(quantile_cont(n_nonzero, 0.5), 6) AS n_nonzero_median, round(quantile_cont(n_nonzero, 0.9), 6) AS n_nonzero_p90, CAST(max(n_nonzero) AS DOUBLE) AS n_nonzero_max FROM t""")
def depth_profile(spark, d):
    p = [f"{c}_{q}" for c in ("depth", "n_nonzero") for q in ("p10", "median", "p90")]
    return rounded(N.depth_profile(N.sample_depth(V.counts(spark, d))), *p)


@query(f"WITH {COUNTS} SELECT sample, taxon, round(n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE), 6) AS relative FROM counts")
def relative_abundance(spark, d):
    return rounded(C.relative_abundance(V.counts(spark, d)), "relative")


CLR_STATS = """stats AS (SELECT sample, sum(ln(n)) AS s, CAST(sum(n) AS DOUBLE) AS total, count(*) AS k, (SELECT count(DISTINCT taxon) FROM counts) AS t FROM counts GROUP BY sample)"""
CLR = f"""{CLR_STATS},
mids AS (SELECT *, (s + (t - k) * ln(CAST(0.5 AS DOUBLE))) / t AS m FROM stats),
clr AS (SELECT sample, taxon, ln(n) - m AS clr FROM counts JOIN mids USING (sample)),
zeros AS (SELECT sample, ln(CAST(0.5 AS DOUBLE)) - m AS zero_clr FROM mids)"""


@query(f"WITH {COUNTS}, {CLR} SELECT sample, taxon, round(clr, 6) + 0.0 AS clr, round(zero_clr, 6) AS zero_clr FROM clr JOIN zeros USING (sample)")
def clr_additive(spark, d):
    values, zeros, _ = C.clr(V.counts(spark, d))
    return rounded(values.join(zeros, "sample"), "clr", "zero_clr")


@query(f"""WITH {COUNTS}, {CLR_STATS},
p AS (SELECT *, (t - k) * CAST(0.5 AS DOUBLE) / total AS taken FROM stats),
q AS (SELECT *, ln((1 - taken) / total) AS shrink, ln(CAST(0.5 AS DOUBLE)) - ln(total) AS zero FROM p WHERE taken < 1),
m AS (SELECT sample, shrink, zero, (s + k * shrink + (t - k) * zero) / t AS mean FROM q)
SELECT sample, taxon, round(ln(n) + shrink - mean, 6) + 0.0 AS clr, round(zero - mean, 6) AS zero_clr FROM counts JOIN m USING (sample)""")
def clr_multiplicative(spark, d):
    values, zeros, _ = C.clr(V.counts(spark, d), method="multiplicative")
    return rounded(values.join(zeros, "sample"), "clr", "zero_clr")


@query(f"""WITH {COUNTS}, {CLR_STATS}, p AS (SELECT sample, log10(total + (t - k) * CAST(0.5 AS DOUBLE)) AS l FROM stats)
SELECT sample, taxon, round(log10(n) - l, 6) + 0.0 AS log_relative FROM counts JOIN p USING (sample)""")
def log_relative(spark, d):
    return rounded(C.log_relative(V.counts(spark, d))[0], "log_relative")


@query(f"""WITH {COUNTS}, {CLR}, grid AS (SELECT sample, taxon, zero_clr FROM zeros CROSS JOIN (SELECT DISTINCT taxon FROM counts) x)
SELECT sample, taxon, round(coalesce(clr, zero_clr), 6) + 0.0 AS clr FROM grid LEFT JOIN clr USING (sample, taxon)""")
def clr_dense(spark, d):
    counts = V.counts(spark, d)
    values, zeros, _ = C.clr(counts)
    return rounded(C.dense(values, zeros, counts.select("taxon").distinct()), "clr")


# Cell by cell, the number drawn is where the hypergeometric distribution passes the hash's number.
_LN_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_WEIGHT = f"exp({_LN_CHOOSE.format(n='c.n', k='x')} + {_LN_CHOOSE.format(n='(r.rest - c.n)', k='(r.need - x)')} - {_LN_CHOOSE.format(n='r.rest', k='r.need')})"


@query(f"""WITH RECURSIVE {COUNTS}, cells AS (SELECT * FROM (SELECT sample, taxon, n, sum(n) OVER (PARTITION BY sample) AS total, row_number() OVER (PARTITION BY sample ORDER BY taxon) AS k,
  CAST('0x' || substr(md5('42|' || sample || '|' || taxon), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM counts) WHERE total >= 500),
walk AS (SELECT DISTINCT sample, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS taxon, CAST(total AS BIGINT) AS rest, CAST(500 AS BIGINT) AS need, CAST(0 AS BIGINT) AS n FROM cells
  UNION ALL SELECT sample, k, taxon, rest - cn, need - took, took FROM (SELECT *, low + CAST(len(list_filter(range(1, len(w) + 1), lambda i: list_sum(w[1:i]) <= u * list_sum(w))) AS BIGINT) AS took
    FROM (SELECT r.sample, c.k, c.taxon, r.rest, r.need, c.n AS cn, c.u, greatest(0, r.need - (r.rest - c.n)) AS low, list_transform(range(greatest(0, r.need - (r.rest - c.n)), least(c.n, r.need) + 1), lambda x: {_WEIGHT}) AS w
      FROM walk r JOIN cells c ON c.sample = r.sample AND c.k = r.k + 1)))
SELECT sample, taxon, n FROM walk WHERE k > 0 AND n > 0""")
def rarefied_counts(spark, d):
    return C.rarefy(V.counts(spark, d), 500)


@query(f"WITH {COUNTS}, t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1) SELECT sample, taxon, round(ln(1 + n / CAST(depth AS DOUBLE) * 10000), 6) AS weight FROM counts JOIN t USING (sample)")
def edge_weights(spark, d):
    rel = C.relative_abundance(V.counts(spark, d))
    return rel.select("sample", "taxon", r6(C.edge_weight(F.col("relative"))).alias("weight"))


@query(f"WITH {COUNTS} SELECT sample, taxon, n FROM counts")
def wide_round_trip(spark, d):
    counts = V.counts(spark, d)
    taxa = [r[0] for r in counts.select("taxon").distinct().orderBy("taxon").limit(MAX_WIDE + 1).collect()]
    if len(taxa) > MAX_WIDE:
        raise ValueError(f"over {MAX_WIDE} taxa for a wide table")
    return N.from_wide(N.to_wide(counts, taxa))


@query("SELECT p_type AS type_name, p_brand AS brand_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def lineage_parse(spark, d):
    parts = parse_lineage(F.concat_ws(".", "p_type", "p_brand"), 2)
    return V.load(spark, d, "part").select(parts.alias("p")).groupBy(F.col("p")[0].alias("type_name"), F.col("p")[1].alias("brand_name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINEAGES}, p AS (SELECT id, full_string, string_split(full_string, '.') AS x FROM lineages), q AS (SELECT id, full_string, list_concat(x[1:5], [array_to_string(x[6:], '.')]) AS parts FROM p)
SELECT id, full_string, coalesce(list_extract(list_filter(parts[3:], lambda r: r NOT IN ('NA', '')), -1), full_string) AS genus, list_extract(list_filter(string_split(full_string, '.'), lambda r: r <> 'NA'), -1) AS last_rank FROM q""")
def genus_and_last_rank(spark, d):
    return V.lineages(spark, d).select("id", "full_string", genus_label(parse_lineage(F.col("full_string")), F.col("full_string")).alias("genus"), last_rank(F.col("full_string")).alias("last_rank"))


@query(f"""WITH {LINEAGES}, p AS (SELECT id, string_split(full_string, '.') AS x FROM lineages) SELECT id, array_to_string(x[1:k], '.') AS prefix, CAST(k AS INT) AS prefix_rank FROM p, (SELECT unnest(range(1, 6)) AS k)""")
def lineage_prefixes(spark, d):
    return V.lineages(spark, d).select("id", F.explode(prefixes(parse_lineage(F.col("full_string")))).alias("p")).select("id", F.array_join("p", ".").alias("prefix"), F.size("p").alias("prefix_rank"))


_FLOW = f"""WITH {COUNTS}, {SAMPLES}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth FROM counts GROUP BY 1),
x AS (SELECT s.*, depth, CASE WHEN project = 'ASIA' THEN NULL ELSE project <> 'EUROPE' END AS a, disease_category <> 'MACHINERY' AS b, depth >= 600 AS c FROM samples s JOIN t USING (sample))"""


@query(_FLOW + """, f AS (SELECT count(*) AS c0, count(*) FILTER (WHERE coalesce(a, TRUE)) AS c1, count(*) FILTER (WHERE coalesce(a, TRUE) AND b) AS c2, count(*) FILTER (WHERE coalesce(a, TRUE) AND b AND c) AS c3 FROM x)
SELECT 1 AS step_no, 'host' AS step, c0 AS n_in, c0 - c1 AS n_removed, c1 AS n_out FROM f UNION ALL SELECT 2, 'site', c1, c1 - c2, c2 FROM f UNION ALL SELECT 3, 'depth', c2, c2 - c3, c3 FROM f""")
def qc_flow(spark, d):
    return H.qc_flow(*_flow(spark, d))[1]


def _flow(spark, d):
    df = V.samples(spark, d).join(N.sample_depth(V.counts(spark, d)).select("sample", "depth"), "sample")
    host = F.when(F.col("project") != "ASIA", F.col("project") != "EUROPE")
    return df, [("host", host), ("site", F.col("disease_category") != "MACHINERY"), ("depth", F.col("depth") >= 600)]


@query(_FLOW + " SELECT sample, project, depth FROM x WHERE coalesce(a, TRUE) AND b AND c")
def qc_kept(spark, d):
    return H.qc_flow(*_flow(spark, d))[0].select("sample", "project", "depth")


# Labels thinned so that some nations lack cases, or labels.
_LABELLED = f"""WITH {SAMPLES}, lab AS (SELECT row_id, sample, nation AS project, disease_category, CASE WHEN row_id % 3 = 0 THEN NULL WHEN nation LIKE '%1' THEN 'healthy' ELSE disease_label END AS disease_label FROM samples),
tab AS (SELECT project, count(*) FILTER (WHERE disease_label = 'healthy') AS n_healthy, count(*) FILTER (WHERE disease_label = 'case') AS n_case FROM lab GROUP BY project)"""


def _labelled(spark, d):
    s = V.samples(spark, d)
    label = F.when(F.col("row_id") % 3 != 0, F.when(F.col("nation").like("%1"), "healthy").otherwise(F.col("disease_label")))
    return s.select("row_id", "sample", F.col("nation").alias("project"), "disease_category", label.alias("disease_label"))


@query(_LABELLED + " SELECT project, n_healthy, n_case FROM tab")
def label_crosstab(spark, d):
    return H.label_crosstab(_labelled(spark, d))


@query(_LABELLED + " SELECT sample, project, disease_label FROM lab WHERE disease_label IS NOT NULL AND project IN (SELECT project FROM tab WHERE n_case >= 18 AND n_healthy >= 18 AND project > 'NATION_2')")
def cohort_within(spark, d):
    df = _labelled(spark, d)
    return H.within_project_cohort(df, df.filter("project > 'NATION_2'").select("project"), 18, 18)[0].select("sample", "project", "disease_label")


@query(_LABELLED + " SELECT project, n_healthy, n_case FROM tab WHERE project > 'NATION_2' AND NOT (n_case >= 18 AND n_healthy >= 18)")
def cohort_excluded(spark, d):
    df = _labelled(spark, d)
    return H.within_project_cohort(df, df.filter("project > 'NATION_2'").select("project"), 18, 18)[1].select("project", "n_healthy", "n_case")


@query(_LABELLED + " SELECT sample, project FROM lab WHERE disease_label IS NOT NULL")
def cohort_labeled(spark, d):
    return H.labelled_cohort(_labelled(spark, d)).select("sample", "project")


@query(_LABELLED + " SELECT sample, project FROM lab WHERE disease_label = 'healthy' AND project IN (SELECT project FROM tab WHERE n_case = 0)")
def cohort_baseline(spark, d):
    return H.healthy_baseline(_labelled(spark, d)).select("sample", "project")


@query(_LABELLED + """, m AS (SELECT project, disease_category, count(*) AS c FROM lab GROUP BY 1, 2),
mode AS (SELECT project, disease_category AS c FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY c DESC, disease_category) AS k FROM m) WHERE k = 1),
f AS (SELECT project, disease_label AS l FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY row_id) AS k FROM lab WHERE disease_label IS NOT NULL) WHERE k = 1)
SELECT t.project, (SELECT count(*) FROM lab l WHERE l.project = t.project) AS n_samples, f.l AS first_label, mode.c AS disease_category, n_healthy AS n_controls, n_case AS n_cases FROM tab t JOIN mode USING (project) LEFT JOIN f USING (project)""")
def project_summary(spark, d):
    df = _labelled(spark, d).withColumn("first_label", F.col("disease_label"))
    return H.project_summary(df, ["first_label"], ["disease_category"])


@query(f"""WITH {COUNTS}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth, count(*) AS n_nonzero FROM counts GROUP BY 1),
l AS (SELECT *, log10(greatest(depth, 1)) AS x FROM t), e AS (SELECT min(x) AS lo, max(x) AS hi FROM l),
b AS (SELECT *, CAST(least(19, greatest(0, ceil((x - lo) / ((hi - lo) / 20)) - 1)) AS INT) AS bin FROM l, e)
SELECT bin, round(quantile_cont(depth, 0.5), 6) AS median_depth, round(avg(n_nonzero), 6) AS mean_richness, count(*) AS n FROM b GROUP BY bin""")
def depth_richness_curve(spark, d):
    return rounded(H.depth_richness_curve(N.sample_depth(V.counts(spark, d)), 20), "median_depth", "mean_richness")


@query(f"""WITH {COUNTS}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth FROM counts GROUP BY 1), e AS (SELECT quantile_cont(depth, [0.2, 0.4, 0.6, 0.8]) AS q FROM t)
SELECT sample, depth, CAST(len(list_filter(q, lambda v: v < depth)) AS INT) AS bin FROM t, e""")
def quantile_bins(spark, d):
    return H.quantile_bins(N.sample_depth(V.counts(spark, d)).select("sample", "depth"), "depth", 5)


@query(f"WITH {COUNTS}, t AS (SELECT sample, count(*) AS n_nonzero FROM counts GROUP BY 1) SELECT CAST(floor(n_nonzero / 8.0) AS BIGINT) AS bin, count(*) AS n FROM t GROUP BY 1")
def richness_histogram(spark, d):
    return H.histogram(N.sample_depth(V.counts(spark, d)), "n_nonzero", 8.0)


@query(f"""WITH {COUNTS}, t AS (SELECT log10(sum(n)) AS x FROM counts GROUP BY sample), e AS (SELECT min(x) AS lo, max(x) AS hi FROM t)
SELECT CAST(least(59, floor((x - lo) / ((hi - lo) / 60))) AS BIGINT) AS bin, count(*) AS n FROM t, e GROUP BY 1""")
def depth_log_histogram(spark, d):
    return H.log_histogram(N.sample_depth(V.counts(spark, d)), "depth", 60)


@query(f"WITH {COUNTS}, t AS (SELECT log10(sum(n)) AS x, count(*) AS y FROM counts GROUP BY sample) SELECT CAST(floor(x / CAST(0.1 AS DOUBLE)) AS BIGINT) AS bx, CAST(floor(y / 5.0) AS BIGINT) AS by, count(*) AS n FROM t GROUP BY 1, 2")
def depth_richness_grid(spark, d):
    return H.grid_counts(N.sample_depth(V.counts(spark, d)), F.log10("depth"), F.col("n_nonzero"), 0.1, 5.0)


@query(f"""WITH {SAMPLES}, z AS (SELECT nation, count(*) AS c, greatest(1, least(count(*), CAST(round_even(count(*) * 300.0 / (SELECT count(*) FROM samples), 0) AS BIGINT))) AS take FROM samples GROUP BY 1),
o AS (SELECT sample, nation, row_number() OVER (PARTITION BY nation ORDER BY md5('42|' || sample), sample) AS k FROM samples)
SELECT sample, nation FROM o JOIN z USING (nation) WHERE k <= take""")
def stratified_subsample(spark, d):
    return S.stratified_subsample(V.samples(spark, d), "nation", "sample", 300).select("sample", "nation")


@query(f"WITH {SAMPLES} SELECT sample, disease_label, CAST((row_number() OVER (PARTITION BY disease_label ORDER BY md5('42|' || sample), sample) - 1) % 5 AS INT) AS fold FROM samples")
def stratified_folds(spark, d):
    return S.stratified_folds(V.samples(spark, d), "disease_label", "sample", 5).select("sample", "disease_label", "fold")


@query(f"WITH {SAMPLES} SELECT sample, project, CAST(dense_rank() OVER (ORDER BY project) - 1 AS INT) AS fold FROM samples")
def lopo_folds(spark, d):
    return S.group_folds(V.samples(spark, d), "project").select("sample", "project", "fold")


@query(f"""WITH {SAMPLES}, f AS (SELECT nation AS fold, CAST(disease_label = 'case' AND nation NOT LIKE '%1' AS INT) AS y FROM samples), a AS (SELECT sum(y) AS p, count(*) AS c FROM f)
SELECT fold, count(*) AS n_test, min(c) - count(*) AS n_train, CAST(sum(y) AS BIGINT) AS n_test_pos FROM f, a GROUP BY fold HAVING sum(y) > 0 AND sum(y) < count(*) AND min(p) - sum(y) > 0 AND min(p) - sum(y) < min(c) - count(*)""")
def usable_folds(spark, d):
    df = V.samples(spark, d).select(F.col("nation").alias("fold"), ((F.col("disease_label") == "case") & ~F.col("nation").like("%1")).cast("int").alias("y"))
    return S.usable_folds(df)


@query(f"WITH {SAMPLES} SELECT sample, nation FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY md5('42|' || sample), sample) AS k FROM samples) WHERE k <= 10")
def balanced_sample(spark, d):
    return S.balanced_sample(V.samples(spark, d), "nation", "sample", 10).select("sample", "nation")


@query(f"""WITH {SAMPLES}, a AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sample) AS k FROM samples), b AS (SELECT project, disease_label AS v, row_number() OVER (PARTITION BY project ORDER BY md5('42|' || sample), sample) AS k FROM samples)
SELECT a.sample, a.project, b.v AS disease_label FROM a JOIN b ON a.project = b.project AND a.k = b.k""")
def label_permutation(spark, d):
    return S.permute_within(V.samples(spark, d).select("sample", "project", "disease_label"), ["project"], "sample", "disease_label")


@query(f"""WITH {COUNTS}, o AS (SELECT sample, taxon, row_number() OVER (ORDER BY md5('42|' || sample || '|' || taxon), sample, taxon) AS k, count(*) OVER () AS c FROM counts)
SELECT sample, taxon, k <= round_even(c * CAST(0.15 AS DOUBLE), 0) AS masked FROM o""")
def edge_mask(spark, d):
    return S.mask_share(V.counts(spark, d).select("sample", "taxon"), ["sample", "taxon"], 0.15)


@query(f"""WITH {COUNTS}, l AS (SELECT sample, row_number() OVER (ORDER BY md5('42|' || sample), sample) - 1 AS p FROM (SELECT DISTINCT sample FROM counts)), r AS (SELECT taxon, row_number() OVER (ORDER BY md5('42|' || taxon), taxon) - 1 AS q FROM (SELECT DISTINCT taxon FROM counts)),
f AS (SELECT sample, taxon, row_number() OVER (ORDER BY p, q) - 1 AS k FROM l, r WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.sample = l.sample AND c.taxon = r.taxon)), t AS (SELECT count(*) AS total FROM f),
dr AS (SELECT k, min(i) AS i FROM (SELECT i, CAST('0x' || substr(md5('42|' || i), 1, 13) AS BIGINT) % total AS k FROM range(0, 20000) AS x(i), t) GROUP BY 1)
SELECT sample, taxon FROM (SELECT k FROM dr ORDER BY i LIMIT 1000) JOIN f USING (k)""")
def negative_pairs(spark, d):
    counts = V.counts(spark, d)
    place = lambda c: S.encode_positions(counts.select(F.col(c).alias("id")))
    return S.negative_pairs(counts.select("sample", "taxon"), place("sample"), place("taxon"), 1000, "sample", "taxon")
