"""Registered queries: comparisons, figure data, classifiers on tables and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import compose as C
from ..operators import counts as N
from ..operators import graphs as G
from ..operators import models as M
from ..operators import sampling as S
from ..operators import validation as A
from . import reports as R
from . import views as V
from .queries_data import _LABELLED, CLR, CLR_STATS, PREVALENCE, _labelled, rounded
from .queries_graph import _edges, _vertices
from .queries_stats import _SCORES, _arms, _scores
from .views import COUNTS, SAMPLES


@query(f"""WITH {COUNTS}, {CLR}, p2 AS (SELECT *, (t - k) * CAST(0.5 AS DOUBLE) / total AS taken FROM stats), q2 AS (SELECT *, ln((1 - taken) / total) AS shrink, ln(CAST(0.5 AS DOUBLE)) - ln(total) AS zero FROM p2 WHERE taken < 1),
m2 AS (SELECT sample, shrink - (s + k * shrink + (t - k) * zero) / t AS shift FROM q2)
SELECT taxon, count(*) AS n, round(corr(clr, ln(n) + shift), 5) AS r FROM clr JOIN counts USING (sample, taxon) JOIN m2 USING (sample) GROUP BY taxon""")
def clr_agreement(spark, d):
    counts = V.counts(spark, d)
    return C.agreement(C.clr(counts)[0], C.clr(counts, method="multiplicative")[0]).withColumn("r", F.round("r", 5))


@query(f"WITH {COUNTS}, a AS (SELECT sample, sum(n) AS x FROM counts GROUP BY 1), b AS (SELECT sample, sum(n) AS y FROM counts WHERE n > 2 GROUP BY 1) SELECT count(*) AS n_shared, count(*) FILTER (WHERE x <> y) AS n_different FROM a JOIN b USING (sample)")
def compare_depths(spark, d):
    counts = V.counts(spark, d)
    return N.compare_depths(N.sample_depth(counts), N.sample_depth(counts.filter("n > 2")))


@query(f"WITH {_SCORES} SELECT y AS label, count(*) AS n, round(avg(CAST(y = CAST(score > 9 AS INT) AS DOUBLE)), 6) AS recall FROM sc GROUP BY y")
def recall_by_class(spark, d):
    return rounded(M.recalls(_scores(spark, d).select(F.col("y").alias("label"), (F.col("score") > 9).cast("int").alias("prediction"))), "recall")


_GAPS = f"""{_SCORES}, g AS (SELECT right(fold, 1) AS model, length(fold) % 3 AS seed, CASE WHEN y = 1 THEN 'G1' ELSE 'G2' END AS arm, avg(score) AS auc FROM sc GROUP BY 1, 2, 3),
w AS (SELECT model, seed, avg(auc) FILTER (WHERE arm = 'G2') - avg(auc) FILTER (WHERE arm = 'G1') AS gap FROM g GROUP BY 1, 2), gaps AS (SELECT model, avg(gap) AS gap_mean, coalesce(stddev_samp(gap), 0) AS gap_sd, count(gap) AS n_seeds FROM w GROUP BY 1)"""


def _gaps(spark, d):
    s = _scores(spark, d).groupBy(F.right("fold", F.lit(1)).alias("model"), (F.length("fold") % 3).alias("seed"), F.when(F.col("y") == 1, "G1").otherwise("G2").alias("arm")).agg(F.avg("score").alias("auc"))
    return M.paired_gaps(s, ["model"], "arm", "G1", "G2")


@query(f"WITH {_GAPS} SELECT model, round(gap_mean, 6) + 0.0 AS gap_mean, round(gap_sd, 6) AS gap_sd, n_seeds FROM gaps")
def paired_gaps(spark, d):
    return rounded(_gaps(spark, d), "gap_mean", "gap_sd")


@query(f"WITH {_GAPS} SELECT model, CASE WHEN abs(gap_mean) <= 2 * gap_sd THEN 'within noise' WHEN gap_mean > 0 THEN 'gain' ELSE 'loss' END AS reading FROM gaps")
def noise_reading(spark, d):
    return A.noise_reading(_gaps(spark, d)).select("model", "reading")


@query(f"WITH {COUNTS}, {PREVALENCE} SELECT mark, count(*) AS n_taxa FROM prevalence, (VALUES (CAST(0.3 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) AS t(mark) WHERE prevalence >= mark GROUP BY 1")
def prevalence_marks(spark, d):
    return R.prevalence_marks(N.prevalence(V.counts(spark, d)), (0.3, 0.2, 0.1))


@query("SELECT CASE WHEN lang = 'en' THEN 'unresolved' ELSE lang END AS level, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, level LIMIT 3")
def level_counts(spark, d):
    return R.level_counts(V.load(spark, d, "documents"), F.nullif("lang", F.lit("en")), 3)


@query(_LABELLED + " SELECT project, n_healthy, n_case, n_healthy + n_case AS total FROM tab WHERE n_case > 0 AND n_healthy > 0")
def case_control_balance(spark, d):
    from ..operators.cohorts import label_crosstab

    return R.balance(label_crosstab(_labelled(spark, d)))


@query(f"WITH {COUNTS}, t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1) SELECT taxon, round(sum(n / CAST(depth AS DOUBLE)) / (SELECT count(*) FROM t), 9) AS mean_relative FROM counts JOIN t USING (sample) GROUP BY taxon ORDER BY 2 DESC, 1 LIMIT 20")
def top_taxa(spark, d):
    return R.top_taxa(N.mean_relative_abundance(V.counts(spark, d))).withColumn("mean_relative", F.round("mean_relative", 9))


@query()
def volcano(spark, d):
    return R.volcano(_arms(spark, d)[0])


@query()
def profile_lines(spark, d):
    from ..operators.eav import categorical_profile

    return R.profile_text(categorical_profile(V.tags(spark, d)))


@query(f"WITH {SAMPLES}, z AS (SELECT nation, count(*) AS n FROM samples GROUP BY 1) SELECT count(*) AS n_classes, count(*) FILTER (WHERE n < 55) AS n_classes_dropped, CAST(coalesce(sum(n) FILTER (WHERE n < 55), 0) AS BIGINT) AS n_rows_dropped FROM z")
def small_classes(spark, d):
    return M.drop_small_classes(V.samples(spark, d), "nation", 55)[1]


@query(f"WITH {SAMPLES} SELECT sample, nation, CAST(dense_rank() OVER (ORDER BY nation) - 1 AS INT) AS code FROM samples")
def label_codes(spark, d):
    return M.encode_labels(V.samples(spark, d), "nation").select("sample", "nation", "code")


@query()
def project_classifier(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = V.vectors(spark, d).select("sample", "project", array_to_vector("vec").alias("features"))
    return M.class_summary(M.class_scores(v, ["linear", "mlp"], folds=2, least=5, max_iter=15))


@query()
def graph_leakage_cv(spark, d):
    s = V.samples(spark, d)
    labels = S.stratified_folds(s.select("sample", (F.col("disease_label") == "case").cast("int").alias("y")), "y", "sample", 2)
    noisy = _vertices(spark, d)
    got = M.graph_cross_validated(_edges(spark, d), noisy, labels, hops=1)
    return M.roc_auc(got, ["protocol", "fold"])


@query(f"WITH {COUNTS}, {CLR_STATS} SELECT sample, 1 AS n_graphs, k AS n_present FROM stats")
def degrees_by_sample(spark, d):
    return G.degrees(N.presence(V.counts(spark, d))).select("sample", F.lit(1).alias("n_graphs"), F.col("degree").alias("n_present"))


@query()
def message_net_cv(spark, d):
    """A trained network on abundance edges, held-out samples only receiving."""
    from ..operators import messagenet as T

    counts, s = V.counts(spark, d), V.samples(spark, d)
    labels = S.stratified_folds(s.select("sample", (F.col("disease_label") == "case").cast("int").alias("y")), "y", "sample", 2)
    depth = N.sample_depth(counts)
    own = s.join(depth, "sample", "left").select(F.lit("sample").alias("type"), F.col("sample").alias("id"), F.array(F.log1p(F.coalesce("depth", F.lit(0)).cast("double")), F.log1p(F.coalesce("n_nonzero", F.lit(0)).cast("double"))).alias("x"))
    taxa = N.prevalence(counts).select(F.lit("taxon").alias("type"), F.col("taxon").alias("id"), F.array("prevalence").alias("x"))
    got = T.cross_validated(own.unionByName(taxa), _edges(spark, d), labels, hidden=8, passes=8)
    return M.roc_auc(got, ["protocol", "fold"])
