"""Registered queries: diversity, distances, contrasts, meta-analysis, validation, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import compose as C
from ..operators import counts as N
from ..operators import differential as D
from ..operators import diversity as B
from ..operators import gram as R
from ..operators import models as M
from ..operators import ordination as O
from ..operators import rankmerge as K
from ..operators import validation as A
from . import views as V
from .queries_data import CLR, PREVALENCE, r6, rounded
from .views import COUNTS, FRAME, SAMPLES, VECTORS

ALPHA = "alpha AS (SELECT sample, count(*) AS richness, -sum(p * ln(p)) AS shannon FROM (SELECT sample, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS p FROM counts) GROUP BY sample)"


@query(f"WITH {COUNTS}, {ALPHA} SELECT sample, richness, round(shannon, 6) AS shannon FROM alpha")
def alpha_diversity(spark, d):
    return rounded(B.alpha_diversity(V.counts(spark, d)), "shannon")


def _rank_sql(c, by=""):
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}{c}"
    return f"(rank() OVER ({part}ORDER BY {c}) + (count(*) OVER ({same}) - 1) / CAST(2 AS DOUBLE))"


@query(f"""WITH {COUNTS}, {ALPHA}, t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth FROM counts GROUP BY 1), j AS (SELECT depth, richness, shannon FROM t JOIN alpha USING (sample)),
r AS (SELECT {_rank_sql('depth')} AS a, {_rank_sql('richness')} AS b, {_rank_sql('shannon')} AS c FROM j)
SELECT 'depth' AS a, 'richness' AS b, count(*) AS n, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'depth', 'shannon', count(*), round(corr(a, c), 6) FROM r""")
def alpha_spearman(spark, d):
    counts = V.counts(spark, d)
    df = N.sample_depth(counts).select("sample", "depth").join(B.alpha_diversity(counts), "sample")
    return rounded(B.spearman(df, [("depth", "richness"), ("depth", "shannon")]), "rho")


@query(f"""WITH {COUNTS}, {SAMPLES}, rel AS (SELECT sample, taxon, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS p FROM counts),
k AS (SELECT DISTINCT sample FROM rel), m AS (SELECT x.sample AS a, y.sample AS b, sum(least(x.p, y.p)) AS s FROM rel x JOIN rel y USING (taxon) WHERE x.sample < y.sample GROUP BY 1, 2)
SELECT x.sample AS a, y.sample AS b, round(greatest(0.0, 1 - coalesce(s, 0.0)) + 1e-9, 6) AS d FROM k x JOIN k y ON x.sample < y.sample LEFT JOIN m ON m.a = x.sample AND m.b = y.sample""")
def bray_curtis(spark, d):
    # Fractions of counts often end in a 5: the smallest bit more rounds such ties one way in all engines.
    return rounded(B.bray_curtis_blocked(C.relative_abundance(V.counts(spark, d))).withColumn("d", F.col("d") + 1e-9), "d")


_DIST = "sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"WITH {VECTORS} SELECT x.sample AS a, y.sample AS b, round({_DIST}, 6) AS d FROM vectors x JOIN vectors y ON x.sample < y.sample")
def aitchison(spark, d):
    return rounded(B.euclidean_pairs_blocked(V.vectors(spark, d)), "d")


_CELLS = "cells AS (SELECT sample, project, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM vectors)"


@query(f"WITH {VECTORS}, {_CELLS}, g AS (SELECT j, sum(x * x) - sum(x) * sum(x) / count(*) AS s, count(*) AS n FROM cells GROUP BY j) SELECT round(sum(s), 6) AS inertia, max(n) AS n FROM g")
def gower_trace(spark, d):
    return rounded(B.inertia(V.vectors(spark, d)), "inertia")


@query(f"""WITH {VECTORS}, v AS (SELECT *, sample % 7 AS seventh FROM vectors), cells AS (SELECT factor, level, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM (SELECT 'project' AS factor, CAST(project AS VARCHAR) AS level, vec FROM v UNION ALL SELECT 'seventh', CAST(seventh AS VARCHAR), vec FROM v)),
w AS (SELECT factor, sum(s) AS ssw, count(DISTINCT level) AS g FROM (SELECT factor, level, j, sum(x * x) - sum(x) * sum(x) / count(*) AS s FROM cells GROUP BY 1, 2, 3) GROUP BY 1),
t AS (SELECT factor, sum(s) AS sst, max(n) AS n FROM (SELECT factor, j, sum(x * x) - sum(x) * sum(x) / count(*) AS s, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1)
SELECT factor, n, g AS n_groups, round(((sst - ssw) / (g - 1)) / (ssw / (n - g)), 6) AS pseudo_f, round((sst - ssw) / sst, 6) AS r2 FROM w JOIN t USING (factor)""")
def permanova_r2(spark, d):
    return rounded(B.permanova(V.vectors(spark, d).withColumn("seventh", F.col("sample") % 7), ["project", "seventh"]), "pseudo_f", "r2")


@query(f"""WITH {COUNTS}, {SAMPLES}, rel AS (SELECT sample, taxon, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS p FROM counts),
k AS (SELECT DISTINCT sample, project FROM rel JOIN samples USING (sample)), m AS (SELECT x.sample AS a, y.sample AS b, sum(least(x.p, y.p)) AS s FROM rel x JOIN rel y USING (taxon) WHERE x.sample < y.sample GROUP BY 1, 2),
d AS (SELECT x.project AS pa, y.project AS pb, greatest(0.0, 1 - coalesce(s, 0.0)) AS d FROM k x JOIN k y ON x.sample < y.sample LEFT JOIN m ON m.a = x.sample AND m.b = y.sample),
z AS (SELECT project, count(*) AS m FROM k GROUP BY 1), n AS (SELECT sum(m) AS n, count(*) AS g FROM z),
w AS (SELECT sum(s / m) AS ssw FROM (SELECT pa AS project, sum(d * d) AS s FROM d WHERE pa = pb GROUP BY 1) JOIN z USING (project)), t AS (SELECT sum(d * d) AS s FROM d)
SELECT 'project' AS factor, CAST(n AS BIGINT) AS n, g AS n_groups, round(((s / n - ssw) / (g - 1)) / (ssw / (n - g)), 6) AS pseudo_f, round((s / n - ssw) / (s / n), 6) AS r2 FROM w, t, n""")
def permanova_bray(spark, d):
    return rounded(B.permanova_bray(C.relative_abundance(V.counts(spark, d)), V.samples(spark, d), "project"), "pseudo_f", "r2")


def permutation_sql(pairs, rows, factor, n, seed=42):
    """PERMANOVA with ``n`` permutations by MD5, over ``pairs (a, b, d)`` and ``rows (sample, factor)``."""
    return f"""lb AS (SELECT sample, CAST({factor} AS VARCHAR) AS level FROM {rows}),
ba AS (SELECT sample, row_number() OVER (ORDER BY md5('{seed}|' || sample), sample) AS k FROM lb),
dr AS (SELECT i, level, row_number() OVER (PARTITION BY i ORDER BY md5('{seed}|' || i || '|' || sample), sample) AS k FROM lb, range(1, {n} + 1) AS r(i)),
pe AS (SELECT 0 AS i, sample, level FROM lb UNION ALL SELECT i, sample, level FROM ba JOIN dr USING (k)),
sz AS (SELECT level, count(*) AS m FROM lb GROUP BY 1), nn AS (SELECT sum(m) AS n, count(*) AS g FROM sz), al AS (SELECT sum(d * d) AS s FROM {pairs}),
wi AS (SELECT x.i, x.level, sum(d * d) AS s FROM {pairs} p JOIN pe x ON x.sample = p.a JOIN pe y ON y.sample = p.b AND y.i = x.i AND y.level = x.level GROUP BY 1, 2),
sw AS (SELECT i, sum(s / m) AS ssw FROM wi JOIN sz USING (level) GROUP BY 1), fs AS (SELECT i, n, g, s / n AS sst, ssw, ((s / n - ssw) / (g - 1)) / (ssw / (n - g)) AS f FROM sw, nn, al)
SELECT CAST(r.n AS BIGINT) AS n, r.g AS n_groups, round(r.f, 6) AS pseudo_f, round((r.sst - r.ssw) / r.sst, 6) AS r2, count(*) AS n_permutations, (count(*) FILTER (WHERE x.f >= r.f * (1 - 1e-9)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p
FROM fs r JOIN fs x ON r.i = 0 AND x.i > 0 GROUP BY r.n, r.g, r.f, r.sst, r.ssw"""


@query(f"WITH {VECTORS}, pr AS (SELECT x.sample AS a, y.sample AS b, {_DIST} AS d FROM vectors x JOIN vectors y ON x.sample < y.sample), {permutation_sql('pr', 'vectors', 'project', 999)}")
def permanova_permutations(spark, d):
    v = V.vectors(spark, d)
    return rounded(O.permutation_p(O.permutation_f(O.Blocks(v), v, "project", 999)), "pseudo_f", "r2")


@query(f"""WITH {COUNTS}, {SAMPLES}, rel AS (SELECT sample, taxon, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS p FROM counts), k AS (SELECT DISTINCT sample, project FROM rel JOIN samples USING (sample)),
m AS (SELECT x.sample AS a, y.sample AS b, sum(least(x.p, y.p)) AS s FROM rel x JOIN rel y USING (taxon) WHERE x.sample < y.sample GROUP BY 1, 2),
pr AS (SELECT x.sample AS a, y.sample AS b, greatest(0.0, 1 - coalesce(s, 0.0)) AS d FROM k x JOIN k y ON x.sample < y.sample LEFT JOIN m ON m.a = x.sample AND m.b = y.sample), {permutation_sql('pr', 'k', 'project', 99)}""")
def permanova_bray_permutations(spark, d):
    relative = C.relative_abundance(V.counts(spark, d))
    v = C.vectors(relative, relative.select("sample").distinct().withColumn("none", F.lit(0.0)), relative.select("taxon").distinct(), "relative", "none")
    return rounded(O.permutation_p(O.permutation_f(O.Blocks(v, O.bray), V.samples(spark, d), "project", 99)), "pseudo_f", "r2")


@query(f"""WITH {VECTORS}, v AS (SELECT *, sample % 7 AS seventh FROM vectors), c AS (SELECT project, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM v),
t AS (SELECT sum(s) AS sst FROM (SELECT sum(x * x) - sum(x) * sum(x) / count(*) AS s FROM c GROUP BY j)), w AS (SELECT sum(s) AS ssw FROM (SELECT sum(x * x) - sum(x) * sum(x) / count(*) AS s FROM c GROUP BY j, project)),
n AS (SELECT count(*) AS n, count(DISTINCT project) AS g FROM vectors)
SELECT 1 AS term_order, 'project' AS factor, CAST(g - 1 AS INT) AS df, round(sst - ssw, 5) AS ss, round((sst - ssw) / sst, 6) AS r2, round(((sst - ssw) / (g - 1)) / (ssw / (n - g)), 6) AS pseudo_f FROM t, w, n
UNION ALL SELECT 2, 'Residual', CAST(n - g AS INT), round(ssw, 5), round(ssw / sst, 6), NULL FROM t, w, n""")
def dbrda_one_term(spark, d):
    return B.sequential_ss(V.vectors(spark, d), ["project"]).drop("p").withColumns({"ss": F.round("ss", 5), "r2": r6(F.col("r2")), "pseudo_f": r6(F.col("pseudo_f"))})


@query()
def dbrda_sequential(spark, d):
    return B.sequential_ss(V.vectors(spark, d).withColumn("seventh", F.col("sample") % 7), ["seventh", "project"], permutations=999)


@query()
def pca_coords(spark, d):
    return B.principal_coordinates(V.vectors(spark, d), 3)[0]


@query(f"""WITH {SAMPLES}, c AS (SELECT sample, project, CASE WHEN disease_category IN ('MACHINERY', 'FURNITURE') THEN 'GOODS' ELSE disease_category END AS disease_category FROM samples WHERE disease_label = 'case'), p AS (SELECT DISTINCT project, disease_category FROM c)
SELECT sample, project, disease_category, 1 AS y FROM c UNION ALL SELECT sample, samples.project, p.disease_category, 0 FROM samples JOIN p ON samples.project = p.project WHERE disease_label = 'healthy'""")
def analysis_frame(spark, d):
    return D.analysis_frame(V.samples(spark, d), {"MACHINERY": "GOODS", "FURNITURE": "GOODS"})


@query(f"""WITH {SAMPLES}, {FRAME}, c AS (SELECT disease_category, project, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM frame GROUP BY 1, 2)
SELECT disease_category, count(*) AS n_projects, CAST(sum(a) AS BIGINT) AS n_case, CAST(sum(b) AS BIGINT) AS n_control FROM c WHERE a >= 25 AND b >= 25 GROUP BY 1 HAVING count(*) >= 2 AND sum(a) >= 60""")
def eligible_categories(spark, d):
    return D.eligible_categories(V.frame(spark, d), 2, 60, (25, 25))


@query(f"""WITH {SAMPLES}, f AS (SELECT disease_category, project, CAST(disease_label = 'case' AS INT) AS y, CASE WHEN row_id % 4 > 0 THEN nation END AS nation, CAST(row_id AS VARCHAR) AS id FROM samples),
l AS (SELECT disease_category, project, y, 'nation' AS covariate, nation AS v FROM f UNION ALL SELECT disease_category, project, y, 'id', id FROM f),
a AS (SELECT disease_category, project, covariate, y, avg(CAST(v IS NOT NULL AS DOUBLE)) AS filled FROM l GROUP BY ALL), b AS (SELECT disease_category, project, covariate, min(filled) AS m FROM a GROUP BY ALL), c AS (SELECT disease_category, project, covariate, count(DISTINCT v) > 1 AS varies FROM l GROUP BY ALL)
SELECT disease_category, project, covariate, round(m, 6) AS min_filled, varies, m >= 0.8 AND varies AS used FROM b JOIN c USING (disease_category, project, covariate)""")
def pick_covariates(spark, d):
    s = V.samples(spark, d).select("disease_category", "project", (F.col("disease_label") == "case").cast("int").alias("y"), F.when(F.col("row_id") % 4 > 0, F.col("nation")).alias("nation"), F.col("row_id").alias("id"))
    return rounded(D.pick_covariates(s, ["nation", "id"]), "min_filled")


# Prevalent counts, CLR on them, and per-contrast moments over dense cells.
_DENSE = f"""{COUNTS}, {SAMPLES}, {FRAME}, {CLR},
dense AS (SELECT f.sample, project, disease_category, y, taxon, coalesce(clr, zero_clr) AS v, clr IS NOT NULL AS present FROM frame f JOIN zeros USING (sample) CROSS JOIN (SELECT DISTINCT taxon FROM counts) LEFT JOIN clr USING (sample, taxon))"""
_OLS = f"""{_DENSE},
mo AS (SELECT disease_category, project, taxon, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE present) AS np, avg(v) FILTER (WHERE y = 1) AS m1, avg(v) FILTER (WHERE y = 0) AS m0, var_pop(v) FILTER (WHERE y = 1) AS v1, var_pop(v) FILTER (WHERE y = 0) AS v0 FROM dense GROUP BY 1, 2, 3),
ols AS (SELECT disease_category, project, taxon, n1 AS n_case, n0 AS n_control, np AS n_present, m1 - m0 AS effect, sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS se FROM mo WHERE n1 >= 10 AND n0 >= 10 AND np >= CAST(0.1 AS DOUBLE) * (n1 + n0))"""


def _clr(spark, d):
    counts = V.counts(spark, d)
    values, zeros, _ = C.clr(counts)
    return counts, values, zeros


def _contrasts(spark, d):
    _, values, zeros = _clr(spark, d)
    m = D.contrast_moments(values, zeros, V.frame(spark, d), 0.1)
    return D.ols_contrasts(m.filter("n_case >= 10 AND n_control >= 10"))


@query(f"WITH {_OLS} SELECT disease_category, project, taxon, n_case, n_control, n_present, round(effect, 6) + 0.0 AS effect, round(se, 6) AS se, round(effect / se, 5) + 0.0 AS stat, CAST(n_case + n_control - 2 AS DOUBLE) AS dof FROM ols")
def ols_contrast(spark, d):
    return rounded(_contrasts(spark, d), "effect", "se").withColumn("stat", F.round("stat", 5) + 0.0)


_META = f"""{_OLS}, w AS (SELECT *, se * se AS v, 1 / (se * se) AS w FROM ols WHERE se > 0),
one AS (SELECT disease_category, taxon, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * effect) AS swy, sum(w * effect * effect) AS swyy, sum(n_case) AS n_case, sum(n_control) AS n_control FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT *, greatest(0.0, swyy - swy * swy / sw) AS qs, sw - sww / sw AS c FROM one), t AS (SELECT *, greatest(0.0, (qs - (k - 1)) / c) AS tau2 FROM q),
two AS (SELECT disease_category, taxon, sum(1 / (v + tau2)) AS s, sum(effect / (v + tau2)) AS sy FROM w JOIN t USING (disease_category, taxon) GROUP BY 1, 2),
meta AS (SELECT disease_category, taxon, k AS k_projects, sy / s AS pooled_effect, sqrt(1 / s) AS se, sy / s / sqrt(1 / s) AS z, qs AS q_stat, CASE WHEN qs > 0 THEN greatest(0.0, (qs - (k - 1)) / qs) * 100 ELSE 0.0 END AS i2, tau2, CAST(t.n_case AS BIGINT) AS n_case, CAST(t.n_control AS BIGINT) AS n_control FROM t JOIN two USING (disease_category, taxon))"""


@query(f"""WITH {_META}, sg AS (SELECT disease_category, taxon, avg(CAST(sign(w.effect) = sign(m.pooled_effect) AS DOUBLE)) AS sign_consistency FROM w JOIN meta m USING (disease_category, taxon) GROUP BY 1, 2)
SELECT disease_category, taxon, k_projects, round(pooled_effect, 6) + 0.0 AS pooled_effect, round(se, 6) AS se, round(pooled_effect - 1.96 * se, 6) + 0.0 AS ci_low, round(pooled_effect + 1.96 * se, 6) + 0.0 AS ci_high, round(z, 5) + 0.0 AS z,
  round(q_stat, 5) AS q_stat, round(i2, 4) AS i2, round(tau2, 6) AS tau2, n_case, n_control, round(sign_consistency, 6) AS sign_consistency FROM meta JOIN sg USING (disease_category, taxon)""")
def meta_dl(spark, d):
    out = D.meta_analysis(_contrasts(spark, d), with_p=False)
    return rounded(out, "pooled_effect", "se", "ci_low", "ci_high", "tau2", "sign_consistency").withColumns({"z": F.round("z", 5) + 0.0, "q_stat": F.round("q_stat", 5), "i2": F.round("i2", 4)})


def _cells(spark, d):
    counts, values, zeros = _clr(spark, d)
    return C.dense(values, zeros.join(V.frame(spark, d), "sample"), counts.select("taxon").distinct(), keep=["project", "disease_category", "y"]).withColumnRenamed("clr", "v")


@query(f"""WITH {_DENSE}, r AS (SELECT disease_category, project, taxon, y, v, {_rank_sql('v', 'disease_category, project, taxon')} AS r, count(*) OVER (PARTITION BY disease_category, project, taxon, v) AS t FROM (SELECT * REPLACE (round(v, 9) AS v) FROM dense)),
g AS (SELECT disease_category, project, taxon, count(*) FILTER (WHERE y = 1) AS n_case, count(*) FILTER (WHERE y = 0) AS n_control, sum(r) FILTER (WHERE y = 1) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties, min(v) < max(v) AS varies FROM r GROUP BY 1, 2, 3)
SELECT disease_category, project, taxon, n_case, n_control, CASE WHEN ok THEN u END AS u, round(CASE WHEN ok THEN 2 * u / (n_case * n_control) - 1 END, 6) + 0.0 AS rank_biserial, ties FROM (SELECT *, r1 - n_case * (n_case + 1) / 2.0 AS u, n_case >= 3 AND n_control >= 3 AND varies AS ok FROM g)""")
def wilcoxon_u(spark, d):
    return rounded(_rank_sums(spark, d), "rank_biserial")


def _rank_sums(spark, d):
    # Nine digits: what differs in the last bits alone is a tie in any engine.
    counts, values, zeros = _clr(spark, d)
    rows = R.contrast_rows(V.frame(spark, d), zeros.withColumn("zero_clr", F.round("zero_clr", 9)))
    return K.sparse_rank_sums(values.withColumn("clr", F.round("clr", 9)), rows, taxa=counts.select("taxon").distinct())


def rank_p_sql(u, n1, n0, ties):
    """Two-sided normal p with tie and continuity correction."""
    n = f"({n1} + {n0})"
    var = f"({n1} * {n0} / CAST(12 AS DOUBLE) * ({n} + 1 - {ties} / ({n} * CAST({n} - 1 AS DOUBLE))))"
    x = f"greatest((greatest({u}, {n1} * {n0} - {u}) - {n1} * {n0} / CAST(2 AS DOUBLE) - 0.5) / sqrt({var}) / sqrt(2), 1e-300)"
    return f"greatest(0.0, 1 - list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5) - {x} * {x}))))"


@query(f"""WITH {_DENSE}, r AS (SELECT disease_category, project, taxon, y, v, {_rank_sql('v', 'disease_category, project, taxon')} AS r, count(*) OVER (PARTITION BY disease_category, project, taxon, v) AS t FROM (SELECT * REPLACE (round(v, 9) AS v) FROM dense)),
g AS (SELECT disease_category, project, taxon, count(*) FILTER (WHERE y = 1) AS n_case, count(*) FILTER (WHERE y = 0) AS n_control, sum(r) FILTER (WHERE y = 1) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties, min(v) < max(v) AS varies FROM r GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN n_case >= 3 AND n_control >= 3 AND varies THEN r1 - n_case * (n_case + 1) / 2.0 END AS u FROM g)
SELECT disease_category, project, taxon, n_case, n_control, u, CASE WHEN u IS NOT NULL AND (least(n_case, n_control) > 8 OR ties > 0) THEN round({rank_p_sql('u', 'n_case', 'n_control', 'ties')}, 6) END AS wilcoxon_p FROM o""")
def wilcoxon_p(spark, d):
    # Arms of 8 and less without ties have an exact p, which the SQL leaves null: the smallest
    # table alone has such arms.
    return rounded(D.with_rank_p(_rank_sums(spark, d)).select("disease_category", "project", "taxon", "n_case", "n_control", "u", "wilcoxon_p"), "wilcoxon_p")


def partial_sql(x, y="y", v="v"):
    """Sums of centred products of ``y``, ``x`` and ``v`` in a group, by name."""
    pair = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    return ", ".join(f"{pair(a, b)} AS s{m}{n}" for m, a, n, b in (("y", y, "y", y), ("x", x, "x", x), ("y", y, "x", x), ("y", y, "v", v), ("x", x, "v", v), ("v", v, "v", v)))


_EFFECT = "(syv * sxx - sxv * syx) / (syy * sxx - syx * syx)"
_RSS = f"(svv - {_EFFECT} * syv - (sxv * syy - syv * syx) / (syy * sxx - syx * syx) * sxv)"


@query(f"""WITH {_DENSE}, dp AS (SELECT sample, CAST(sum(n) AS DOUBLE) AS x FROM counts GROUP BY 1),
g AS (SELECT disease_category, project, taxon, count(*) FILTER (WHERE y = 1) AS n_case, count(*) FILTER (WHERE y = 0) AS n_control, count(*) FILTER (WHERE present) AS n_present, {partial_sql('x')} FROM dense JOIN dp USING (sample) GROUP BY 1, 2, 3),
f AS (SELECT *, CAST(n_case + n_control - 3 AS DOUBLE) AS dof, {_EFFECT} AS effect, {_RSS} AS rss FROM g WHERE n_present > 0 AND n_case > 0 AND n_control > 0)
SELECT disease_category, project, taxon, n_case, n_control, n_present, round(effect, 6) + 0.0 AS effect, round(sqrt(rss / dof * sxx / (syy * sxx - syx * syx)), 6) AS se, dof FROM f""")
def ols_contrast_cov(spark, d):
    counts, values, zeros = _clr(spark, d)
    depth = N.sample_depth(counts).select("sample", F.col("depth").cast("double").alias("depth"))
    rows = R.contrast_rows(V.frame(spark, d).join(depth, "sample"), zeros, ["depth"])
    return rounded(R.covariate_contrasts(values, rows, ["depth"], min_prevalence=0.0).drop("stat", "covariates"), "effect", "se")


@query(f"""WITH {COUNTS}, {PREVALENCE}, p AS (SELECT split_part(taxon, '.', 1) AS block, taxon, CASE WHEN n_present % 7 > 0 THEN prevalence * prevalence END AS p FROM prevalence),
r AS (SELECT *, row_number() OVER (PARTITION BY block, p IS NULL ORDER BY p) AS k, count(p) OVER (PARTITION BY block) AS m FROM p)
SELECT block, taxon, round(p, 9) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / k) OVER (PARTITION BY block, p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS q FROM r""")
def bh_fdr(spark, d):
    p = N.prevalence(V.counts(spark, d)).select(F.split_part("taxon", F.lit("."), F.lit(1)).alias("block"), "taxon", F.when(F.col("n_present") % 7 > 0, F.col("prevalence") * F.col("prevalence")).alias("p"))
    return rounded(D.bh_fdr(p, by=["block"]), "q").withColumn("p", F.round("p", 9))


_COMBAT = f"""{_DENSE}, x AS (SELECT disease_category, taxon, project, sample, y, v FROM dense),
a1 AS (SELECT *, avg(v) OVER b AS mv, avg(CAST(y AS DOUBLE)) OVER b AS my FROM x WINDOW b AS (PARTITION BY disease_category, taxon, project)),
a2 AS (SELECT *, coalesce(sum((y - my) * v) OVER c / nullif(sum((y - my) * (y - my)) OVER c, 0), 0) AS b FROM a1 WINDOW c AS (PARTITION BY disease_category, taxon)),
a3 AS (SELECT *, mv - b * my AS a FROM a2), a4 AS (SELECT *, avg(a) OVER (PARTITION BY disease_category, taxon) AS grand, v - a - b * y AS res FROM a3),
a5 AS (SELECT *, sqrt(avg(res * res) OVER (PARTITION BY disease_category, taxon)) AS sd FROM a4), a6 AS (SELECT *, coalesce((v - grand - b * y) / nullif(sd, 0), 0) AS z FROM a5),
g AS (SELECT disease_category, taxon, project, avg(z) AS gamma, var_samp(z) AS delta FROM a6 GROUP BY 1, 2, 3),
combat AS (SELECT disease_category, taxon, project, sample, y, v, (z - gamma) / sqrt(CASE WHEN delta > 0 THEN delta ELSE 1 END) * sd + grand + b * y AS adjusted FROM a6 JOIN g USING (disease_category, taxon, project))"""


@query(f"WITH {_COMBAT} SELECT disease_category, taxon, project, sample, y, round(adjusted, 5) + 0.0 AS adjusted FROM combat")
def combat_ls(spark, d):
    cells = _cells(spark, d)
    return D.combat(cells, eb=False).select("disease_category", "taxon", "project", "sample", "y", (F.round("adjusted", 5) + 0.0).alias("adjusted"))


@query()
def combat_eb(spark, d):
    return D.combat(_cells(spark, d))


@query(f"""WITH {_COMBAT}, m AS (SELECT disease_category, taxon, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(DISTINCT project) AS k, avg(adjusted) FILTER (WHERE y = 1) - avg(adjusted) FILTER (WHERE y = 0) AS e, var_pop(adjusted) FILTER (WHERE y = 1) AS v1, var_pop(adjusted) FILTER (WHERE y = 0) AS v0 FROM combat GROUP BY 1, 2),
s AS (SELECT *, sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS se FROM m)
SELECT disease_category, taxon, n1 AS n_case, n0 AS n_control, k AS k_projects, round(e, 5) + 0.0 AS effect, round(se, 5) AS se, round(e / se, 4) + 0.0 AS stat, CAST(n1 + n0 - 2 AS DOUBLE) AS dof FROM s""")
def pooled_ols(spark, d):
    cells = _cells(spark, d)
    out = D.pooled_ols(D.combat(cells, eb=False), with_p=False)
    return out.withColumns({"effect": F.round("effect", 5) + 0.0, "se": F.round("se", 5), "stat": F.round("stat", 4) + 0.0})


@query()
def mixedlm(spark, d):
    return D.mixed_model(_cells(spark, d))


# Synthetic scores of two arms, from hashes, for the joins after the tests.
_ARMS = f"""{COUNTS}, tx AS (SELECT DISTINCT taxon FROM counts), h AS (SELECT taxon, c AS disease_category, (CAST('0x' || substr(md5(taxon || c), 1, 6) AS INT) % 1000) / CAST(1000 AS DOUBLE) AS u, (CAST('0x' || substr(md5(c || taxon), 1, 6) AS INT) % 1000) / CAST(1000 AS DOUBLE) AS w FROM tx, (VALUES ('A'), ('B')) AS t(c)),
meta AS (SELECT disease_category, taxon, u - 0.5::DOUBLE AS e, u * u AS q, CAST(3 AS BIGINT) AS k FROM h WHERE u < 0.8), pooled AS (SELECT disease_category, taxon, u * w - 0.3::DOUBLE AS e, w * w AS q FROM h WHERE w < 0.9)"""


def _arms(spark, d):
    taxa = V.counts(spark, d).select("taxon").distinct()
    u = lambda *c: (F.conv(F.substring(F.md5(F.concat(*c)), 1, 6), 16, 10).cast("int") % 1000) / 1000.0
    h = taxa.select("taxon", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("disease_category")).withColumn("u", u("taxon", "disease_category")).withColumn("w", u("disease_category", "taxon"))
    meta = h.filter("u < 0.8").select("disease_category", "taxon", (F.col("u") - 0.5).alias("pooled_effect"), (F.col("u") * F.col("u")).alias("q"), F.lit(3).cast("bigint").alias("k_projects"))
    pooled = h.filter("w < 0.9").select("disease_category", "taxon", (F.col("u") * F.col("w") - 0.3).alias("effect"), (F.col("w") * F.col("w")).alias("q"))
    return meta, pooled


_CONCORD = f"""{_ARMS}, conc AS (SELECT disease_category, taxon, m.e AS meta_effect, m.q AS meta_q, k AS k_projects, p.e AS pooled_effect, p.q AS pooled_q,
  CASE WHEN m.q < 0.05 AND p.q < 0.05 THEN 'replicated' WHEN p.q < 0.05 THEN 'pooling_only' WHEN m.q < 0.05 THEN 'within_only' ELSE 'neither' END AS concordance_class, coalesce(sign(m.e) = sign(p.e), FALSE) AS sign_agree FROM meta m FULL JOIN pooled p USING (disease_category, taxon))"""


@query(f"WITH {_CONCORD} SELECT disease_category, taxon, round(meta_effect, 6) + 0.0 AS meta_effect, round(meta_q, 6) AS meta_q, CAST(k_projects AS DOUBLE) AS k_projects, round(pooled_effect, 6) + 0.0 AS pooled_effect, round(pooled_q, 6) AS pooled_q, concordance_class, sign_agree FROM conc")
def concordance(spark, d):
    return rounded(D.concordance(*_arms(spark, d)), "meta_effect", "meta_q", "pooled_effect", "pooled_q").withColumn("k_projects", F.col("k_projects").cast("double"))


@query(f"""WITH {_CONCORD}, c AS (SELECT disease_category, count(*) AS n_taxa, count(*) FILTER (WHERE t) AS n_tested_both, count(*) FILTER (WHERE concordance_class = 'replicated') AS n_replicated, count(*) FILTER (WHERE concordance_class = 'pooling_only') AS n_pooling_only, count(*) FILTER (WHERE concordance_class = 'within_only') AS n_within_only, round(avg(CAST(sign_agree AS DOUBLE)) FILTER (WHERE t), 6) AS sign_agreement FROM (SELECT *, meta_effect IS NOT NULL AND pooled_effect IS NOT NULL AS t FROM conc) GROUP BY 1),
r AS (SELECT disease_category, {_rank_sql('meta_effect', 'disease_category')} AS a, {_rank_sql('pooled_effect', 'disease_category')} AS b FROM conc WHERE meta_effect IS NOT NULL AND pooled_effect IS NOT NULL)
SELECT c.*, s.rho AS spearman_effect FROM c LEFT JOIN (SELECT disease_category, round(corr(a, b), 6) AS rho FROM r GROUP BY 1) s USING (disease_category)""")
def concordance_summary(spark, d):
    return rounded(D.concordance_summary(D.concordance(*_arms(spark, d))), "sign_agreement", "spearman_effect")


@query(f"WITH {_CONCORD} SELECT disease_category, string_agg(taxon, ',' ORDER BY taxon) AS taxa, count(*) AS n_taxa FROM conc WHERE concordance_class = 'replicated' GROUP BY 1")
def replicated_sets(spark, d):
    return A.replicated_sets(D.concordance(*_arms(spark, d)))


@query(f"""WITH {_CONCORD}, pr AS (SELECT * FROM (VALUES ('A', 'brand#1', 'up', 1), ('A', 'small', 'down', 2), ('B', 'PROMO', 'up', 1)) AS t(c, name, direction, priority)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease_category ORDER BY meta_q, taxon) AS place FROM conc WHERE concordance_class = 'replicated') WHERE place <= 15),
j AS (SELECT disease_category, taxon, meta_effect, meta_q, place, arg_min(direction, priority) AS expected FROM b LEFT JOIN pr ON c = disease_category AND contains(lower(taxon), lower(name)) GROUP BY 1, 2, 3, 4, 5)
SELECT disease_category, taxon, round(meta_effect, 6) AS meta_effect, round(meta_q, 6) AS meta_q, CAST(place AS INT) AS place, expected, CASE WHEN meta_effect > 0 THEN 'up' ELSE 'down' END AS observed, CASE WHEN expected IS NULL THEN 'no_prior' WHEN expected = CASE WHEN meta_effect > 0 THEN 'up' ELSE 'down' END THEN 'concordant' ELSE 'discordant' END AS verdict FROM j""")
def literature_check(spark, d):
    priors = spark.createDataFrame([("A", "brand#1", "up", 1), ("A", "small", "down", 2), ("B", "PROMO", "up", 1)], "disease_category string, name string, direction string, priority int")
    return rounded(A.literature_check(D.concordance(*_arms(spark, d)).withColumn("genus", F.col("taxon")), priors).drop("genus"), "meta_effect", "meta_q")


@query(f"""WITH {COUNTS}, {SAMPLES}, {FRAME}, {CLR}, ids AS (SELECT *, unnest(range(1, 4)) AS shuffle_id FROM frame),
a AS (SELECT *, row_number() OVER (PARTITION BY shuffle_id, disease_category, project ORDER BY sample) AS k FROM ids), b AS (SELECT shuffle_id, disease_category, project, y AS v, row_number() OVER (PARTITION BY shuffle_id, disease_category, project ORDER BY md5('42|' || CAST(shuffle_id AS VARCHAR) || '|' || sample), sample) AS k FROM ids),
s AS (SELECT a.shuffle_id, a.sample, a.project, a.disease_category, b.v AS y FROM a JOIN b USING (shuffle_id, disease_category, project, k)),
dense AS (SELECT shuffle_id, s.sample, project, disease_category, y, taxon, coalesce(clr, zero_clr) AS v, clr IS NOT NULL AS present FROM s JOIN zeros USING (sample) CROSS JOIN (SELECT DISTINCT taxon FROM counts) LEFT JOIN clr USING (sample, taxon)),
mo AS (SELECT shuffle_id, disease_category, project, taxon, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE present) AS np, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS e, var_pop(v) FILTER (WHERE y = 1) AS v1, var_pop(v) FILTER (WHERE y = 0) AS v0 FROM dense GROUP BY 1, 2, 3, 4),
w AS (SELECT shuffle_id, disease_category, taxon, e, (n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0) AS v FROM mo WHERE np >= CAST(0.1 AS DOUBLE) * (n1 + n0) AND n1 + n0 > 2),
one AS (SELECT shuffle_id, disease_category, taxon, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sww, sum(e / v) AS swy, sum(e * e / v) AS swyy FROM w WHERE v > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
t AS (SELECT *, greatest(0.0, (greatest(0.0, swyy - swy * swy / sw) - (k - 1)) / (sw - sww / sw)) AS tau2 FROM one),
z AS (SELECT shuffle_id, disease_category, taxon, sum(e / (v + tau2)) / sqrt(sum(1 / (v + tau2))) AS z FROM w JOIN t USING (shuffle_id, disease_category, taxon) GROUP BY 1, 2, 3)
SELECT CAST(shuffle_id AS INT) AS shuffle_id, disease_category, count(*) AS n_taxa, count(*) FILTER (WHERE abs(z) > 1.96) AS n_hits FROM z GROUP BY 1, 2""")
def shuffle_null(spark, d):
    _, values, zeros = _clr(spark, d)
    return A.shuffle_null(values, zeros, V.frame(spark, d), 3)


@query(f"""WITH {COUNTS}, {SAMPLES}, {FRAME}, t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1), x AS (SELECT frame.*, unnest([400, 800, 1200]) AS threshold, depth FROM frame JOIN t USING (sample))
SELECT threshold, disease_category, project, count(*) FILTER (WHERE y = 1) AS n_case, count(*) FILTER (WHERE y = 0) AS n_control FROM x WHERE depth >= threshold GROUP BY 1, 2, 3""")
def depth_sweep(spark, d):
    df = A.at_thresholds(V.frame(spark, d), N.sample_depth(V.counts(spark, d)), [400, 800, 1200])
    return df.groupBy("threshold", "disease_category", "project").agg(F.count_if(F.expr("y = 1")).alias("n_case"), F.count_if(F.expr("y = 0")).alias("n_control"))


@query(f"WITH {_ARMS}, s AS (SELECT disease_category, taxon, unnest([1, 2, 3]) AS threshold, q FROM meta) SELECT disease_category, taxon, string_agg(CAST(threshold AS VARCHAR), ',' ORDER BY threshold) AS thresholds, count(*) = 3 AS stable FROM s WHERE q * threshold < 0.1 GROUP BY 1, 2")
def hit_stability(spark, d):
    s = _arms(spark, d)[0].select("disease_category", "taxon", "q", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("threshold")).filter("q * threshold < 0.1")
    return A.stability(s, "threshold", 3)


@query(f"WITH {_ARMS} SELECT disease_category, count(a.taxon) AS hits_a, count(b.taxon) AS hits_b, count(*) FILTER (WHERE a.taxon = b.taxon) AS hits_shared FROM (SELECT * FROM meta WHERE q < 0.2) a FULL JOIN (SELECT * FROM pooled WHERE q < 0.2) b USING (disease_category, taxon) GROUP BY 1")
def transform_overlap(spark, d):
    meta, pooled = _arms(spark, d)
    return A.overlap(meta.filter("q < 0.2"), pooled.filter("q < 0.2"))


@query(f"WITH {COUNTS}, {PREVALENCE} SELECT tier, count(*) AS n_taxa FROM prevalence, (VALUES (CAST(0.2 AS DOUBLE)), (CAST(0.25 AS DOUBLE))) AS t(tier) WHERE prevalence >= tier GROUP BY 1")
def prevalence_sensitivity(spark, d):
    return A.in_tiers(N.prevalence(V.counts(spark, d)), [0.2, 0.25]).groupBy("tier").agg(F.count(F.lit(1)).alias("n_taxa"))


# Scores of a fixed rule for the score aggregates.
_SCORES = f"""{SAMPLES}, sc AS (SELECT sample, nation AS fold, CAST(disease_label = 'case' AS INT) AS y, round(c_acctbal / 1000 + (row_id * 7919 % 13), 0) AS score FROM samples)"""


def _scores(spark, d):
    return V.samples(spark, d).select("sample", F.col("nation").alias("fold"), (F.col("disease_label") == "case").cast("int").alias("y"), F.round(F.col("c_acctbal") / 1000 + F.col("row_id") * 7919 % 13, 0).alias("score"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, {_rank_sql('score', 'fold')} AS r FROM sc)
SELECT fold, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_test_pos FROM r GROUP BY fold""")
def auc_by_fold(spark, d):
    return rounded(M.roc_auc(_scores(spark, d)), "auc")


@query(f"""WITH {_SCORES}, p AS (SELECT fold, y AS label, CAST(score > 9 AS INT) AS prediction FROM sc), r AS (SELECT fold, label, count(*) AS n, avg(CAST(label = prediction AS DOUBLE)) AS recall FROM p GROUP BY 1, 2)
SELECT fold, round(sum(recall * n) / sum(n), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS majority_baseline, CAST(sum(n) AS BIGINT) AS n_test FROM r GROUP BY fold""")
def accuracy_by_fold(spark, d):
    p = _scores(spark, d).select("fold", F.col("y").alias("label"), (F.col("score") > 9).cast("int").alias("prediction"))
    return rounded(M.accuracy(p), "accuracy", "balanced_accuracy", "majority_baseline")


@query(f"""WITH {VECTORS}, s AS (SELECT sample, project AS label, unnest(vec[1:10]) AS score, generate_subscripts(vec[1:10], 1) - 1 AS cls FROM vectors), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, cls) AS k FROM s)
SELECT sample, label, CAST(min(cls) FILTER (WHERE k = 1) AS INT) AS predicted, bool_or(cls = label) AS in_top_k FROM k WHERE k <= 5 GROUP BY 1, 2""")
def topk_accuracy(spark, d):
    s = V.vectors(spark, d).select("sample", F.col("project").alias("label"), F.posexplode(F.slice("vec", 1, 10)).alias("cls", "score"))
    return M.top_k(s, "sample")


@query(f"""WITH {_SCORES}, r AS (SELECT CASE WHEN fold < 'NATION_2' THEN 'lopo' ELSE 'random' END AS cv_scheme, right(fold, 1) AS model, avg(score) AS auc FROM sc GROUP BY fold), g AS (SELECT model, avg(auc) FILTER (WHERE cv_scheme = 'lopo') AS lopo, avg(auc) FILTER (WHERE cv_scheme = 'random') AS random FROM r GROUP BY model)
SELECT model, round(lopo, 6) AS lopo, round(random, 6) AS random, round(random - lopo, 6) AS gap FROM g""")
def leakage_gap(spark, d):
    s = _scores(spark, d).groupBy("fold").agg(F.avg("score").alias("auc")).select(F.when(F.col("fold") < "NATION_2", "lopo").otherwise("random").alias("cv_scheme"), F.right("fold", F.lit(1)).alias("model"), "auc")
    return rounded(M.leakage_gap(s, ["model"]), "lopo", "random", "gap")


@query(f"WITH {_SCORES}, r AS (SELECT right(fold, 1) AS model, fold, avg(score) AS auc FROM sc GROUP BY fold) SELECT model, round(avg(auc), 6) AS mean_score, round(stddev_samp(auc), 6) AS sd_score, count(*) AS n_folds FROM r GROUP BY model")
def leakage_summary(spark, d):
    s = _scores(spark, d).groupBy(F.right("fold", F.lit(1)).alias("model"), "fold").agg(F.avg("score").alias("auc"))
    return rounded(M.summary(s, ["model"]), "mean_score", "sd_score")


@query()
def leakage_cv(spark, d):
    from pyspark.ml.functions import array_to_vector

    from ..operators.sampling import group_folds, stratified_folds

    v = V.vectors(spark, d).select("sample", (F.col("project") % 2).alias("y"), (F.col("sample") % 5).alias("study"), array_to_vector("vec").alias("features"))
    random = stratified_folds(v, "y", "sample", 3).withColumn("cv_scheme", F.lit("random"))
    lopo = group_folds(v, "study").withColumn("cv_scheme", F.lit("lopo"))
    out = None
    for t in (random, lopo):
        s = M.cross_validated(t, ["logreg"]).withColumn("cv_scheme", F.lit(t.select("cv_scheme").first()[0]))
        out = s if out is None else out.unionByName(s)
    return M.roc_auc(out, ["cv_scheme", "model", "fold"])


@query()
def batch_leakage(spark, d):
    """Both schemes and models: penalty 1; 60 rounds of depth 3, a pass each level."""
    from ..operators import folds as L
    from ..operators.sampling import group_folds, stratified_folds

    v = V.vectors(spark, d).select("sample", (F.col("project") % 2).alias("y"), (F.col("sample") % 5).alias("study"), F.col("vec").alias("features"))
    dealt = group_folds(stratified_folds(v, "y", "sample", 5).withColumnRenamed("fold", "random"), "study").withColumnRenamed("fold", "lopo")
    return L.batch_leakage(dealt, {"random": "random", "lopo": "lopo"}, rounds=60)
