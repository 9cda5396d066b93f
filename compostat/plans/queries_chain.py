"""Registered queries: the whole differential chain, with p and q, alone and swept over
depth thresholds, transforms and prevalence tiers.

The SQL has the tail areas as series of positive terms, by the logarithm of the gamma
function: of Student's t from the incomplete beta function, of the normal from the error
function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import batch as T
from ..operators import compose as C
from ..operators import counts as N
from ..operators import differential as D
from ..operators import validation as A
from . import views as V
from .queries_data import CLR, PREVALENCE, rounded
from .queries_stats import _EFFECT, _META, _RSS, _contrasts, _rank_sql, partial_sql, rank_p_sql
from .views import COUNTS, FRAME, FRAME_COV, SAMPLES

DEPTHS, TIERS, ALPHA = [400, 800, 1200], [0.2, 0.25], 0.05


def _t_p(t, dof):
    y = f"greatest({t} * {t} / ({dof} + {t} * {t}), 1e-300)"
    return f"greatest(0.0, 1 - list_sum(list_transform(range(0, 600), lambda n: exp(lgamma({dof} / 2 + 0.5 + n) - lgamma({dof} / 2) - lgamma(1.5 + n) + (n + 0.5) * ln({y}) + {dof} / 2 * ln(1 - {y})))))"


def _normal_p(z):
    x = f"greatest(abs({z}) / sqrt(2), 1e-300)"
    return f"greatest(0.0, 1 - list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5) - {x} * {x}))))"


def _q(table, block):
    return f"""SELECT * EXCLUDE (k, m), least(1.0, min(p * m / k) OVER (PARTITION BY {block} ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY {block} ORDER BY p) AS k, count(*) OVER (PARTITION BY {block}) AS m FROM {table})"""


def chain_sql(s=""):
    """The chain over ``dense (sample, project, disease_category, y, taxon, v, present)``, with
    a scenario column ``s`` where one is named."""
    c = f"{s + ', ' if s else ''}disease_category"
    t = f"{c}, taxon"
    return f"""mo AS (SELECT {t}, project, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE present) AS np, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS e, var_pop(v) FILTER (WHERE y = 1) AS v1, var_pop(v) FILTER (WHERE y = 0) AS v0 FROM dense GROUP BY {t}, project),
ols AS (SELECT {t}, project, n1 AS n_case, n0 AS n_control, np AS n_present, e AS effect, sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS se, CAST(n1 + n0 - 2 AS DOUBLE) AS dof FROM mo WHERE n1 >= 10 AND n0 >= 10 AND np >= CAST(0.1 AS DOUBLE) * (n1 + n0)),
ps AS (SELECT *, effect / se AS stat, {_t_p('(effect / se)', 'dof')} AS p FROM ols), within AS ({_q('ps', c + ', project')}),
w AS (SELECT *, se * se AS v FROM ols WHERE se > 0),
one AS (SELECT {t}, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sww, sum(effect / v) AS swy, sum(effect * effect / v) AS swyy FROM w GROUP BY {t} HAVING count(*) >= 2),
tau AS (SELECT *, greatest(0.0, (greatest(0.0, swyy - swy * swy / sw) - (k - 1)) / (sw - sww / sw)) AS tau2 FROM one),
two AS (SELECT {t}, k, sum(1 / (v + tau2)) AS s1, sum(effect / (v + tau2)) AS sy FROM w JOIN tau USING ({t}) GROUP BY {t}, k),
mz AS (SELECT {t}, k AS k_projects, sy / s1 AS meta_effect, sqrt(1 / s1) AS meta_se, sy / sqrt(s1) AS z, {_normal_p('(sy / sqrt(s1))')} AS p FROM two), meta AS ({_q('mz', c)}),
b1 AS (SELECT {t}, project, count(*) AS n, avg(CAST(y AS DOUBLE)) AS my, avg(v) AS mv, var_pop(v) * count(*) AS svv, var_pop(y) * count(*) AS syy, covar_pop(y, v) * count(*) AS syv FROM dense GROUP BY {t}, project),
b2 AS (SELECT *, coalesce(sum(syv) OVER b / nullif(sum(syy) OVER b, 0), 0) AS b FROM b1 WINDOW b AS (PARTITION BY {t})), b3 AS (SELECT *, mv - b * my AS a, greatest(0.0, svv - 2 * b * syv + b * b * syy) AS ss FROM b2),
b4 AS (SELECT *, sum(n * a) OVER b / sum(n) OVER b AS grand, sqrt(sum(ss) OVER b / sum(n) OVER b) AS sd FROM b3 WINDOW b AS (PARTITION BY {t})),
b5 AS (SELECT {t}, project, b, grand, sd, (a - grand) / sd AS gamma, ss / sd / sd / nullif(n - 1, 0) AS delta FROM b4),
adj AS (SELECT {t}, project, y, ((v - grand - b * y) / sd - gamma) / sqrt(CASE WHEN delta > 0 THEN delta ELSE 1 END) * sd + grand + b * y AS v FROM dense JOIN b5 USING ({t}, project)),
pm AS (SELECT {t}, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS e, var_pop(v) FILTER (WHERE y = 1) AS v1, var_pop(v) FILTER (WHERE y = 0) AS v0 FROM adj GROUP BY {t}),
pt AS (SELECT {t}, e, e / sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS stat, CAST(n1 + n0 - 2 AS DOUBLE) AS dof FROM pm), pp AS (SELECT {t}, e AS pooled_effect, {_t_p('stat', 'dof')} AS p FROM pt), pooled AS ({_q('pp', c)}),
conc AS (SELECT {t}, meta_effect, m.q AS meta_q, k_projects, p.pooled_effect, p.q AS pooled_q, CASE WHEN m.q < {ALPHA} AND p.q < {ALPHA} THEN 'replicated' WHEN p.q < {ALPHA} THEN 'pooling_only' WHEN m.q < {ALPHA} THEN 'within_only' ELSE 'neither' END AS concordance_class, coalesce(sign(meta_effect) = sign(p.pooled_effect), FALSE) AS sign_agree FROM meta m FULL JOIN pooled p USING ({t}))"""


def _dense_sql(rows):
    return f"dense AS (SELECT f.*, t.taxon, coalesce(clr, zero_clr) AS v, clr IS NOT NULL AS present FROM {rows} f JOIN zeros USING (sample) JOIN (SELECT DISTINCT taxon FROM counts) t ON TRUE LEFT JOIN clr ON clr.sample = f.sample AND clr.taxon = t.taxon)"


_BASE = f"{COUNTS}, {SAMPLES}, {FRAME}, {CLR}"
_ROUNDED = "round(meta_effect, 6) + 0.0 AS meta_effect, round(meta_q, 6) AS meta_q, CAST(k_projects AS DOUBLE) AS k_projects, round(pooled_effect, 6) + 0.0 AS pooled_effect, round(pooled_q, 6) AS pooled_q, concordance_class, sign_agree FROM conc"


def _parts(spark, d):
    counts = V.counts(spark, d)
    values, zeros, _ = C.clr(counts)
    return counts, values, zeros, V.frame(spark, d), counts.select("taxon").distinct()


def _concordance(out):
    return rounded(out["concordance"], "meta_effect", "meta_q", "pooled_effect", "pooled_q").withColumn("k_projects", F.col("k_projects").cast("double"))


@query(f"WITH {_BASE}, {_dense_sql('frame')}, {chain_sql()} SELECT disease_category, taxon, {_ROUNDED}")
def run_chain(spark, d):
    _, values, zeros, frame, _ = _parts(spark, d)
    return _concordance(A.run_chain(values, zeros, frame, eb=False, pooled_prevalence=0.0))


@query(f"""WITH {_BASE}, {_dense_sql('frame')}, {chain_sql()} SELECT disease_category, project, taxon, n_case, n_control, n_present, round(effect, 6) + 0.0 AS effect, round(se, 6) AS se, round(stat, 5) + 0.0 AS stat, dof, round(p, 6) AS p, round(q, 6) AS q FROM within""")
def within_project_tests(spark, d):
    _, values, zeros, frame, _ = _parts(spark, d)
    return rounded(D.within_project(values, zeros, frame), "effect", "se", "p", "q").withColumn("stat", F.round("stat", 5) + 0.0)


# Dense cells with an age that some contrasts use; those that miss it don't count there.
_COV = f"""{_BASE}, {FRAME_COV}, {_dense_sql('framec').replace('dense AS', 'dn AS').replace('coalesce(clr, zero_clr) AS v', 'round(coalesce(clr, zero_clr), 9) AS v')},
us AS (SELECT disease_category, project, min(filled) >= 0.8 AND max(high) > min(low) AS used FROM (SELECT disease_category, project, y, avg(CAST(age IS NOT NULL AS DOUBLE)) AS filled, max(age) AS high, min(age) AS low FROM framec JOIN zeros USING (sample) GROUP BY 1, 2, 3) GROUP BY 1, 2),
dense AS (SELECT dn.*, used, NOT used OR age IS NOT NULL AS ok, CASE WHEN used THEN age ELSE 0 END AS x FROM dn JOIN us USING (disease_category, project)),
pr AS (SELECT disease_category, project, taxon, count(*) FILTER (WHERE present) AS n_present, count(*) AS n_all, count(*) FILTER (WHERE y = 1 AND ok) AS n_case, count(*) FILTER (WHERE y = 0 AND ok) AS n_control, any_value(used) AS used FROM dense GROUP BY 1, 2, 3),
sm AS (SELECT disease_category, project, taxon, {partial_sql('x')} FROM dense WHERE ok GROUP BY 1, 2, 3),
ols AS (SELECT *, CAST(n_case + n_control - CASE WHEN used THEN 3 ELSE 2 END AS DOUBLE) AS dof, CASE WHEN used THEN {_EFFECT} ELSE syv / syy END AS effect, CASE WHEN used THEN {_RSS} * sxx / (syy * sxx - syx * syx) ELSE (svv - syv * syv / syy) / syy END AS sse
  FROM pr JOIN sm USING (disease_category, project, taxon) WHERE n_case >= 10 AND n_control >= 10 AND n_present >= CAST(0.1 AS DOUBLE) * n_all),
ot AS (SELECT *, sqrt(sse / dof) AS se, effect / sqrt(sse / dof) AS stat FROM ols), ps AS (SELECT *, {_t_p('stat', 'dof')} AS p FROM ot), within AS ({_q('ps', 'disease_category, project')}),
rk AS (SELECT disease_category, project, taxon, y, {_rank_sql('v', 'disease_category, project, taxon')} AS r, count(*) OVER (PARTITION BY disease_category, project, taxon, v) AS t FROM dense WHERE ok),
ru AS (SELECT disease_category, project, taxon, sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0 AS u, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM rk GROUP BY 1, 2, 3)"""


@query(f"""WITH {_COV} SELECT disease_category, project, taxon, n_case, n_control, n_present, round(effect, 6) + 0.0 AS effect, round(se, 6) AS se, round(stat, 5) + 0.0 AS stat, dof, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN used THEN 'age' ELSE '' END AS covariates,
round({rank_p_sql('u', 'n_case', 'n_control', 'ties')}, 6) AS wilcoxon_p, round(2 * u / (n_case * n_control) - 1, 6) + 0.0 AS rank_biserial FROM within JOIN ru USING (disease_category, project, taxon)""")
def within_project_adjusted(spark, d):
    _, values, zeros, _, _ = _parts(spark, d)
    nine = lambda df, c: df.withColumn(c, F.round(c, 9))
    out = D.within_project(nine(values, "clr"), nine(zeros, "zero_clr"), V.frame_with_covariates(spark, d), covariates=["age"], wilcoxon=True)
    return rounded(out, "effect", "se", "p", "q", "wilcoxon_p", "rank_biserial").withColumn("stat", F.round("stat", 5) + 0.0)


@query()
def run_chain_adjusted(spark, d):
    """The chain with two covariates and empirical Bayes: what SQL can't iterate."""
    _, values, zeros, _, _ = _parts(spark, d)
    return _concordance(A.run_chain(values, zeros, V.frame_with_covariates(spark, d), covariates=["age", "sex"]))


@query()
def mixed_adjusted(spark, d):
    _, values, zeros, _, _ = _parts(spark, d)
    rows = T.pooled_rows(V.frame_with_covariates(spark, d), zeros, ["age", "sex"])
    return D.bh_fdr(T.mixed_contrasts(values, rows, ["age", "sex"]), by=["disease_category"])


@query(f"""WITH {_META}, sg AS (SELECT disease_category, taxon, avg(CAST(sign(w.effect) = sign(m.pooled_effect) AS DOUBLE)) AS sign_consistency FROM w JOIN meta m USING (disease_category, taxon) GROUP BY 1, 2),
mp AS (SELECT *, {_normal_p('z')} AS p FROM meta JOIN sg USING (disease_category, taxon)), mq AS ({_q('mp', 'disease_category')})
SELECT disease_category, taxon, k_projects, round(pooled_effect, 6) + 0.0 AS pooled_effect, round(se, 6) AS se, round(pooled_effect - 1.96 * se, 6) + 0.0 AS ci_low, round(pooled_effect + 1.96 * se, 6) + 0.0 AS ci_high, round(z, 5) + 0.0 AS z,
  round(q_stat, 5) AS q_stat, round(i2, 4) AS i2, round(tau2, 6) AS tau2, n_case, n_control, round(sign_consistency, 6) AS sign_consistency, round(p, 6) AS p, round(q, 6) AS q FROM mq""")
def meta_with_fdr(spark, d):
    out = D.meta_analysis(_contrasts(spark, d))
    return rounded(out, "pooled_effect", "se", "ci_low", "ci_high", "tau2", "sign_consistency", "p", "q").withColumns({"z": F.round("z", 5) + 0.0, "q_stat": F.round("q_stat", 5), "i2": F.round("i2", 4)})


_DEPTH = f"t AS (SELECT sample, sum(n) AS depth FROM counts GROUP BY 1), fr AS (SELECT * EXCLUDE (depth) FROM (SELECT frame.*, depth, unnest({DEPTHS}) AS threshold FROM frame JOIN t USING (sample)) WHERE depth >= threshold)"


@query(f"WITH {_BASE}, {_DEPTH}, {_dense_sql('fr')}, {chain_sql('threshold')} SELECT threshold, disease_category, taxon, {_ROUNDED}")
def depth_sweep_chain(spark, d):
    counts, values, zeros, frame, _ = _parts(spark, d)
    frame = A.at_thresholds(frame, N.sample_depth(counts), DEPTHS)
    return _concordance(A.run_chain(values, zeros, frame, scenario=["threshold"], eb=False, pooled_prevalence=0.0))


_TIERS = "ti AS (SELECT tier, taxon FROM prevalence, (VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in TIERS) + ") AS v(tier) WHERE prevalence >= tier)"


@query(f"""WITH {_BASE}, {PREVALENCE}, {_TIERS}, dense AS (SELECT f.*, t.tier, t.taxon, coalesce(clr, zero_clr) AS v, clr IS NOT NULL AS present FROM frame f JOIN zeros USING (sample) JOIN ti t ON TRUE LEFT JOIN clr ON clr.sample = f.sample AND clr.taxon = t.taxon),
{chain_sql('tier')} SELECT tier, disease_category, taxon, {_ROUNDED}""")
def prevalence_sweep_chain(spark, d):
    counts, values, zeros, frame, _ = _parts(spark, d)
    tiers = A.in_tiers(N.prevalence(counts), TIERS)
    frames = frame.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    return _concordance(A.run_chain(values.join(tiers, "taxon"), zeros, frames, scenario=["tier"], eb=False, pooled_prevalence=0.0))


@query(f"""WITH {_BASE}, filled AS (SELECT *, total + (t - k) * CAST(0.5 AS DOUBLE) AS total2 FROM stats),
vals AS (SELECT sample, taxon, 'clr' AS transform, clr AS v FROM clr UNION ALL SELECT sample, taxon, 'log_relative', log10(n) - log10(total2) FROM counts JOIN filled USING (sample)),
z2 AS (SELECT sample, 'clr' AS transform, zero_clr AS zero FROM zeros UNION ALL SELECT sample, 'log_relative', log10(CAST(0.5 AS DOUBLE)) - log10(total2) FROM filled),
dense AS (SELECT f.*, z.transform, x.taxon, coalesce(w.v, zero) AS v, w.v IS NOT NULL AS present FROM frame f JOIN z2 z USING (sample) JOIN (SELECT DISTINCT taxon FROM counts) x ON TRUE LEFT JOIN vals w ON w.sample = f.sample AND w.taxon = x.taxon AND w.transform = z.transform), {chain_sql('transform')},
a AS (SELECT * FROM meta WHERE transform = 'clr'), b AS (SELECT * FROM meta WHERE transform = 'log_relative'),
j AS (SELECT disease_category, taxon, a.q < {ALPHA} AS ha, b.q < {ALPHA} AS hb, a.meta_effect AS ea, b.meta_effect AS eb FROM a FULL JOIN b USING (disease_category, taxon)),
r AS (SELECT disease_category, rank() OVER (PARTITION BY disease_category ORDER BY ea) AS ra, rank() OVER (PARTITION BY disease_category ORDER BY eb) AS rb FROM j WHERE ea IS NOT NULL AND eb IS NOT NULL),
rho AS (SELECT disease_category, round(corr(ra, rb), 6) + 0.0 AS effect_rho FROM r GROUP BY 1)
SELECT disease_category, count(*) AS n_taxa, count(*) FILTER (WHERE ha) AS hits_a, count(*) FILTER (WHERE hb) AS hits_b, count(*) FILTER (WHERE ha AND hb) AS hits_shared, any_value(effect_rho) AS effect_rho FROM j LEFT JOIN rho USING (disease_category) GROUP BY 1""")
def transform_sensitivity(spark, d):
    counts, values, zeros, frame, _ = _parts(spark, d)
    log_values, log_zeros = C.log_relative(counts)
    named = lambda df, name: df.withColumn("transform", F.lit(name))
    both = named(values.withColumnRenamed("clr", "v"), "clr").unionByName(named(log_values.withColumnRenamed("log_relative", "v"), "log_relative"))
    none = named(zeros.withColumnRenamed("zero_clr", "zero"), "clr").unionByName(named(log_zeros.withColumnRenamed("zero_log_relative", "zero"), "log_relative"))
    return rounded(A.transform_sensitivity(both, none, frame, "clr", "log_relative", ALPHA), "effect_rho")
