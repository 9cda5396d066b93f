"""Case/control contrasts per project, meta-analysis, batch correction, concordance.

Values come long: ``(sample, taxon, v)`` for present cells plus ``(sample, zero)`` for all
absent ones, as the transforms give them.  Moments over a contrast need no dense table:
absent cells of a sample all have its zero value, so sums over them are sums over
samples less sums over present cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_p, rank_test_p, t_p, t_two_sided
from ..functions.text import recode
from ..sources.sinks import cut


def analysis_frame(df: DataFrame, grouping: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, disease_category) with y: cases under their (grouped) category,
    controls under every category that has a case in their project."""
    category = recode(F.col("disease_category"), grouping or {})
    cases = df.filter("disease_label = 'case'").select("sample", "project", category.alias("disease_category"), F.lit(1).alias("y"), *keep)
    present = cases.filter("disease_category IS NOT NULL").select("project", "disease_category").distinct()
    controls = df.filter("disease_label = 'healthy'").select("sample", "project", F.lit(0).alias("y"), *keep).join(present, "project")
    return cases.unionByName(controls)


def category_counts(frame: DataFrame, min_cases: int = 10, min_controls: int = 10) -> DataFrame:
    return frame.filter("disease_category IS NOT NULL AND project IS NOT NULL").groupBy("disease_category", "project").agg(F.count_if(F.expr("y = 1")).alias("n_case"), F.count_if(F.expr("y = 0")).alias("n_control")).withColumn("ok", (F.col("n_case") >= min_cases) & (F.col("n_control") >= min_controls))


def eligible_categories(frame: DataFrame, min_projects: int = 2, min_cases: int = 100, floors: tuple[int, int] = (10, 10)) -> DataFrame:
    """Categories with enough projects over both floors and enough cases in them."""
    per = category_counts(frame, *floors).filter("ok").groupBy("disease_category").agg(F.count_distinct("project").alias("n_projects"), F.sum("n_case").alias("n_case"), F.sum("n_control").alias("n_control"))
    return per.filter((F.col("n_projects") >= min_projects) & (F.col("n_case") >= min_cases)).orderBy(F.desc("n_case"), "disease_category")


def pick_covariates(frame: DataFrame, candidates: Sequence[str], min_coverage: float = 0.8) -> DataFrame:
    """Per contrast, candidates filled for enough of both arms that also vary."""
    long = frame.select("disease_category", "project", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("v")) for c in candidates))).alias("e")).select("disease_category", "project", "y", "e.*")
    arms = long.groupBy("disease_category", "project", "covariate", "y").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("filled"))
    varies = long.groupBy("disease_category", "project", "covariate").agg((F.count_distinct("v") > 1).alias("varies"))
    return arms.groupBy("disease_category", "project", "covariate").agg(F.min("filled").alias("min_filled")).join(varies, ["disease_category", "project", "covariate"]).withColumn("used", (F.col("min_filled") >= min_coverage) & F.col("varies"))


def bh_fdr(df: DataFrame, p: str = "p", by: Sequence[str] = (), q: str = "q") -> DataFrame:
    """Benjamini-Hochberg within blocks; null p has null q and doesn't count."""
    block = Window.partitionBy(*by)
    ranked = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p)
    raw = F.col(p) * F.count(p).over(block) / F.row_number().over(ranked)
    down = Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__r", F.row_number().over(ranked)).withColumn("__raw", raw).withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__r", "__raw")


_KEY = ["disease_category", "project", "taxon"]


def contrast_moments(values: DataFrame, zeros: DataFrame, frame: DataFrame, min_prevalence: float = 0.10, scenario: Sequence[str] = (), min_arm: int = 1) -> DataFrame:
    """Per (scenario, category, project, taxon) and arm: n, mean and variance of the value,
    for taxa present in at least ``min_prevalence`` of the contrast's samples.

    Scenario columns may be in any of the three tables: in the frame (depth), in both
    tables of values (transforms), or in the frame and the values (tiers of taxa)."""
    block = [*scenario, "disease_category", "project"]
    known = lambda df, *others: ["sample", *(c for c in scenario if c in df.columns and all(c in o.columns for o in others))]
    zero = [c for c in zeros.columns if c not in known(zeros)]
    rows = frame.join(zeros.withColumnRenamed(zero[0], "zero"), known(zeros, frame))
    arms = rows.groupBy(*block).agg(*(F.count_if(F.col("y") == a).alias(f"n{a}") for a in (0, 1)), *(F.sum(F.when(F.col("y") == a, F.col("zero"))).alias(f"z{a}") for a in (0, 1)), *(F.sum(F.when(F.col("y") == a, F.col("zero") * F.col("zero"))).alias(f"zz{a}") for a in (0, 1)))
    arms = arms.filter((F.col("n0") >= min_arm) & (F.col("n1") >= min_arm))
    value = [c for c in values.columns if c not in (*known(values), "taxon")]
    met = rows.join(values.withColumnRenamed(value[0], "v"), known(values, rows))
    sums = []
    for a in (0, 1):
        mine = F.col("y") == a
        sums += [F.sum(F.when(mine, F.col("v") - F.col("zero")).otherwise(0.0)).alias(f"d{a}"), F.sum(F.when(mine, F.col("v") * F.col("v") - F.col("zero") * F.col("zero")).otherwise(0.0)).alias(f"dd{a}")]
    cells = met.groupBy(*block, "taxon").agg(F.count(F.lit(1)).alias("n_present"), *sums)
    out = cells.join(arms, block).filter(F.col("n_present") >= F.lit(min_prevalence) * (F.col("n0") + F.col("n1")))
    for a in (0, 1):
        n, s, ss = F.col(f"n{a}"), F.coalesce(f"z{a}", F.lit(0.0)) + F.col(f"d{a}"), F.coalesce(f"zz{a}", F.lit(0.0)) + F.col(f"dd{a}")
        out = out.withColumn(f"m{a}", s / F.nullif(n, F.lit(0))).withColumn(f"ssd{a}", F.greatest(F.lit(0.0), ss - s * s / F.nullif(n, F.lit(0))))
    return out.select(*block, "taxon", F.col("n1").alias("n_case"), F.col("n0").alias("n_control"), "n_present", "m1", "m0", "ssd1", "ssd0")


def ols_contrasts(moments: DataFrame) -> DataFrame:
    """Two-group least squares: effect, standard error, t and degrees of freedom; all null
    where nothing varies or no degree of freedom is left."""
    dof = F.col("n_case") + F.col("n_control") - 2
    s2 = (F.col("ssd1") + F.col("ssd0")) / F.nullif(dof, F.lit(0))
    se = F.sqrt(s2 * (1.0 / F.col("n_case") + 1.0 / F.col("n_control")))
    good = (dof > 0) & (F.col("n_case") > 0) & (F.col("n_control") > 0) & (s2 > 1e-18)
    effect = F.col("m1") - F.col("m0")
    rest = [c for c in moments.columns if c not in ("m1", "m0", "ssd1", "ssd0")]
    return moments.withColumn("__se", F.when(good, se)).select(*rest, F.when(F.col("__se").isNotNull(), effect).alias("effect"), F.col("__se").alias("se"), (effect / F.col("__se")).alias("stat"), dof.cast("double").alias("dof"))


def ols_with_covariates(cells: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Least squares of value on y and covariates per (category, project, taxon) of dense
    ``cells (.., y, v, covariates)``; covariates are standardised (population deviation),
    rows with a null go.  One group is one contrast of one taxon."""

    def fit(key, pdf):
        pdf = pdf.dropna(subset=["y", "v", *covariates]).sort_values("sample")
        x = [np.ones(len(pdf)), pdf["y"].to_numpy(float)]
        for c in covariates:
            v = pdf[c].to_numpy(float)
            sd = v.std()
            x.append((v - v.mean()) / (sd if sd > 0 else 1.0))
        x, v = np.column_stack(x), pdf["v"].to_numpy(float)
        out = dict(zip(_KEY, key, strict=True)) | {"n_case": int((pdf["y"] == 1).sum()), "n_control": int((pdf["y"] == 0).sum()), "effect": None, "se": None, "stat": None, "dof": None, "p": None}
        rank = np.linalg.matrix_rank(x) if len(pdf) else 0
        dof = len(pdf) - rank
        if dof > 0 and 0 < x[:, 1].sum() < len(pdf):
            inv = np.linalg.pinv(x.T @ x)
            beta = inv @ (x.T @ v)
            s2 = float(((v - x @ beta) ** 2).sum()) / dof
            if s2 > 1e-18:
                se = float(np.sqrt(s2 * inv[1, 1]))
                t = float(beta[1] / se)
                out |= {"effect": float(beta[1]), "se": se, "stat": t, "dof": float(dof), "p": float(t_two_sided(np.array([t]), np.array([dof]))[0])}
        return pd.DataFrame([out])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in _KEY) + ", n_case bigint, n_control bigint, effect double, se double, stat double, dof double, p double"
    return cells.groupBy(*_KEY).applyInPandas(fit, schema)


def rank_sums(cells: DataFrame, by: Sequence[str] = ("disease_category", "project", "taxon")) -> DataFrame:
    """Mann-Whitney U of the case arm, rank-biserial correlation and tie term per group of
    dense ``cells (.., y, v)``; null with under 3 in an arm or nothing that varies."""
    by = list(by)
    tied = Window.partitionBy(*by, "v")
    ranked = cells.withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy("v")) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0)).withColumn("t", F.count(F.lit(1)).over(tied))
    per = ranked.groupBy(*by).agg(F.count_if(F.expr("y = 1")).alias("n_case"), F.count_if(F.expr("y = 0")).alias("n_control"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("r1"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"), (F.min("v") < F.max("v")).alias("varies"))
    good = (F.col("n_case") >= 3) & (F.col("n_control") >= 3) & F.col("varies")
    u = F.when(good, F.col("r1") - F.col("n_case") * (F.col("n_case") + 1) / 2.0)
    return per.select(*by, "n_case", "n_control", u.alias("u"), (2.0 * u / (F.col("n_case") * F.col("n_control")) - 1.0).alias("rank_biserial"), "ties")


def with_rank_p(df: DataFrame) -> DataFrame:
    return df.withColumn("wilcoxon_p", rank_test_p(F.col("u"), F.col("n_case").cast("double"), F.col("n_control").cast("double"), F.col("ties")))


def within_project(values: DataFrame, zeros: DataFrame, frame: DataFrame, min_prevalence: float = 0.10, floors: tuple[int, int] = (10, 10), scenario: Sequence[str] = (), covariates: Sequence[str] = (), min_coverage: float = 0.8, wilcoxon: bool = False) -> DataFrame:
    """Every contrast over both floors: OLS, p, and q within the contrast.  With ``covariates``
    (columns of the frame) each contrast is adjusted for those that its samples fill and
    that vary there; samples that miss one go, and the floors must hold without them too.
    With ``wilcoxon`` the rank test's p and rank-biserial correlation stand beside."""
    block = [*scenario, "disease_category", "project"]
    if covariates or wilcoxon:
        from .gram import contrast_rows, covariate_contrasts
        from .rankmerge import sparse_rank_sums

        rows = contrast_rows(frame, zeros, covariates, scenario, floors, min_coverage)
        done = covariate_contrasts(values, rows, covariates, scenario, min_prevalence)
        if wilcoxon:
            ranks = with_rank_p(sparse_rank_sums(values, rows, scenario)).select(*block, "taxon", "wilcoxon_p", "rank_biserial")
            done = done.join(ranks, [*block, "taxon"], "left")
    else:
        m = contrast_moments(values, zeros, frame, min_prevalence, scenario)
        done = ols_contrasts(m.filter((F.col("n_case") >= floors[0]) & (F.col("n_control") >= floors[1])))
    return bh_fdr(done.withColumn("p", t_p("stat", "dof")), by=block)


def meta_analysis(per_project: DataFrame, min_projects: int = 2, scenario: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """DerSimonian-Laird random effects per (scenario, category, taxon); q per category."""
    by = [*scenario, "disease_category", "taxon"]
    # Both passes are windows over the same key, so everything is one shuffle.
    over = Window.partitionBy(*by)
    total = lambda c: F.sum(c).over(over)
    fit = per_project.filter("effect IS NOT NULL AND se > 0").withColumn("v", F.col("se") * F.col("se")).withColumn("w", 1.0 / F.col("v"))
    one = fit.withColumns({"k": F.count(F.lit(1)).over(over), "sw": total(F.col("w")), "sww": total(F.col("w") * F.col("w")), "swy": total(F.col("w") * F.col("effect")), "swyy": total(F.col("w") * F.col("effect") * F.col("effect"))})
    one = one.filter(F.col("k") >= min_projects).withColumn("qs", F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")))
    excess = F.col("qs") - (F.col("k") - 1)
    one = one.withColumn("t2", F.coalesce(F.greatest(F.lit(0.0), excess / F.nullif(F.col("sw") - F.col("sww") / F.col("sw"), F.lit(0.0))), F.lit(0.0))).withColumn("w2", 1.0 / (F.col("v") + F.col("t2")))
    two = one.withColumns({"s": total(F.col("w2")), "sy": total(F.col("w2") * F.col("effect"))})
    # Share of projects whose effect has the pooled effect's sign.
    agrees = (F.signum("effect") == F.signum("sy")).cast("double")
    same = {c: F.max(c).alias(c) for c in ("k", "qs", "t2", "s", "sy")}
    got = two.groupBy(*by).agg(*same.values(), F.sum("n_case").alias("n_case"), F.sum("n_control").alias("n_control"), F.avg(agrees).alias("sign_consistency"))
    mu, se = F.col("sy") / F.col("s"), F.sqrt(1.0 / F.col("s"))
    i2 = F.when(F.col("qs") > 0, F.greatest(F.lit(0.0), (F.col("qs") - (F.col("k") - 1)) / F.nullif(F.col("qs"), F.lit(0.0))) * 100.0).otherwise(0.0)
    out = got.select(*by, F.col("k").alias("k_projects"), mu.alias("pooled_effect"), se.alias("se"), (mu - 1.96 * se).alias("ci_low"), (mu + 1.96 * se).alias("ci_high"), (mu / se).alias("z"), F.col("qs").alias("q_stat"), i2.alias("i2"), F.col("t2").alias("tau2"), "n_case", "n_control", "sign_consistency")
    return bh_fdr(out.withColumn("p", normal_p("z")), by=[*scenario, "disease_category"]) if with_p else out


def combat(cells: DataFrame, by: Sequence[str] = ("disease_category",), eb: bool = True, iterations: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """ComBat on dense ``cells (.., sample, project, y, taxon, v)``: location and scale of
    each batch (project) are removed, the case effect is kept.  Adds ``adjusted``.

    The model value = batch mean + y effect per taxon has a closed form: y's effect is
    the pooled within-batch slope.  Everything it needs is one set of central moments per
    (taxon, batch), combined on the map side: cells are never sorted or put through a
    window.  The empirical-Bayes step takes one batch's row of taxa, not its samples."""
    by = list(by)
    batch = [*by, "taxon", "project"]
    y = F.col("y").cast("double")
    n = F.count(F.lit(1))
    per = cells.groupBy(*batch).agg(n.alias("n"), F.avg(y).alias("my"), F.avg("v").alias("mv"), (F.var_pop(y) * n).alias("syy"), (F.var_pop("v") * n).alias("svv"), (F.covar_pop(y, F.col("v")) * n).alias("syv"))
    # Batches of a taxon: few and small rows.
    wc = Window.partitionBy(*by, "taxon")
    per = per.withColumn("__b", F.coalesce(F.sum("syv").over(wc) / F.nullif(F.sum("syy").over(wc), F.lit(0.0)), F.lit(0.0)))
    per = per.withColumn("__a", F.col("mv") - F.col("__b") * F.col("my")).withColumn("__ss", F.greatest(F.lit(0.0), F.col("svv") - 2 * F.col("__b") * F.col("syv") + F.col("__b") * F.col("__b") * F.col("syy")))
    # Batch intercepts average to the grand one, weighted by batch size.
    size = F.sum("n").over(wc)
    per = per.withColumns({"__grand": F.sum(F.col("n") * F.col("__a")).over(wc) / size, "__sd": F.sqrt(F.sum("__ss").over(wc) / size)})
    scale = F.nullif(F.col("__sd"), F.lit(0.0))
    per = per.withColumns({"gamma_hat": F.coalesce((F.col("__a") - F.col("__grand")) / scale, F.lit(0.0)), "szz": F.coalesce(F.col("__ss") / (scale * scale), F.lit(0.0))})
    summary = per.select(*batch, "n", "__b", "__grand", "__sd", "gamma_hat", (F.col("szz") / F.nullif(F.col("n") - 1, F.lit(0))).alias("delta_hat"), (F.col("n") * F.col("gamma_hat")).alias("sz"), (F.col("szz") + F.col("n") * F.col("gamma_hat") * F.col("gamma_hat")).alias("szz"))
    model = [*batch, "__b", "__grand", "__sd"]
    if eb:

        def shrink(key, pdf):
            pdf = pdf.sort_values("taxon")
            g, d = pdf["gamma_hat"].to_numpy(float), pdf["delta_hat"].to_numpy(float)
            n, sz, szz = (pdf[c].to_numpy(float) for c in ("n", "sz", "szz"))
            d = np.where(np.isnan(d) | (d <= 0), 1.0, d)  # one sample, or constant: no scale of its own
            g_bar, t2 = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
            m, s2 = d.mean(), d.var(ddof=1) if len(d) > 1 else 0.0
            g_new, d_new = g.copy(), d.copy()
            if t2 > 0 and s2 > 0:
                lam, theta = (m * m + 2 * s2) / s2, (m**3 + m * s2) / s2
                for _ in range(iterations):
                    g_next = (n * t2 * g + d_new * g_bar) / (n * t2 + d_new)
                    spread = szz - 2 * g_next * sz + n * g_next * g_next
                    d_next = (0.5 * spread + theta) / (n / 2 + lam - 1)
                    change = max(np.max(np.abs(g_next - g_new) / np.maximum(np.abs(g_new), 1e-12)), np.max(np.abs(d_next - d_new) / d_new))
                    g_new, d_new = g_next, d_next
                    if change < tolerance:
                        break
            return pd.DataFrame({**{c: pdf[c] for c in model}, "gamma": g_new, "delta": d_new})

        kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
        found = summary.groupBy(*by, "project").applyInPandas(shrink, ", ".join(f"{c} {kinds[c]}" for c in batch) + ", __b double, __grand double, __sd double, gamma double, delta double")
    else:
        found = summary.select(*model, F.col("gamma_hat").alias("gamma"), F.when(F.col("delta_hat") > 0, F.col("delta_hat")).otherwise(1.0).alias("delta"))
    # Written, so that its size is known: a row a taxon and batch, which as a rule goes to the cells and not they to it.
    found = cut(found, "combat-model")
    fitted = F.col("__grand") + F.col("__b") * y
    z = F.coalesce((F.col("v") - fitted) / F.nullif(F.col("__sd"), F.lit(0.0)), F.lit(0.0))
    return cells.join(found, batch).withColumn("adjusted", (z - F.col("gamma")) / F.sqrt("delta") * F.col("__sd") + fitted).select(*cells.columns, "adjusted")


def pooled_ols(cells: DataFrame, value: str = "adjusted", by: Sequence[str] = ("disease_category",), with_p: bool = True) -> DataFrame:
    """Two-group least squares over all projects together; q within the group."""
    key = [*by, "taxon"]
    sums = cells.groupBy(*key).agg(
        F.count_if(F.expr("y = 1")).alias("n_case"), F.count_if(F.expr("y = 0")).alias("n_control"), F.count_distinct("project").alias("k_projects"),
        *(F.avg(F.when(F.col("y") == a, F.col(value))).alias(f"m{a}") for a in (0, 1)), *(F.coalesce(F.var_pop(F.when(F.col("y") == a, F.col(value))) * F.count_if(F.col("y") == a), F.lit(0.0)).alias(f"ssd{a}") for a in (0, 1)),
    )
    out = ols_contrasts(sums)
    return bh_fdr(out.withColumn("p", t_p("stat", "dof")), by=list(by)) if with_p else out


def mixed_model(cells: DataFrame, by: Sequence[str] = ("disease_category",), value: str = "v") -> DataFrame:
    """Random project intercept, fixed case effect, by REML, per taxon.  A group is the
    sums of each project (a handful of numbers), never its samples: the likelihood in
    the variance ratio needs no more."""
    key = [*by, "taxon"]
    y, v = F.col("y").cast("double"), F.col(value)
    sums = cells.groupBy(*key, "project").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(v).alias("sv"), F.sum(y * y).alias("syy"), F.sum(y * v).alias("syv"), F.sum(v * v).alias("svv"))

    def fit(group, pdf):
        pdf = pdf.sort_values("project")
        n, sy, sv, syy, syv, svv = (pdf[c].to_numpy(float) for c in ("n", "sy", "sv", "syy", "syv", "svv"))
        total = n.sum()
        out = dict(zip(key, group, strict=True)) | {"n_case": int(sy.sum()), "n_control": int(total - sy.sum()), "k_projects": len(pdf), "effect": None, "se": None, "p": None, "converged": False}
        if not 0 < sy.sum() < total or total < 4:
            return pd.DataFrame([out])

        def solve(log_ratio):
            shrink = np.exp(log_ratio) / (1 + n * np.exp(log_ratio))
            a = np.array([[total - (shrink * n * n).sum(), sy.sum() - (shrink * n * sy).sum()], [0, syy.sum() - (shrink * sy * sy).sum()]])
            a[1, 0] = a[0, 1]
            b = np.array([sv.sum() - (shrink * n * sv).sum(), syv.sum() - (shrink * sy * sv).sum()])
            c = svv.sum() - (shrink * sv * sv).sum()
            beta = np.linalg.solve(a, b)
            s2 = max((c - b @ beta) / (total - 2), 1e-300)
            return beta, s2, a, (total - 2) * np.log(s2) + np.log1p(n * np.exp(log_ratio)).sum() + np.linalg.slogdet(a)[1]

        try:
            lo, hi, gold = -14.0, 8.0, (5**0.5 - 1) / 2
            grid = np.linspace(lo, hi, 45)
            best = int(np.argmin([solve(g)[3] for g in grid]))
            lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
            for _ in range(60):
                p, q = hi - gold * (hi - lo), lo + gold * (hi - lo)
                lo, hi = (lo, q) if solve(p)[3] < solve(q)[3] else (p, hi)
            beta, s2, a, _ = solve((lo + hi) / 2)
            se = float(np.sqrt(s2 * np.linalg.inv(a)[1, 1]))
            import math

            out |= {"effect": float(beta[1]), "se": se, "p": math.erfc(abs(beta[1] / se) / math.sqrt(2)) if se > 0 else None, "converged": bool(0 < best < len(grid) - 1 or best == 0)}
        except np.linalg.LinAlgError:
            pass
        return pd.DataFrame([out])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return sums.groupBy(*key).applyInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in key) + ", n_case bigint, n_control bigint, k_projects bigint, effect double, se double, p double, converged boolean")


def concordance(meta: DataFrame, pooled: DataFrame, alpha: float = 0.05, scenario: Sequence[str] = ()) -> DataFrame:
    """Full outer join of both arms with one of four classes and sign agreement."""
    key = [*scenario, "disease_category", "taxon"]
    both = meta.select(*key, F.col("pooled_effect").alias("meta_effect"), F.col("q").alias("meta_q"), "k_projects").join(pooled.select(*key, F.col("effect").alias("pooled_effect"), F.col("q").alias("pooled_q")), key, "full_outer")
    m, p = F.coalesce(F.col("meta_q") < alpha, F.lit(False)), F.coalesce(F.col("pooled_q") < alpha, F.lit(False))
    kind = F.when(m & p, "replicated").when(p, "pooling_only").when(m, "within_only").otherwise("neither")
    return both.withColumn("concordance_class", kind).withColumn("sign_agree", F.coalesce(F.signum("meta_effect") == F.signum("pooled_effect"), F.lit(False)))


def concordance_summary(table: DataFrame, scenario: Sequence[str] = ()) -> DataFrame:
    """Counts by class, rank correlation of the effects (over 2 taxa) and sign agreement
    among taxa tested in both."""
    by = [*scenario, "disease_category"]
    tested = F.col("meta_effect").isNotNull() & F.col("pooled_effect").isNotNull()
    counts = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n_taxa"), F.count_if(tested).alias("n_tested_both"), *(F.count_if(F.col("concordance_class") == c).alias(f"n_{c}") for c in ("replicated", "pooling_only", "within_only")), F.avg(F.when(tested, F.col("sign_agree").cast("double"))).alias("sign_agreement"))
    from .diversity import average_rank

    ranked = table.filter(tested).select(*by, average_rank("meta_effect", by).alias("ra"), average_rank("pooled_effect", by).alias("rb"))
    rho = ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 2, F.corr("ra", "rb")).alias("spearman_effect"))
    return counts.join(rho, by, "left")
