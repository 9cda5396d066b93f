"""Batch correction and pooled tests with covariates, from per-batch sums.

ComBat on ``mod = [y, covariates]`` and the mixed model need of each (taxon, project) its design's
``x'x``, ``x'v`` and ``v'v`` and nothing else.  The samples' zero values give these once per project;
a taxon corrects them over its present cells.  The projects' intercepts are eliminated by
centring the sums (Frisch and Waugh), so the model has as many unknowns as covariates.  What
ComBat makes of a value is linear in the value and the design within a (taxon, project), so the
sums of adjusted values follow from the sums of values, and the pooled test is taken without
making an adjusted cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_p, t_p
from .gram import _cells, contrast_design


def pooled_rows(frame: DataFrame, zeros: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), min_coverage: float = 0.8) -> DataFrame:
    """A category's cases and controls of all projects that have values, with the design."""
    known = ["sample", *(c for c in scenario if c in zeros.columns and c in frame.columns)]
    name = next(c for c in zeros.columns if c not in ("sample", *scenario))
    return contrast_design(frame.join(zeros.withColumnRenamed(name, "zero"), known), covariates, [*scenario, "disease_category"], min_coverage)


def batch_sums(values: DataFrame, rows: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), min_prevalence: float = 0.10) -> DataFrame:
    """``(.., taxon, project, n, xx, xv, vv, covariates)`` for taxa present in ``min_prevalence`` of the
    category's samples; ``xx`` by rows.  A row for every project, those without the taxon too."""
    by, p = [*scenario, "disease_category"], 2 + len(covariates)
    whole = rows.filter("complete")
    x = [F.col(f"x{k}") for k in range(p)]
    batches = whole.groupBy(*by, "project", "covariates").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*(F.sum(x[min(i, j)] * x[max(i, j)]) for i in range(p) for j in range(p))).alias("xx"),
        F.array(*(F.sum(c * F.col("zero")) for c in x)).alias("zx"), F.sum(F.col("zero") * F.col("zero")).alias("zz"),
    )
    inside = lambda c: F.sum(F.when(F.col("complete"), c).otherwise(0.0))
    cells = _cells(rows, values, scenario).groupBy(*by, "taxon", "project").agg(F.count(F.lit(1)).alias("present"), F.array(*(inside(c * (F.col("v") - F.col("zero"))) for c in x)).alias("dx"), inside(F.col("v") * F.col("v") - F.col("zero") * F.col("zero")).alias("dd"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    kept = cells.groupBy(*by, "taxon").agg(F.sum("present").alias("present")).join(sizes, by).filter(F.col("present") >= F.lit(min_prevalence) * F.col("__all")).select(*by, "taxon")
    grid = kept.join(batches, by).join(cells.drop("present"), [*by, "taxon", "project"], "left")
    xv = F.when(F.col("dx").isNull(), F.col("zx")).otherwise(F.zip_with("zx", "dx", lambda a, b: a + b))
    return grid.select(*by, "taxon", "project", "n", "xx", xv.alias("xv"), (F.col("zz") + F.coalesce("dd", F.lit(0.0))).alias("vv"), "covariates")


class Sums:
    """A taxon's sums by project, as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.n = pdf["n"].to_numpy(float)
        self.xv = np.array(pdf["xv"].tolist(), float)
        p = self.xv.shape[1]
        self.xx = np.array(pdf["xx"].tolist(), float).reshape(-1, p, p)
        self.vv = pdf["vv"].to_numpy(float)

    def slopes(self) -> np.ndarray:
        """Effects of y and the covariates within projects; unused covariates have 0."""
        sx, sv = self.xx[:, 0, :], self.xv[:, 0]
        inner = (self.xx - sx[:, :, None] * sx[:, None, :] / self.n[:, None, None]).sum(axis=0)[1:, 1:]
        cross = (self.xv - sx * (sv / self.n)[:, None]).sum(axis=0)[1:]
        scale = np.sqrt(np.where(np.diag(inner) > 1e-9, np.diag(inner), 1.0))
        return np.append(0.0, np.linalg.pinv(inner / np.outer(scale, scale), rcond=1e-9, hermitian=True) @ (cross / scale) / scale)

    def standard(self) -> dict:
        """ComBat's standardisation: slopes, grand mean, deviation, and each project's mean and
        variance of standardised values."""
        b = self.slopes()
        mean_x, mean_v = self.xx[:, 0, :] / self.n[:, None], self.xv[:, 0] / self.n
        level = mean_v - mean_x @ b
        grand = (self.n * level).sum() / self.n.sum()
        within = self.vv - self.n * mean_v**2 - 2 * (self.xv @ b - self.n * mean_v * (mean_x @ b)) + np.einsum("i,kij,j->k", b, self.xx, b) - self.n * (mean_x @ b) ** 2
        within = np.maximum(within, 0.0)
        sd = math.sqrt(max(within.sum() / self.n.sum(), 1e-8))
        with np.errstate(divide="ignore", invalid="ignore"):
            delta = np.where(self.n > 1, np.maximum(within / (self.n - 1) / sd**2, 1e-8), 1.0)
        return {"b": b, "grand": grand, "sd": sd, "gamma": (level - grand) / sd, "delta": delta}

    def adjusted(self, fit: dict, gamma: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, float]:
        """``x'a`` and ``a'a`` of the adjusted values: ``a = r v + (1 - r) m + c`` with the model's ``m``."""
        b, grand, r = fit["b"], fit["grand"], 1 / np.sqrt(delta)
        c, sx, sv = -gamma * fit["sd"] * r, self.xx[:, 0, :], self.xv[:, 0]
        xm = grand * sx + self.xx @ b
        xa = r[:, None] * self.xv + (1 - r)[:, None] * xm + c[:, None] * sx
        sm = grand * self.n + sx @ b
        mm = grand**2 * self.n + 2 * grand * (sx @ b) + np.einsum("i,kij,j->k", b, self.xx, b)
        vm = grand * sv + self.xv @ b
        aa = r**2 * self.vv + (1 - r) ** 2 * mm + 2 * r * (1 - r) * vm + self.n * c**2 + 2 * c * (r * sv + (1 - r) * sm)
        return xa.sum(axis=0), float(aa.sum())

    def contrast(self, xv: np.ndarray, vv: float) -> dict:
        """Least squares over all projects together."""
        g, n = self.xx.sum(axis=0), self.n.sum()
        out = {"effect": None, "se": None, "stat": None, "dof": None}
        used = np.diag(g) > 1e-9
        scale = np.sqrt(np.where(used, np.diag(g), 1.0))
        s = g / np.outer(scale, scale)
        others = [k for k in range(len(g)) if k != 1]
        rank = int(np.linalg.matrix_rank(s, tol=1e-9, hermitian=True))
        if rank == np.linalg.matrix_rank(s[np.ix_(others, others)], tol=1e-9, hermitian=True) or n <= rank:
            return out
        inv = np.linalg.pinv(s, rcond=1e-9, hermitian=True) / np.outer(scale, scale)
        beta = inv @ xv
        s2 = (vv - beta @ xv) / (n - rank)
        if s2 > 1e-12 * max(vv / n, 1e-6):
            se = math.sqrt(s2 * inv[1, 1])
            out |= {"effect": float(beta[1]), "se": se, "stat": float(beta[1] / se), "dof": float(n - rank)}
        return out

    def reml(self) -> dict:
        """Random project intercept by REML: the likelihood in the variance ratio, whose only
        data are the sums."""
        out = {"effect": None, "se": None, "converged": False}
        used = np.flatnonzero(np.diag(self.xx.sum(axis=0)) > 1e-9)
        xx, xv, n = self.xx[:, used][:, :, used], self.xv[:, used], self.n
        total, p = n.sum(), len(used)
        if 1 not in used or not 0 < xx[:, 0, 1].sum() < total or total <= p + 1:
            return out
        sx, sv = xx[:, 0, :], xv[:, 0]

        def solve(log_ratio: float):
            k = math.exp(log_ratio) / (1 + n * math.exp(log_ratio))
            a = (xx - k[:, None, None] * sx[:, :, None] * sx[:, None, :]).sum(axis=0)
            b = (xv - (k * sv)[:, None] * sx).sum(axis=0)
            beta = np.linalg.solve(a, b)
            s2 = max(((self.vv - k * sv**2).sum() - b @ beta) / (total - p), 1e-300)
            return beta, s2, a, (total - p) * math.log(s2) + np.log1p(n * math.exp(log_ratio)).sum() + np.linalg.slogdet(a)[1]

        try:
            grid, gold = np.linspace(-14.0, 8.0, 45), (5**0.5 - 1) / 2
            best = int(np.argmin([solve(g)[3] for g in grid]))
            lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
            for _ in range(60):
                u, w = hi - gold * (hi - lo), lo + gold * (hi - lo)
                lo, hi = (lo, w) if solve(u)[3] < solve(w)[3] else (u, hi)
            beta, s2, a, _ = solve((lo + hi) / 2)
            at = int(np.flatnonzero(used == 1)[0])
            return {"effect": float(beta[at]), "se": float(math.sqrt(s2 * np.linalg.inv(a)[at, at])), "converged": best < len(grid) - 1}
        except np.linalg.LinAlgError:
            return out


def shrunk(gamma: np.ndarray, delta: np.ndarray, n: np.ndarray, iterations: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Empirical-Bayes location and scale of one project over all its taxa."""
    t2, s2 = (gamma.var(ddof=1), delta.var(ddof=1)) if len(gamma) > 1 else (0.0, 0.0)
    if not (t2 > 0 and s2 > 0):
        return gamma, delta
    mean, m = gamma.mean(), delta.mean()
    lam, theta = (m * m + 2 * s2) / s2, (m**3 + m * s2) / s2
    around = (n - 1) * delta  # of standardised values around their mean
    g, d = gamma, delta
    for _ in range(iterations):
        g_new = (n * t2 * gamma + d * mean) / (n * t2 + d)
        d_new = (0.5 * (around + n * (gamma - g_new) ** 2) + theta) / (0.5 * n + lam - 1)
        done = max(np.max(np.abs(g_new - g) / (np.abs(g) + 1e-8)), np.max(np.abs(d_new - d) / (np.abs(d) + 1e-8))) < tolerance
        g, d = g_new, d_new
        if done:
            break
    return g, d


def _by_taxon(df: DataFrame, by: Sequence[str], parts: int, fit, spec: str) -> DataFrame:
    """``fit(rows of one taxon)`` -> rows, over groups of taxa dealt by hash."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    key = [*by, "taxon"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [r | dict(zip(key, k if isinstance(k, tuple) else (k,), strict=True)) for k, own in pdf.groupby(key, sort=True, dropna=False) for r in fit(own.sort_values("project"))]
        return pd.DataFrame(out, columns=[*key, *(c.split()[0] for c in spec.split(", "))])

    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    return dealt.groupBy("__part").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", " + spec)


def combat_contrasts(values: DataFrame, rows: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), min_prevalence: float = 0.10, eb: bool = True, parts: int = 256) -> DataFrame:
    """The pooled test on values that ComBat has adjusted by project, protecting y and the
    covariates: ``effect, se, stat, dof, p, ci_low, ci_high`` per (category, taxon)."""
    by = [*scenario, "disease_category"]
    sums = batch_sums(values, rows, covariates, scenario, min_prevalence)
    base = "project string, n double, xx array<double>, xv array<double>, vv double, covariates string"

    def standard(own: pd.DataFrame) -> list[dict]:
        fit = Sums(own).standard()
        return [r | {"gamma": float(g), "delta": float(d)} for r, g, d in zip(own.to_dict("records"), fit["gamma"], fit["delta"], strict=True)]

    marked = _by_taxon(sums, by, parts, standard, base + ", gamma double, delta double")
    if eb:

        def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("taxon")
            g, d = shrunk(pdf["gamma"].to_numpy(float), pdf["delta"].to_numpy(float), pdf["n"].to_numpy(float))
            return pdf[[*by, "taxon", "project"]].assign(gamma_star=g, delta_star=d)

        kinds = {f.name: f.dataType.simpleString() for f in marked.schema}
        # One project's row of taxa: two numbers a taxon.
        star = marked.select(*by, "taxon", "project", "n", "gamma", "delta").groupBy(*by, "project").applyInPandas(shrink, ", ".join(f"{c} {kinds[c]}" for c in by) + ", taxon string, project string, gamma_star double, delta_star double")
        marked = marked.join(star, [*by, "taxon", "project"])
    else:
        marked = marked.withColumns({"gamma_star": F.col("gamma"), "delta_star": F.col("delta")})

    def test(own: pd.DataFrame) -> list[dict]:
        s = Sums(own)
        got = s.contrast(*s.adjusted(s.standard(), own["gamma_star"].to_numpy(float), own["delta_star"].to_numpy(float)))
        n, n1 = s.n.sum(), s.xx[:, 0, 1].sum()
        return [got | {"n_case": round(n1), "n_control": round(n - n1), "k_projects": len(own), "covariates": own["covariates"].iloc[0]}]

    out = _by_taxon(marked, by, parts, test, "effect double, se double, stat double, dof double, n_case bigint, n_control bigint, k_projects bigint, covariates string")
    return out.withColumns({"p": t_p("stat", "dof"), "ci_low": F.col("effect") - 1.96 * F.col("se"), "ci_high": F.col("effect") + 1.96 * F.col("se")})


def mixed_contrasts(values: DataFrame, rows: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), min_prevalence: float = 0.10, parts: int = 256) -> DataFrame:
    """Random project intercept, fixed y and covariates, by REML, per (category, taxon)."""
    by = [*scenario, "disease_category"]

    def test(own: pd.DataFrame) -> list[dict]:
        s = Sums(own)
        n, n1 = s.n.sum(), s.xx[:, 0, 1].sum()
        return [s.reml() | {"n_case": round(n1), "n_control": round(n - n1), "k_projects": len(own), "covariates": own["covariates"].iloc[0]}]

    out = _by_taxon(batch_sums(values, rows, covariates, scenario, min_prevalence), by, parts, test, "effect double, se double, converged boolean, n_case bigint, n_control bigint, k_projects bigint, covariates string")
    out = out.withColumn("stat", F.col("effect") / F.nullif(F.col("se"), F.lit(0.0)))
    return out.withColumns({"p": normal_p("stat"), "ci_low": F.col("effect") - 1.96 * F.col("se"), "ci_high": F.col("effect") + 1.96 * F.col("se")})
