"""Covariate-adjusted contrasts from sums: no dense cells.

A contrast (disease category in a project) has one design ``x = [1, y, covariates]`` over its
samples.  Least squares of a taxon need ``x'x``, ``x'v`` and ``v'v``.  The first is the
contrast's alone.  The others are what the samples' zero values give, once per contrast, and
a correction over the few cells in which the taxon is present.  So the work is one pass over
the non-zeros, whatever the number of covariates.

Covariates are columns of the frame.  Numbers are standardised within the contrast
(population deviation); a text is sex: male is 1, female 0, anything else missing.  One is
used in a contrast if enough of both arms have it and it varies there; samples that miss a
used one don't count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _block(scenario: Sequence[str]) -> list[str]:
    return [*scenario, "disease_category", "project"]


def _known(col: str, kind: str) -> Column:
    return F.when(~F.isnan(col), F.col(col)) if kind in ("double", "float") else F.col(col)


def _number(col: str, kind: str) -> Column:
    if kind == "string":
        return F.when(F.lower(F.col(col)) == "male", 1.0).when(F.lower(F.col(col)) == "female", 0.0)
    return _known(col, kind).cast("double")


def contrast_design(frame: DataFrame, covariates: Sequence[str], by: Sequence[str], min_coverage: float = 0.8) -> DataFrame:
    """The rows of ``frame`` with their design ``x0, x1, ..`` (1, y, covariates; one that the
    group ``by`` doesn't use is 0), ``complete`` and the ``covariates`` used, by name."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    stats = []
    for k, c in enumerate(covariates):
        raw, number = _known(c, kinds[c]), _number(c, kinds[c])
        filled = [F.coalesce(F.avg(F.when(F.col("y") == a, raw.isNotNull().cast("double"))), F.lit(1.0)) for a in (0, 1)]
        used = (F.least(*filled) >= min_coverage) & F.coalesce(F.min(raw) < F.max(raw), F.lit(False))
        stats += [used.alias(f"__used{k}"), (F.avg(number) if kinds[c] != "string" else F.lit(0.0)).alias(f"__mean{k}"), (F.stddev_pop(number) if kinds[c] != "string" else F.lit(1.0)).alias(f"__sd{k}")]
    x = [F.lit(1.0), F.col("y").cast("double")]
    if not covariates:
        return frame.select(*frame.columns, *(c.alias(f"x{k}") for k, c in enumerate(x)), F.lit(True).alias("complete"), F.lit("").alias("covariates"))
    met = frame.join(frame.groupBy(*by).agg(*stats), list(by))
    used = [F.col(f"__used{k}") for k in range(len(covariates))]
    z = [(_number(c, kinds[c]) - F.col(f"__mean{k}")) / F.when(F.col(f"__sd{k}") > 0, F.col(f"__sd{k}")).otherwise(1.0) for k, c in enumerate(covariates)]
    complete = F.lit(True)
    for u, v in zip(used, z, strict=True):
        complete = complete & (~u | v.isNotNull())
    x += [F.when(u, v).otherwise(0.0) for u, v in zip(used, z, strict=True)]
    names = F.array_join(F.array_compact(F.array(*(F.when(u, F.lit(c)) for u, c in zip(used, covariates, strict=True)))), ",")
    return met.select(*frame.columns, *(c.alias(f"x{k}") for k, c in enumerate(x)), complete.alias("complete"), names.alias("covariates"))


@lru_cache
def _inverse():
    """Made on first use: workers import this module without a session."""

    def solve(grams: pd.Series) -> pd.DataFrame:
        out = []
        for flat in grams:
            p = round(len(flat) ** 0.5)
            g = np.array(flat, float).reshape(p, p)
            scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
            s = g / np.outer(scale, scale)
            rank = lambda m: int(np.linalg.matrix_rank(m, tol=1e-9, hermitian=True))
            others = [k for k in range(p) if k != 1]
            # y's effect is there only if the other columns don't already give y.
            free = rank(s) > rank(s[np.ix_(others, others)])
            out.append({"inverse": (np.linalg.pinv(s, rcond=1e-9, hermitian=True) / np.outer(scale, scale)).ravel().tolist(), "rank": rank(s), "estimable": bool(free)})
        return pd.DataFrame(out, columns=["inverse", "rank", "estimable"])

    return F.pandas_udf(solve, "inverse array<double>, rank int, estimable boolean")


def gram_inverse(gram: Column) -> Column:
    """Of a design's ``x'x`` (by rows): pseudo-inverse, rank, and whether y (column 1) has an
    effect of its own."""
    return _inverse()(gram)


def solve_contrast(df: DataFrame, p: int, n_rows: Column) -> DataFrame:
    """Adds ``effect, se, stat, dof`` of design column 1 from ``__inv`` (``gram_inverse``), ``xv0``..
    and ``vv``; null where there is nothing to estimate, nothing varies or no degree of
    freedom is left."""
    inv = lambda i, j: F.get(F.col("__inv.inverse"), F.lit(p * i + j))
    total = lambda cols: sum(cols[1:], cols[0])
    effect = total([inv(1, j) * F.col(f"xv{j}") for j in range(p)])
    fitted = total([inv(i, j) * F.col(f"xv{i}") * F.col(f"xv{j}") for i in range(p) for j in range(p)])
    dof = n_rows - F.col("__inv.rank")
    done = df.withColumns({"__effect": effect, "__dof": dof.cast("double"), "__s2": (F.col("vv") - fitted) / F.nullif(dof, F.lit(0))})
    good = F.col("__inv.estimable") & (F.col("__dof") > 0) & (F.col("__s2") > 1e-12 * F.greatest(F.col("vv") / n_rows, F.lit(1e-6)))
    done = done.withColumn("se", F.when(good, F.sqrt(F.col("__s2") * inv(1, 1))))
    return done.withColumns({"effect": F.when(F.col("se").isNotNull(), F.col("__effect")), "stat": F.col("__effect") / F.col("se")}).withColumnRenamed("__dof", "dof").drop("__effect", "__s2")


def contrast_rows(frame: DataFrame, zeros: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), floors: tuple[int, int] = (1, 1), min_coverage: float = 0.8) -> DataFrame:
    """Samples of the contrasts over both floors, with and without those that miss a covariate;
    with ``zero``, ``n_all`` (samples of the contrast) and the design."""
    block = _block(scenario)
    known = ["sample", *(c for c in scenario if c in zeros.columns and c in frame.columns)]
    name = next(c for c in zeros.columns if c not in ("sample", *scenario))
    rows = contrast_design(frame.join(zeros.withColumnRenamed(name, "zero"), known), covariates, block, min_coverage)
    arm = lambda a, ok: F.count_if((F.col("y") == a) & ok)
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n_all"), *(arm(a, F.col("complete")).alias(f"n{a}") for a in (0, 1)), *(arm(a, F.lit(True)).alias(f"__all{a}") for a in (0, 1)))
    over = sizes.filter((F.col("n1") >= floors[0]) & (F.col("n0") >= floors[1]) & (F.col("__all1") >= floors[0]) & (F.col("__all0") >= floors[1]))
    return rows.join(over.drop("__all0", "__all1"), block)


def _cells(rows: DataFrame, values: DataFrame, scenario: Sequence[str]) -> DataFrame:
    known = ["sample", *(c for c in scenario if c in values.columns)]
    name = next(c for c in values.columns if c not in ("sample", "taxon", *scenario))
    return rows.join(values.withColumnRenamed(name, "v"), known)


def covariate_contrasts(values: DataFrame, rows: DataFrame, covariates: Sequence[str] = (), scenario: Sequence[str] = (), min_prevalence: float = 0.10) -> DataFrame:
    """Least squares of each taxon on y and the covariates in every contrast of ``rows``
    (``contrast_rows``), for taxa present in ``min_prevalence`` of the contrast's samples, those
    that miss a covariate included."""
    block, p = _block(scenario), 2 + len(covariates)
    whole = rows.filter("complete")
    sums = whole.groupBy(*block, "n_all", "n0", "n1", "covariates").agg(
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)),
        *(F.sum(F.col(f"x{j}") * F.col("zero")).alias(f"zx{j}") for j in range(p)), F.sum(F.col("zero") * F.col("zero")).alias("zz"),
    )
    gram = F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)))
    sums = sums.withColumn("__inv", gram_inverse(gram)).drop(*(f"g{i}_{j}" for i in range(p) for j in range(i, p)))
    inside = lambda c: F.sum(F.when(F.col("complete"), c).otherwise(0.0))
    met = _cells(rows, values, scenario).groupBy(*block, "taxon").agg(
        F.count(F.lit(1)).alias("n_present"), *(inside(F.col(f"x{j}") * (F.col("v") - F.col("zero"))).alias(f"d{j}") for j in range(p)), inside(F.col("v") * F.col("v") - F.col("zero") * F.col("zero")).alias("dd")
    )
    fit = met.join(sums, block).filter(F.col("n_present") >= F.lit(min_prevalence) * F.col("n_all"))
    fit = fit.withColumns({**{f"xv{j}": F.col(f"zx{j}") + F.col(f"d{j}") for j in range(p)}, "vv": F.col("zz") + F.col("dd")})
    done = solve_contrast(fit, p, F.col("n0") + F.col("n1"))
    return done.select(*block, "taxon", F.col("n1").alias("n_case"), F.col("n0").alias("n_control"), "n_present", "effect", "se", "stat", "dof", "covariates")
