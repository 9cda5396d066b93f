"""Contrasts, rank tests and batch correction from sums, against dense computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compostat.operators import batch as T
from compostat.operators import gram as R
from compostat.operators import rankmerge as K
from compostat.operators.differential import rank_sums


def tables(spark, seed=0, n=90, taxa=14):
    """values, zeros, frame and the dense matrix; covariates with gaps, and a text one."""
    rng = np.random.default_rng(seed)
    names, present = [f"s{k}" for k in range(n)], rng.random((n, taxa)) < rng.choice([0.03, 0.2, 0.7], taxa)
    zero = np.round(rng.normal(-2, 0.3, n), 1)
    v = np.round(rng.normal(0, 1, (n, taxa)), 1)
    dense = np.where(present, v, zero[:, None])
    rows = []
    for k, s in enumerate(names):
        project, category = f"p{k % 3}", "c" if k % 2 else "d"
        age = None if rng.random() < (0.5 if project == "p2" else 0.05) else float(rng.integers(1, 80))
        sex = [None, "Male", "female", "female", "male", "unknown"][rng.integers(0, 6) if project != "p1" else 3]
        rows.append((s, project, category, int(rng.random() < 0.5), age, sex))
    frame = spark.createDataFrame(rows, "sample string, project string, disease_category string, y int, age double, sex string")
    values = spark.createDataFrame([(names[i], f"t{j:02}", float(v[i, j])) for i, j in zip(*np.nonzero(present), strict=True)], "sample string, taxon string, clr double")
    zeros = spark.createDataFrame(list(zip(names, map(float, zero), strict=True)), "sample string, zero_clr double")
    return values, zeros, frame, rows, dense, present


def design(rows, use):
    x, used = [np.ones(len(rows)), np.array([r[3] for r in rows], float)], []
    for name, k in use:
        raw = [r[k] for r in rows]
        fill = [np.mean([r[k] is not None for r in rows if r[3] == a] or [1]) for a in (0, 1)]
        if min(fill) < 0.8 or len({c for c in raw if c is not None}) < 2:
            continue
        if name == "sex":
            z = np.array([{"male": 1.0, "female": 0.0}.get(str(c).lower(), np.nan) for c in raw])
        else:
            z = np.array([np.nan if c is None else c for c in raw], float)
            z = (z - np.nanmean(z)) / (np.nanstd(z) or 1.0)
        x.append(z)
        used.append(name)
    x = np.column_stack(x)
    return x, np.isfinite(x).all(axis=1), ",".join(used)


@pytest.mark.parametrize(("seed", "use"), [(0, []), (1, [("age", 4)]), (2, [("age", 4), ("sex", 5)])])
def test_contrasts_from_grams_equal_dense_least_squares(spark, seed, use):
    values, zeros, frame, rows, dense, present = tables(spark, seed)
    covariates = [c for c, _ in use]
    got_rows = R.contrast_rows(frame, zeros, covariates, floors=(3, 3))
    got = {(r["disease_category"], r["project"], r["taxon"]): r for r in R.covariate_contrasts(values, got_rows, covariates).collect()}
    want = 0
    for category in "cd":
        for project in ("p0", "p1", "p2"):
            at = [k for k, r in enumerate(rows) if r[1] == project and r[2] == category]
            x, ok, used = design([rows[k] for k in at], use)
            if min(x[ok, 1].sum(), (1 - x[ok, 1]).sum()) < 3:
                assert not any(k[:2] == (category, project) for k in got)
                continue
            for j in range(dense.shape[1]):
                key = (category, project, f"t{j:02}")
                if present[at, j].mean() < 0.1:
                    assert key not in got
                    continue
                v, d = dense[at, j][ok], x[ok]
                beta, _, rank, _ = np.linalg.lstsq(d, v, rcond=None)
                dof = len(v) - rank
                s2 = ((v - d @ beta) ** 2).sum() / dof
                r, want = got[key], want + 1
                assert (r["n_case"], r["n_control"], r["covariates"], r["dof"]) == (d[:, 1].sum(), (1 - d[:, 1]).sum(), used, dof)
                assert r["effect"] == pytest.approx(beta[1], abs=1e-9) and r["se"] == pytest.approx(np.sqrt(s2 * np.linalg.pinv(d.T @ d)[1, 1]), abs=1e-9)
                assert r["stat"] == pytest.approx(r["effect"] / r["se"])
    assert want == len(got) > 20


def test_effect_of_y_given_by_a_covariate_is_null(spark):
    frame = spark.createDataFrame([(f"s{k}", "p", "c", k % 2, float(k % 2)) for k in range(12)], "sample string, project string, disease_category string, y int, same double")
    zeros = spark.createDataFrame([(f"s{k}", -1.0) for k in range(12)], "sample string, zero double")
    values = spark.createDataFrame([(f"s{k}", "t", float(k * k)) for k in range(12)] + [(f"s{k}", "flat", -1.0) for k in range(6)], "sample string, taxon string, v double")
    for covariates, effect in (([], False), (["same"], True)):
        got = {r["taxon"]: r["effect"] for r in R.covariate_contrasts(values, R.contrast_rows(frame, zeros, covariates), covariates).collect()}
        assert got["flat"] is None and (got["t"] is None) == effect


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_rank_sums_of_sparse_cells_equal_dense_ones(spark, per_task):
    values, zeros, frame, rows, dense, _ = tables(spark, 5)
    taxa = spark.createDataFrame([(f"t{j:02}",) for j in range(dense.shape[1])] + [("never",)], "taxon string")
    cells = spark.createDataFrame([(*rows[i][:4], f"t{j:02}", float(dense[i, j])) for i in range(len(rows)) for j in range(dense.shape[1])], "sample string, project string, disease_category string, y int, taxon string, v double")
    columns = ["disease_category", "project", "taxon", "n_case", "n_control", "u", "rank_biserial", "ties"]
    got_rows = R.contrast_rows(frame, zeros)
    got = sorted(map(tuple, K.sparse_rank_sums(values, got_rows, taxa=taxa, cells_per_task=per_task).select(columns).collect()))
    want = sorted(map(tuple, rank_sums(cells).select(columns).collect()))
    assert [r for r in got if r[2] != "never"] == want
    assert {r[2]: r for r in got}.keys() == {f"t{j:02}" for j in range(dense.shape[1])} | {"never"}
    some = sorted(map(tuple, K.sparse_rank_sums(values, got_rows, cells_per_task=per_task).select(columns).collect()))
    present = set(map(tuple, values.join(frame, "sample").select("disease_category", "project", "taxon").distinct().collect()))
    assert some == [r for r in want if r[:3] in present]
    plan = K.sparse_rank_sums(values, got_rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_sums_without_an_arm(spark):
    frame = spark.createDataFrame([("a", "p", "c", 1), ("b", "p", "c", 1)], "sample string, project string, disease_category string, y int")
    zeros = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "sample string, zero double")
    values = spark.createDataFrame([("a", "t", 1.0)], "sample string, taxon string, v double")
    rows = R.contrast_rows(frame, zeros, floors=(0, 0))
    (r,) = K.sparse_rank_sums(values, rows).collect()
    assert r["u"] is None and r["n_control"] == 0
    assert K.sparse_rank_sums(values.limit(0), rows).count() == 0


def combat_dense(v, batch, mod, eb):
    """ComBat on a matrix, from its paper: standardise, shrink, adjust."""
    levels = sorted(set(batch))
    b = np.array([[float(x == level) for level in levels] for x in batch])
    n = b.sum(axis=0)
    coef = np.linalg.pinv(np.hstack([b, mod])) @ v
    model = (n / n.sum()) @ coef[: len(levels)] + mod @ coef[len(levels) :]
    sd = np.sqrt(np.maximum(((v - np.hstack([b, mod]) @ coef) ** 2).mean(axis=0), 1e-8))
    z = (v - model) / sd
    out = np.empty_like(z)
    for k, level in enumerate(levels):
        own = np.array([x == level for x in batch])
        g, d = z[own].mean(axis=0), np.maximum(z[own].var(axis=0, ddof=1), 1e-8)
        if eb:
            g_hat, t2, m, s2 = g, g.var(ddof=1), d.mean(), d.var(ddof=1)
            lam, theta, mean = (m**2 + 2 * s2) / s2, (m**3 + m * s2) / s2, g.mean()
            for _ in range(200):
                new = (n[k] * t2 * g_hat + d * mean) / (n[k] * t2 + d)
                scale = (0.5 * ((z[own] - new) ** 2).sum(axis=0) + theta) / (0.5 * n[k] + lam - 1)
                small = max(np.max(np.abs(new - g) / (np.abs(g) + 1e-8)), np.max(np.abs(scale - d) / (np.abs(d) + 1e-8))) < 1e-4
                g, d = new, scale
                if small:
                    break
        out[own] = (z[own] - g) / np.sqrt(d)
    return out * sd + model


@pytest.mark.parametrize(("eb", "use"), [(False, []), (True, []), (True, [("age", 4)])])
def test_combat_from_sums_equals_dense_combat(spark, eb, use):
    values, zeros, frame, rows, dense, present = tables(spark, 7, n=150)
    covariates = [c for c, _ in use]
    # p2 lacks ages too often only within it: the pooled design is over all projects.
    frame = frame.withColumn("age", F.coalesce("age", F.lit(33.0)) if use else F.col("age"))
    rows = [(*r[:4], 33.0 if r[4] is None and use else r[4], r[5]) for r in rows]
    got = {(r["disease_category"], r["taxon"]): r for r in T.combat_contrasts(values, T.pooled_rows(frame, zeros, covariates), covariates, eb=eb, parts=5).collect()}
    for category in "cd":
        at = [k for k, r in enumerate(rows) if r[2] == category]
        x, ok, used = design([rows[k] for k in at], use)
        keep = [j for j in range(dense.shape[1]) if present[at, j].mean() >= 0.1]
        v, x = dense[at][:, keep][ok], x[ok]
        a = combat_dense(v, [rows[k][1] for k, o in zip(at, ok, strict=True) if o], x[:, 1:], eb)
        beta = np.linalg.lstsq(x, a, rcond=None)[0]
        se = np.sqrt(((a - x @ beta) ** 2).sum(axis=0) / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert {k[1] for k in got if k[0] == category} == {f"t{j:02}" for j in keep}
        for k, j in enumerate(keep):
            r = got[category, f"t{j:02}"]
            assert r["effect"] == pytest.approx(beta[1, k], abs=1e-8) and r["se"] == pytest.approx(se[k], abs=1e-8)
            assert (r["k_projects"], r["covariates"], r["dof"]) == (3, used, len(x) - x.shape[1])
            assert r["ci_high"] - r["ci_low"] == pytest.approx(3.92 * se[k])


def test_mixed_model_with_covariates_maximises_the_likelihood(spark):
    values, zeros, frame, rows, dense, _ = tables(spark, 8, n=120)
    frame = frame.withColumn("age", F.coalesce("age", F.lit(33.0)))
    rows = [(*r[:4], 33.0 if r[4] is None else r[4], r[5]) for r in rows]
    got = {(r["disease_category"], r["taxon"]): r for r in T.mixed_contrasts(values, T.pooled_rows(frame, zeros, ["age"]), ["age"]).collect()}
    at = [k for k, r in enumerate(rows) if r[2] == "c"]
    x, _, _ = design([rows[k] for k in at], [("age", 4)])
    z = np.array([[float(rows[k][1] == p) for p in ("p0", "p1", "p2")] for k in at])

    def fit(v, ratio):
        inv = np.linalg.inv(np.eye(len(v)) + ratio * z @ z.T)
        a = x.T @ inv @ x
        beta = np.linalg.solve(a, x.T @ inv @ v)
        s2 = (v - x @ beta) @ inv @ (v - x @ beta) / (len(v) - x.shape[1])
        return beta[1], np.sqrt(s2 * np.linalg.inv(a)[1, 1]), (len(v) - x.shape[1]) * np.log(s2) - np.linalg.slogdet(inv)[1] + np.linalg.slogdet(a)[1]

    for j in range(dense.shape[1]):
        r = got.get(("c", f"t{j:02}"))
        if r is None:
            continue
        fits = [fit(dense[at, j], ratio) for ratio in np.exp(np.linspace(-14, 8, 400))]
        best = min(fits, key=lambda f: f[2])
        assert r["effect"] == pytest.approx(best[0], abs=2e-3) and r["se"] == pytest.approx(best[1], rel=0.02)
    assert sum(k[0] == "c" for k in got) > 5


def test_dense_cells_shuffle_present_ones_only(spark):
    from compostat.operators import compose as C

    values = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "z", 2.0), ("c", "x", 9.0)], "sample string, taxon string, clr double")
    zeros = spark.createDataFrame([("a", -1.0, "p"), ("b", -2.0, "q"), ("d", -3.0, "q")], "sample string, zero_clr double, project string")
    cells = C.dense(values, zeros, spark.createDataFrame([("x",), ("y",)], "taxon string"), keep=["project"])
    assert sorted(map(tuple, cells.collect())) == [("a", "x", 1.0, "p"), ("a", "y", -1.0, "p"), ("b", "x", -2.0, "q"), ("b", "y", -2.0, "q"), ("d", "x", -3.0, "q"), ("d", "y", -3.0, "q")]
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    # Nothing is joined to the cells after they are made.
    assert plan.index("Generate") < plan.index("Join")
