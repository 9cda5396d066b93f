import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compostat.operators import cohorts as H
from compostat.operators import compose as C
from compostat.operators import counts as N
from compostat.operators import differential as D
from compostat.operators import diversity as B
from compostat.operators import eav as E
from compostat.operators import graphs as G
from compostat.operators import labels as L
from compostat.operators import models as M
from compostat.operators import sampling as S
from compostat.operators import validation as V


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([("a", "x", 4), ("a", "y", 6), ("b", "x", 10), ("c", "z", 1), ("c", "x", 1), ("c", "y", 8)], "sample string, taxon string, n bigint")


def test_clr_rows_sum_to_zero(spark, counts):
    taxa = counts.select("taxon").distinct()
    for method in ("additive", "multiplicative"):
        values, zeros, _ = C.clr(counts, method=method)
        sums = C.dense(values, zeros, taxa).groupBy("sample").agg(F.sum("clr").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert all(abs(r["s"]) < 1e-9 and r["n"] == 3 for r in sums)
    v = {(r["sample"], r["taxon"]): r["clr"] for r in C.clr(counts)[0].collect()}
    m = (math.log(4) + math.log(6) + math.log(0.5)) / 3
    assert v["a", "x"] == pytest.approx(math.log(4) - m)


def test_clr_exclusions_and_errors(spark, counts):
    samples = spark.createDataFrame([("a",), ("none",)], "sample string")
    assert [tuple(r) for r in C.clr(counts, samples=samples)[2].collect()] == [("none", "no reads in any prevalent taxon")]
    assert "c" not in {r["sample"] for r in C.clr(counts.filter("sample != 'c' OR taxon = 'z'"), method="multiplicative", pseudocount=0.6, n_taxa=9)[0].collect()}
    for bad in ({"method": "other"}, {"pseudocount": 0}):
        with pytest.raises(ValueError):
            C.clr(counts, **bad)
    with pytest.raises(Exception, match="without reads"):
        C.relative_abundance(spark.createDataFrame([("a", "x", 0)], "sample string, taxon string, n bigint")).collect()


def test_rarefaction_is_exact_and_repeatable(counts):
    one, two = (sorted(map(tuple, C.rarefy(counts.repartition(k), 10, seed=1).collect())) for k in (1, 3))
    assert one == two and {s: sum(n for a, _, n in one if a == s) for s in "abc"} == {"a": 10, "b": 10, "c": 10}
    assert C.rarefy(counts, 11).count() == 0


def test_rarefaction_follows_the_hypergeometric_distribution(spark):
    # Many samples with the same counts, each with its own hashes.
    n, depth, samples = {"x": 3000, "y": 900, "z": 90, "w": 10}, 200, 1500
    rows = [(f"s{k}", t, c) for k in range(samples) for t, c in n.items()]
    got = C.rarefy(spark.createDataFrame(rows, "sample string, taxon string, n bigint"), depth).toPandas()
    assert (got.groupby("sample")["n"].sum() == depth).all() and got["sample"].nunique() == samples
    total = sum(n.values())
    for t, c in n.items():
        drawn = got[got["taxon"] == t].set_index("sample")["n"].reindex([f"s{k}" for k in range(samples)]).fillna(0)
        share = c / total
        var = depth * share * (1 - share) * (total - depth) / (total - 1)
        assert abs(drawn.mean() - depth * share) < 4 * (var / samples) ** 0.5 and drawn.var() == pytest.approx(var, rel=0.15)


@settings(max_examples=150, deadline=None)
@given(st.floats(0, 1, exclude_max=True), st.integers(0, 60), st.integers(0, 60), st.integers(0, 120))
def test_hypergeometric_is_the_inverse_of_its_distribution(u, good, bad, draws):
    draws = min(draws, good + bad)
    ways = [math.comb(good, k) * math.comb(bad, draws - k) if draws >= k else 0 for k in range(good + 1)]
    k = C.hypergeometric(u, good, good + bad, draws)
    upto, target = sum(ways[:k]), u * sum(ways)
    assert upto <= target * (1 + 1e-9) and target <= (upto + ways[k]) * (1 + 1e-9) and ways[k] > 0


def test_hypergeometric_of_large_cells():
    assert C.hypergeometric(0.5, 10**9, 3 * 10**9, 10**6) == pytest.approx(333_333, abs=3)
    assert C.hypergeometric(0.0, 10**9, 10**9, 77) == 77 and C.hypergeometric(0.99, 0, 10**9, 10**6) == 0


@pytest.mark.parametrize("parts", [2, 7, 256])
def test_ranks_in_parts(spark, parts):
    from compostat.operators.diversity import average_rank, rank_table

    rng = np.random.default_rng(parts)
    df = spark.createDataFrame([(float(v),) for v in [*rng.integers(0, 9, 300), *rng.normal(size=100), 4.0]], "v double")
    want = {r["v"]: r["r"] for r in df.select("v", average_rank("v").alias("r")).collect()}
    assert {r["v"]: r["r"] for r in rank_table(df, "v", "r", parts=parts).collect()} == want


def test_wide_round_trip(spark, counts):
    back = N.from_wide(N.to_wide(counts, ["x", "y", "z"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect()))


def test_qc_keeps_unknown(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    kept, flow = H.qc_flow(df, [("ok", F.col("ok")), ("small", F.col("i") < 3)])
    assert [r["i"] for r in kept.collect()] == [1]
    assert [(r["n_in"], r["n_removed"], r["n_out"]) for r in flow.collect()] == [(3, 1, 2), (2, 1, 1)]


def test_within_cohort_lists_projects_without_rows(spark):
    df = spark.createDataFrame([("p", "case")] * 2 + [("p", "healthy")] * 2, "project string, disease_label string")
    confirmed = spark.createDataFrame([("p",), ("q",)], "project string")
    kept, out = H.within_project_cohort(df, confirmed, 2, 2)
    assert kept.count() == 4 and [tuple(r) for r in out.collect()] == [("q", 0, 0)]


def test_pivot_prefers_sources_then_rows(spark):
    tags = spark.createDataFrame([(1, "p", "s", "b", "B1"), (2, "p", "s", "a", None), (3, "p", "s", "a", "A3"), (4, "p", "s", "a", "A4"), (5, "p", "t", "b", "B5"), (6, "p", "u", "z", "no")], "row_id int, project string, srr string, tag string, value string")
    got = {r["srr"]: (r["c"], r["c_source_tag"]) for r in E.pivot_concepts(tags, {"c": ["a", "b"]}).collect()}
    assert got == {"s": ("A3", "a"), "t": ("B5", "b"), "u": (None, None)}


def test_spine_join_rejects_repeats(spark):
    spine = spark.createDataFrame([("a", 1)], "srr string, v int")
    once = spark.createDataFrame([("a", 2)], "srr string, v int")
    assert E.join_spine(spine, [once], ["srr"]).first().asDict() == {"srr": "a", "v": 1, "v_wide": 2}
    with pytest.raises(Exception, match="repeated srr"):
        E.join_spine(spine, [once.union(once)], ["srr"]).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(0, 120))
def test_subset_sums(counts, target):
    got = L.subset_with_sum(counts, target)
    possible = {0}
    for c in counts:
        possible |= {p + c for p in possible}
    assert (got is None) == (target not in possible)
    assert got is None or (sum(counts[k] for k in got) == target and len(set(got)) == len(got))


def test_resolve_values():
    assert L.resolve_values({"a": 5, "b": 3, "c": 2}, 5, 3) == {"a": "healthy", "b": "case"}
    # The first fit for the controls is final, even if it leaves no cases.
    assert L.resolve_values({"a": 5, "b": 3, "c": 2}, 5, 4) is None
    assert L.resolve_values({"a": 5}, 0, 5) == {"a": "case"}


def test_stratified_subsample(spark):
    df = spark.createDataFrame([(f"k{i}", "big" if i < 90 else "small" if i < 99 else "one") for i in range(100)], "k string, s string")
    got = {r["s"]: r["n"] for r in S.stratified_subsample(df, "s", "k", 10).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"big": 9, "small": 1, "one": 1}
    assert S.stratified_subsample(df, "s", "k", 1000).count() == 100


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.03,), (None,), (0.5,)], "p double")
    got = [r["q"] for r in D.bh_fdr(df).orderBy("p").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


def test_meta_analysis_by_hand(spark):
    rows = [("c", f"p{i}", "t", e, se, 10, 10) for i, (e, se) in enumerate([(1.0, 0.5), (0.2, 0.4), (1.5, 0.3)])] + [("c", "p0", "u", 1.0, 0.5, 10, 10), ("c", "p1", "w", 1.0, 0.0, 5, 5)]
    df = spark.createDataFrame(rows, "disease_category string, project string, taxon string, effect double, se double, n_case bigint, n_control bigint")
    (r,) = D.meta_analysis(df).collect()
    y, v = np.array([1.0, 0.2, 1.5]), np.array([0.25, 0.16, 0.09])
    w = 1 / v
    q = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    tau2 = max(0, (q - 2) / (w.sum() - (w**2).sum() / w.sum()))
    w2 = 1 / (v + tau2)
    assert (r["taxon"], r["k_projects"], r["n_case"]) == ("t", 3, 30)
    assert (r["q_stat"], r["tau2"], r["pooled_effect"], r["se"]) == pytest.approx((q, tau2, (w2 * y).sum() / w2.sum(), w2.sum() ** -0.5))
    assert r["i2"] == pytest.approx(100 * (q - 2) / q) and r["sign_consistency"] == 1.0


@pytest.fixture(scope="module")
def shifted(spark):
    """Two batches of different location and scale; taxon hot is raised in cases."""
    rng = np.random.default_rng(3)
    rows = []
    for b, (loc, scale) in enumerate([(0, 1), (5, 2), (-3, 0.5)]):
        for i in range(40):
            for t in range(12):
                y = i % 2
                rows.append(("c", f"s{b}-{i}", f"b{b}", y, f"t{t:02d}", float(loc + scale * rng.normal() + (2.0 * y if t == 0 else 0))))
    return spark.createDataFrame(rows, "disease_category string, sample string, project string, y int, taxon string, v double")


def test_combat_removes_batches_and_keeps_the_effect(shifted):
    for eb in (False, True):
        adj = D.combat(shifted, eb=eb).toPandas()
        means = adj[adj.taxon != "t00"].groupby("project").adjusted.mean()
        assert means.max() - means.min() < 0.2
        hot = adj[adj.taxon == "t00"].groupby("y").adjusted.mean()
        assert 1.2 < hot[1] - hot[0] < 2.8
    spread = D.combat(shifted, eb=False).groupBy("taxon", "project").agg(F.avg("adjusted").alias("m")).groupBy("taxon").agg((F.max("m") - F.min("m")).alias("d")).agg(F.max("d")).first()[0]
    assert spread < 1e-9  # arms are balanced, so every batch has the same mean


def test_pooled_and_mixed_models_find_the_effect(shifted):
    pooled = D.pooled_ols(D.combat(shifted)).toPandas().set_index("taxon")
    assert pooled.q["t00"] < 0.01 and (pooled.q.drop("t00") > 0.001).all()
    mixed = D.mixed_model(shifted).toPandas().set_index("taxon")
    assert mixed.p["t00"] < 1e-6 and mixed.converged.all() and 1.2 < mixed.effect["t00"] < 2.8


def test_ols_matches_moments(spark, shifted):
    got = D.ols_with_covariates(shifted, []).toPandas().set_index(["project", "taxon"])
    zeros = shifted.select("sample").distinct().withColumn("zero", F.lit(0.0))
    m = D.ols_contrasts(D.contrast_moments(shifted.select("sample", "taxon", "v"), zeros, shifted.select("sample", "project", "disease_category", "y").distinct())).toPandas().set_index(["project", "taxon"])
    for c in ("effect", "se", "stat"):
        assert np.allclose(got[c].astype(float), m[c].reindex(got.index).astype(float))


def test_constant_taxon_has_no_contrast(spark):
    frame = spark.createDataFrame([(f"s{i}", "p", "c", i % 2) for i in range(8)], "sample string, project string, disease_category string, y int")
    values = frame.select("sample", F.lit("t").alias("taxon"), F.lit(1.0).alias("v"))
    (r,) = D.ols_contrasts(D.contrast_moments(values, frame.select("sample", F.lit(0.0).alias("zero")), frame)).collect()
    assert r["effect"] is None and r["se"] is None and r["stat"] is None


def test_rank_sums(spark):
    rows = [("c", "p", "t", y, v) for y, v in ((1, 3.0), (1, 4.0), (1, 5.0), (0, 1.0), (0, 2.0), (0, 3.0))] + [("c", "p", "u", i % 2, 1.0) for i in range(8)] + [("c", "p", "w", i % 2, float(i)) for i in range(4)]
    got = D.rank_sums(spark.createDataFrame(rows, "disease_category string, project string, taxon string, y int, v double")).toPandas().set_index("taxon")
    assert got.u["t"] == 8.5 and got.rank_biserial["t"] == pytest.approx(2 * 8.5 / 9 - 1) and got.ties["t"] == 6
    assert pd.isna(got.u["u"]) and pd.isna(got.u["w"])


def test_permanova_matches_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (i % 3)], f"g{i % 3}") for i in range(45)]
    v = spark.createDataFrame(rows, "sample int, vec array<double>, g string")
    (a,), (b,) = B.permanova(v, ["g"]).collect(), B.permanova_pairs(B.euclidean_pairs(v), v, "g").collect()
    assert (a["pseudo_f"], a["r2"], a["n"]) == (pytest.approx(b["pseudo_f"]), pytest.approx(b["r2"]), 45)
    assert B.inertia(v).first()["inertia"] == pytest.approx(B.inertia_of_pairs(B.euclidean_pairs(v), 45).first()["inertia"])
    seq = B.sequential_ss(v, ["g"], permutations=99).toPandas()
    assert seq.r2.sum() == pytest.approx(1) and seq.r2[0] == pytest.approx(a["r2"]) and seq.p[0] == pytest.approx(0.01) and pd.isna(seq.p[1])
    noisy = v.withColumn("h", (F.col("sample") * 7 % 4).cast("string"))
    ps = {tuple(r["p"] for r in B.sequential_ss(noisy.repartition(k), ["h", "g"], permutations=49).orderBy("term_order").collect()) for k in (1, 5)}
    assert len(ps) == 1
    with pytest.raises(ValueError):
        B.sequential_ss(v, ["g"], permutations=9, max_rows=44)
    assert B.permanova_p(v, "g", 99).first()["p"] == pytest.approx(0.01)
    coords, share = B.pcoa(B.euclidean_pairs(v), 2)
    pcs, share2 = B.principal_coordinates(v, 2)
    assert np.allclose(share, share2) and np.allclose(np.abs(coords.pc1), np.abs(pcs.orderBy("sample").toPandas().pc1))


def test_bray_curtis_of_disjoint_rows(spark):
    rel = C.relative_abundance(spark.createDataFrame([("a", "x", 1), ("b", "y", 5), ("c", "x", 2), ("c", "y", 2)], "sample string, taxon string, n bigint"))
    assert {(r["a"], r["b"]): r["d"] for r in B.bray_curtis(rel).collect()} == {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): 0.5}


def test_forest(spark):
    leaves = spark.createDataFrame([(0, ["B", "NA", "x"]), (1, ["B", "F", "x"]), (2, ["A", "NA", "y"])], "pos int, parts array<string>")
    nodes = G.taxonomy_nodes(leaves)
    assert G.taxonomy_checks(nodes).first().asDict() == {"n_nodes": 8, "n_leaves": 3, "n_internal": 5, "n_roots": 2, "n_unrooted": 0}
    assert [(r["node_id"], r["parent"]) for r in nodes.orderBy("node_id").collect()][:3] == [(0, 7), (1, 6), (2, 5)]
    with pytest.raises(Exception, match="repeated lineage"):
        G.taxonomy_nodes(leaves.union(leaves)).collect()


def test_knn_with_exact_duplicates(spark):
    v = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(12)], "sample int, vec array<double>")
    want = sorted((i, j) for i in range(12) for j in sorted((abs(i // 2 - j // 2), j) for j in range(12) if j != i)[:3] for j in [j[1]])
    for block in (3, 512):
        assert sorted((r["src"], r["dst"]) for r in G.knn(v, 3, block=block).collect()) == want


def test_variants_need_their_parts(spark):
    a = spark.createDataFrame([("s", "t", 1.0)], "sample string, taxon string, weight double")
    assert G.assemble("G1", a).count() == 2
    for bad in (("G2", {}), ("G1", {"neighbours": a}), ("G9", {})):
        with pytest.raises(ValueError):
            G.assemble(bad[0], a, **bad[1])
    with pytest.raises(ValueError):
        G.allowed_features(["depth", "clr"], ["depth"])


def test_matched_width():
    h = G.matched_width(419, 267, 490_635)
    assert abs(h * h + (419 + 267 + 2) * h + 267 - 490_635) < 0.05 * 490_635
    with pytest.raises(ValueError):
        G.matched_width(1000, 1000, 10)


def test_auc(spark):
    rows = [("f", 1, 0.9), ("f", 0, 0.1), ("f", 1, 0.5), ("f", 0, 0.5), ("g", 1, 0.1)]
    got = {r["fold"]: r["auc"] for r in M.roc_auc(spark.createDataFrame(rows, "fold string, y int, score double")).collect()}
    assert got == {"f": pytest.approx(0.875), "g": None}


def test_leaky_folds_score_higher(spark):
    """Labels follow the study, so folds that split studies look better than they are."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    rows = [(f"s{i}", (i % 6) % 2, f"p{i % 6}", [float(x) for x in np.eye(6)[i % 6] * 3 + rng.normal(size=6)]) for i in range(180)]
    v = spark.createDataFrame(rows, "sample string, y int, project string, vec array<double>").withColumn("features", array_to_vector("vec"))
    score = lambda folds: M.roc_auc(M.cross_validated(folds, ["logreg"]).withColumn("fold", F.lit(0))).first()["auc"]
    assert score(S.stratified_folds(v, "y", "sample", 3)) > score(S.group_folds(v, "project")) + 0.2


def test_shuffles_lose_the_signal(spark):
    rng = np.random.default_rng(5)
    frame, values = [], []
    for p in range(4):
        for i in range(30):
            frame.append((f"{p}-{i}", f"p{p}", "c", i % 2))
            values += [(f"{p}-{i}", f"t{t}", float(rng.normal() + (3 * (i % 2) if t == 0 else 0))) for t in range(8)]
    frame = spark.createDataFrame(frame, "sample string, project string, disease_category string, y int")
    values, zeros = spark.createDataFrame(values, "sample string, taxon string, v double"), frame.select("sample", F.lit(0.0).alias("z"))
    real = D.meta_analysis(D.ols_contrasts(D.contrast_moments(values, zeros, frame))).toPandas().set_index("taxon")
    assert real.q["t0"] < 1e-6 and (real.q.drop("t0") > 0.01).all()
    null = V.null_summary(V.shuffle_null(values, zeros, frame, 5, z=3.0)).first()
    assert null["n_shuffles"] == 5 and null["max_hits"] <= 2
    again = V.shuffled_frames(frame, 2)
    assert again.groupBy("shuffle_id", "project").agg(F.sum("y").alias("s")).filter("s != 15").count() == 0


def test_run_chain_and_checks(spark, shifted):
    zeros = shifted.select("sample").distinct().withColumn("z", F.lit(0.0))
    frame = shifted.select("sample", "project", "disease_category", "y").distinct()
    out = V.run_chain(shifted.select("sample", "taxon", "v"), zeros, frame, shifted)
    assert V.replicated_sets(out["concordance"]).first()["taxa"].split(",")[0] == "t00"
    assert D.concordance_summary(out["concordance"]).first()["n_taxa"] == 12
    assert V.repeated_keys(out["meta"], "disease_category", "taxon").count() == 0
    assert V.not_subset(out["meta"], shifted, "taxon").count() == 0


def test_chain_in_scenarios_is_the_chain_of_each(spark, shifted):
    zeros = shifted.select("sample").distinct().withColumn("z", F.lit(0.0))
    frame = shifted.select("sample", "project", "disease_category", "y").distinct()
    values = shifted.select("sample", "taxon", "v")
    in_all = {r["taxon"]: r.asDict() for r in V.run_chain(values, zeros, frame, shifted)["concordance"].collect()}
    two = lambda df: df.withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2))))
    few = F.expr("tier = 1 OR taxon < 't06'")
    got = V.run_chain(two(values).filter(few), zeros, two(frame), two(shifted).filter(few), scenario=["tier"])["concordance"].collect()
    first = {r["taxon"]: r.asDict() for r in got if r["tier"] == 1}
    assert {t: {k: v for k, v in r.items() if k != "tier"} for t, r in first.items()}.keys() == in_all.keys()
    for t, r in first.items():
        assert r["meta_effect"] == pytest.approx(in_all[t]["meta_effect"]) and r["meta_q"] == pytest.approx(in_all[t]["meta_q"]) and r["pooled_q"] == pytest.approx(in_all[t]["pooled_q"])
    assert {r["taxon"] for r in got if r["tier"] == 2} == {t for t in in_all if t < "t06"}


def test_transform_sensitivity(spark, shifted):
    frame = shifted.select("sample", "project", "disease_category", "y").distinct()
    both = shifted.select("sample", "taxon", "v", F.explode(F.array(F.lit("one"), F.lit("two"))).alias("transform")).withColumn("v", F.when(F.col("transform") == "two", 3 * F.col("v")).otherwise(F.col("v")))
    zeros = both.select("sample", "transform").distinct().withColumn("zero", F.lit(0.0))
    r = V.transform_sensitivity(both, zeros, frame, "one", "two").first()
    assert r["n_taxa"] == 12 and r["hits_a"] == r["hits_b"] == r["hits_shared"] > 0 and r["effect_rho"] == pytest.approx(1.0)
