"""Queries take whole tables: all taxa, tags and folds; blocks change nothing."""

import duckdb
import pytest

from compostat import catalog
from test_oracles import TABLES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_bray_curtis_in_several_blocks(spark):
    from compostat.operators import compose as C
    from compostat.operators import diversity as B
    from compostat.plans import views as V

    relative = C.relative_abundance(V.counts(spark, SF))
    one, many = ({(r["a"], r["b"]): round(r["d"], 9) for r in f.collect()} for f in (B.bray_curtis(relative), B.bray_curtis_blocked(relative, 16)))
    n = relative.select("sample").distinct().count()
    assert one == many and len(many) == n * (n - 1) // 2
    groups = V.samples(spark, SF)
    p, q = B.permanova_pairs(B.bray_curtis(relative), groups.join(relative.select("sample").distinct(), "sample", "left_semi"), "project").first(), B.permanova_bray(relative, groups, "project", 16).first()
    assert p["n"] == q["n"] and p["pseudo_f"] == pytest.approx(q["pseudo_f"]) and p["r2"] == pytest.approx(q["r2"])


@pytest.mark.parametrize("name", ["wilcoxon_p", "ols_contrast_cov", "combat_eb", "mixedlm"])
def test_tests_of_all_taxa(spark, name):
    from compostat.plans import views as V

    want = {r[0] for r in V.counts(spark, SF).select("taxon").distinct().collect()}
    assert {r[0] for r in catalog.QUERIES[name](spark, SF).select("taxon").distinct().collect()} == want


def test_graph_classifier_takes_all_taxa(spark, monkeypatch):
    from compostat.plans import queries_more
    from compostat.plans import views as V

    seen = []
    monkeypatch.setattr(queries_more.M, "graph_cross_validated", lambda edges, *a, f=queries_more.M.graph_cross_validated, **k: seen.append(edges) or f(edges, *a, **k))
    catalog.QUERIES["graph_leakage_cv"](spark, SF)
    assert seen[0].filter("rel = 'abundance'").count() == V.counts(spark, SF).count()


def test_labels_of_all_tags(spark, duck):
    from compostat.plans.views import TAGS

    tags = duck.sql(f"WITH {TAGS} SELECT project, tag, value, count(*) AS n FROM tags WHERE value IS NOT NULL GROUP BY ALL").df()
    word = lambda v, *w: any(x in v.lower() for x in w)
    got = {}
    for r in catalog.QUERIES["subset_sum_labels"](spark, SF).collect():
        got.setdefault((r["project"], r["tag"]), {})[r["value"]] = r["label"]
    for (project, tag), part in tags.groupby(["project", "tag"]):
        n = dict(zip(part["value"], part["n"], strict=True))
        controls, cases = sum(c for v, c in n.items() if word(v, "control", "healthy")), sum(c for v, c in n.items() if word(v, "case", "positive"))
        found = got.pop((project, tag), {})
        assert [sum(n[v] for v, x in found.items() if x == k) for k in ("healthy", "case")] == [controls, cases]
    assert not got
    derived = {(r["project"], r["disease_field"]) for r in catalog.QUERIES["derived_labels"](spark, SF).collect()}
    assert {t for _, t in derived} == set(tags["tag"])


def test_leakage_cv_scores_every_row_in_both_schemes(spark):
    from compostat.plans import views as V

    v, got = V.vectors(spark, SF), catalog.QUERIES["leakage_cv"](spark, SF).collect()
    for scheme, folds in (("random", 3), ("lopo", v.selectExpr("sample % 5").distinct().count())):
        per = [r for r in got if r["cv_scheme"] == scheme]
        assert len(per) == folds and sum(r["n_test"] for r in per) == v.count()


def test_ranks_of_values_that_differ_when_taken_again(spark):
    # A sum of doubles has other last bits in another run: its rows keep their ranks all the same.
    import random

    from pyspark.sql import functions as F

    from compostat.operators import diversity as B

    again = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    df = spark.range(300).select("id", again("id").alias("x"))
    got = B.spearman(df, [("id", "x")]).first()
    assert got["n"] == 300 and got["rho"] == pytest.approx(1)


def test_euclidean_pairs_in_blocks_are_equal_to_the_last_bit(spark):
    import numpy as np

    from compostat.operators import diversity as B

    x = np.random.default_rng(2).normal(size=(70, 33))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(70, None), (71, None)]
    df = spark.createDataFrame(rows, "sample bigint, vec array<double>")
    one, many = ({(r["a"], r["b"]): r["d"] for r in f.collect()} for f in (B.euclidean_pairs(df), B.euclidean_pairs_blocked(df, block=16)))
    assert one == many and len(many) == 72 * 71 // 2
    plan = catalog.QUERIES["aitchison"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_graph_features_are_written_once(spark, monkeypatch):
    from compostat.operators import models as M

    made, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df, name: (made.append(name), cut(df, name))[1])
    got = catalog.QUERIES["graph_leakage_cv"](spark, SF)
    # Whole edges once, and two protocols for each of two folds.
    assert made == ["graph-features"] * 5 and got.count() == 6
