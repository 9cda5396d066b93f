"""The pivot index against all distances."""

import numpy as np
import pytest

from compostat.operators import graphs as G
from compostat.operators import neighbours as N


def points(seed, n=400, dim=6, clusters=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 4, (clusters, dim))[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dim))
    x[: n // 3] = x[0]  # a third are one vector
    x[n // 3 : n // 3 + 9] = np.round(x[n // 3])
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def brute(rows, k):
    x = np.array([v for _, v in rows])
    out = []
    for i, u in enumerate(x):
        d = np.sqrt(((x - u) ** 2).sum(axis=1))
        order = [j for j in sorted(range(len(x)), key=lambda j: (round(d[j], 9), j)) if j != i][:k]
        out += [(i, j, round(d[j], 9), p + 1) for p, j in enumerate(order)]
    return sorted(out)


def got(df):
    return sorted((r["src"], r["dst"], round(r["dist"], 9), r["place"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "k", "pivots", "block"), [(0, 5, None, 4096), (1, 3, 40, 16), (2, 10, 1, 50)])
def test_exact_search_equals_all_distances(spark, seed, k, pivots, block):
    rows = points(seed)
    df = spark.createDataFrame(rows, "sample bigint, vec array<double>").repartition(3)
    index = N.PivotIndex(df, k=k, pivots=pivots, block=block)
    assert got(index.nearest()) == brute(rows, k)
    assert got(G.knn(df, k)) == brute(rows, k)
    if k == 3:
        assert got(G.knn(df, k, all_pairs=10)) == brute(rows, k)


def test_recall_and_bounded_candidates(spark):
    rows = points(4, n=900, dim=8, clusters=30)
    index = N.PivotIndex(spark.createDataFrame(rows, "sample bigint, vec array<double>"), k=10)
    exact = index.nearest()
    (r,) = N.recall(index.nearest(probes=4), exact).collect()
    assert r["recall"] >= 0.9 and r["n"] == 9000
    assert N.recall(exact, exact).first()["recall"] == 1.0
    (some,), (all_,) = index.candidates(4).collect(), index.candidates().collect()
    assert some["most"] <= sorted(index.size)[-1] * 12 and some["mean"] < all_["n"] / 3
    assert all_["mean"] < all_["n"]


def test_few_rows_and_none(spark):
    kind = "sample string, vec array<double>"
    few = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None)], kind)
    found = [(r["src"], r["dst"], r["dist"]) for r in N.PivotIndex(few, k=5).nearest().orderBy("src", "place").collect()]
    assert found == [("a", "b", 0.0), ("a", "c", 1.0), ("b", "a", 0.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "b", 1.0)]
    assert N.PivotIndex(few.limit(0), k=5).nearest().count() == 0
    assert N.PivotIndex(few.limit(1), k=5).nearest().count() == 0


def test_exact_search_copies_no_query_for_every_cell(spark, monkeypatch):
    # Without clusters the bounds rule out few cells: an exact search then looks at nearly all pairs.
    x = np.random.default_rng(5).normal(0, 1, (600, 32))
    x[100:140] = np.round(x[100:140])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    asked, search = [], N.PivotIndex._search
    monkeypatch.setattr(N.PivotIndex, "_search", lambda self, requests: (asked.append(requests.count()), search(self, requests))[1])
    monkeypatch.setattr(N, "_BLOCKS", 2)
    index = N.PivotIndex(spark.createDataFrame(rows, "sample bigint, vec array<double>"), k=4, block=64)
    assert got(index.nearest()) == brute(rows, 4)
    assert sum(asked) <= 2 * len(rows)
