"""Window deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compostat.llm import queries as Q
from compostat.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows, window=13):
    """``(id, n_words, n_removed, kept)`` of rows ``(id, text)``."""
    owner, split = {}, [((1 << 63) - 1 if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for key, _, w in split:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            owner[s] = min(owner.get(s, key), key)
    out = []
    for key, i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < key:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = some(70), some(6000)
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t ", "one", some(12), some(13), passage, long, long, "same " * 500, "same " * 300, "x" * 9000, "é\x1cü\x85 　" * 40, "日本語 " * 60])]
    rows += [(100 + k, some(rng.randrange(0, 60)) + " " + passage + " " + some(rng.randrange(0, 60))) for k in range(60)]
    rows += [(200 + k, long[: 9000 + k] + "!" + long[9000 + k :]) for k in range(4)]
    rows += [(6, passage), (6, "other text " + passage), (None, passage), (None, some(40)), (None, None), ((1 << 63) - 1, passage)]
    rng.shuffle(rows)
    return rows


def got(df, **kw):
    done = substrings.clean(df, **kw)
    return sorted(((r["doc_id"], r["__n_words"], r["__n_removed"], r["__kept"]) for r in done.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in odd_rows()], "doc_id bigint, text string, ranges string, __kept int").repartition(3)


@pytest.mark.parametrize(("window", "m"), [(13, 3), (5, 1), (4, 4)])
def test_against_brute_force(docs, window, m):
    assert got(docs, window=window, m=m) == brute(odd_rows(), window)


def test_small_chunks_and_split_minimisers(docs, monkeypatch):
    # The window of a split minimiser travels alone; strings of earlier chunks are remembered.
    monkeypatch.setattr(substrings, "_CHUNK", 300)
    monkeypatch.setattr(substrings, "_ROWS", 50)
    every = []
    for _, t in odd_rows():
        w = (t or "").encode().split()
        if len(w) >= 13:
            every.append(substrings._sliding_min(substrings._sequences(substrings.word_hashes(w)[2], 2), 12) & substrings._BITS)
    hot = np.unique(np.concatenate(every))[::2]
    monkeypatch.setattr(substrings, "split_minimisers", lambda *a: (hot, 0))
    assert got(docs) == brute(odd_rows())


def test_equal_hashes_are_compared_word_for_word(monkeypatch):
    doc, row = np.array([1, 2, 3]), np.array([7, 8, 9])
    at, n = np.array([0, 5, 0], np.int32), np.array([1, 1, 1], np.int32)
    monkeypatch.setattr(substrings, "_sequences", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    found = substrings.bucket_ranges(doc, row, at, n, [b"a b c", b"a b d", b"a b c"], 3)
    assert [x.tolist() for x in found] == [[3], [9], [0], [1]]


def test_split_minimisers_are_found(spark):
    rng = random.Random(5)
    same = " ".join(f"s{k}" for k in range(13))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(12)) + " " + same + " " + " ".join(f"{rng.random()}" for _ in range(12))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sample = substrings._sampled(substrings._rows(df, "doc_id", "text"), 13, 3, 1.0)
    hot, strings = substrings.split_minimisers(sample, 40)
    assert 0 < len(hot) <= 80 and strings == sample.count()
    # Enough strings to train a dictionary on.
    assert substrings.trained(sample, strings).dictionary
    assert got(df) == brute(rows)


def test_classifiers_run_in_the_same_session_after(spark):
    """What a logistic regression scores with holds the session, which must still serialise."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    assert Q.op12_substring_dedup(spark, SF).count() > 0
    rows = spark.createDataFrame([(Vectors.dense(float(k)), k % 2) for k in range(8)], ["features", "label"])
    assert len(LogisticRegression(maxIter=2).fit(rows).transform(rows).select("prediction").collect()) == 8


def test_query_and_empty(spark, docs):
    table = Q.table(spark, SF, "documents")
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute([(r["doc_id"], r["text"]) for r in table.collect()])}
    found = Q.op12_substring_dedup(spark, SF)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == want
    assert sum(g for _, g, _ in want.values()) > 0
    assert substrings.clean(docs.limit(0)).count() == 0
    assert found.filter(F.col("n_removed") > F.col("n_words")).count() == 0
