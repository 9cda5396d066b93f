"""Source divergence against brute force on small tables with every oddity."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compostat.llm import divergence


def brute(rows, min_docs, most=50):
    """Rows ``(lang, source, part, item, value, rank)`` of ``(lang, source, text)``."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        share = {}
        for source in [s for g, s in groups if g == lang] + [None]:
            c = Counter() if source is None else groups[lang, source]
            if source is None:
                for (g, _), x in groups.items():
                    c.update(x if g == lang else {})
            n = sum(c[t] for t in kept)
            share[source] = {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for source in [s for g, s in groups if g == lang]:
            mine = share[source]
            pairs = [(sum(abs(mine[t] - share[o][t]) for t in kept), o) for g, o in groups if g == lang and o != source]
            terms = [(mine[t] - share[None][t], t) for t in kept if groups[lang, source][t] and mine[t] > share[None][t]]
            for part, have, top in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(have, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked[:top])]
    return sorted(out)


def odd_rows():
    rng = random.Random(11)
    words = ["alpha", "BETA", "gamma", "Été", "ÉTÉ", "日本", "x1y", "don't", "_a_", "zulu", "\x80q", "eins", "zwei"]
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(9)}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for _ in range(400)]
    rows += [(None, None, "alpha beta"), ("", "", "alpha"), ("fr", "a", None), ("fr", "b", ""), ("fr", "c", "12 34"), ("en", "empty", None), ("en", None, "alpha " * 5000)]
    return rows + rows[:40]


def got(df, **kw):
    return sorted(map(tuple, divergence.report(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("groups", "terms", "min_docs"), [(16, 4096, 30), (2, 3, 5), (1, 1, 1), (3, 2, 100_000)])
def test_against_brute_force(spark, groups, terms, min_docs):
    df = spark.createDataFrame([(*r, 1, "clash") for r in odd_rows()], "lang string, source string, text string, n int, term string").repartition(5)
    assert got(df, block_groups=groups, block_terms=terms, min_docs=min_docs) == brute(odd_rows(), min_docs)


def test_counts_are_given_on_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 7)
    df = spark.createDataFrame(odd_rows(), "lang string, source string, text string").repartition(2)
    assert got(df, min_docs=3, most=2) == brute(odd_rows(), 3, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert got(df) == []
    alone = spark.createDataFrame([("en", "s", "a b")], "lang string, source string, text string")
    assert got(alone, min_docs=1) == []


def test_counts_are_shuffled_once(spark):
    df = spark.createDataFrame(odd_rows(), "lang string, source string, text string").repartition(2)
    plan = divergence.kept_terms(divergence.term_counts(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_interleaved_groups_give_each_term_once():
    """Many more counts than are held, but no group has so many: a row each."""
    rows = [("en", f"s{k % 7}", f"word{chr(97 + k % 5)} term{chr(97 + k % 3)}".encode()) for k in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50], strict=True)], ["lang", "source", "text"]) for k in range(0, 400, 50)]
    out = [tuple(r.values()) for b in divergence.count_batches(iter(batches), 20, 1 << 20) for r in b.to_pylist()]
    whole = Counter((lang, source, t) for lang, source, text in rows for t in text.decode().split())
    assert sorted(out) == sorted((*k, n, n) for k, n in whole.items())
    assert len(out) > 20


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([("en", "s", "a")], "lang string, source string, text string")
    audit = divergence.Audit(df, min_docs=1)
    limit = (2**63 - 1) // audit.scale - audit.alpha
    cases = [(n, total, v) for n in (0, 1, limit - 1, limit, limit + 1, 10**17) for total in (n, n + 7, 3 * n + 11) for v in (1, 1000)]
    at = spark.createDataFrame(cases, "n bigint, total bigint, v bigint")
    got = at.select("n", "total", "v", audit.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert sorted(map(tuple, got)) == sorted((n, total, v, 1 + audit.scale * (n + 5) // (total + 5 * v)) for n, total, v in cases)
