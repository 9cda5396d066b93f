"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each by zstandard's own trainer: one on ordinary
text, one on toxic text.  A window of words is compressed knowing ordinary text alone,
and knowing ordinary and toxic text; what the toxic dictionary saves is the window's
compression distance.  (In place of the toxic dictionary the first has as many bytes 0,
so that everything else lies equally far back and costs the same.)

The toxic dictionary is trained on what recurs in toxic text and not in ordinary text:
words of at least ``least_share`` of the toxic excerpts that are ``contrast`` times as
frequent there as in ordinary ones, excerpt by excerpt.  Trained on whole toxic texts it
holds mostly ordinary words, and the noise of two dictionaries that fit them by chance
differently is larger than what a few toxic words save (figures in the README).

Thresholds are calibrated on halves of the sample that the dictionaries weren't trained
on: the number of bytes from which a window counts is the one whose share of windows
tells the texts apart best (area under the curve), a logistic curve goes over that share
and the number and strength of such windows, and its middle is moved to the cut with the
best F1.5 (recall weighs more than precision) at the labelled rows' own odds.  Windows are counted where they lie, over whole
texts.

The sample is bounded: at most ``max_toxic`` toxic and ``max_ordinary`` ordinary
excerpts of ``excerpt_chars`` characters, chosen by a hash of the key from all
labelled rows given, and all of it is used.  Dictionaries have at most
``ordinary_bytes`` and ``toxic_bytes``.  Every text is scored whole.

Defined cases: null and empty texts have no window and score as zero saving; rows
with a null label or a null key aren't learned from; without labels of both kinds every
score is the share of label 1 (0 without any label); without recurring toxic words every
score is the curve's value at zero; equal texts get equal scores, and null or repeated
ids one row each; very long texts are scored in windows, one slice of 2**20 characters at a
time; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .zdict import sizer, trained, words_of

_LOADED: dict[str, tuple] = {}
#: Savings are counted by byte up to this many.
_MOST = 8


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    level: int
    min_match: int
    window_words: int
    prior: float
    #: Bytes that a window must save to count.
    least_saving: int = 1
    weights: tuple[float, ...] = ()

    @cached_property
    def key(self) -> str:
        return hashlib.sha1(self.ordinary + b"|" + self.toxic + repr((self.level, self.min_match)).encode()).hexdigest()

    def sizers(self) -> tuple:
        if self.key not in _LOADED:
            _LOADED[self.key] = sizer(self.ordinary + bytes(len(self.toxic)), self.level, self.min_match), sizer(self.ordinary + self.toxic, self.level, self.min_match)
        return _LOADED[self.key]

    def savings(self, text: str | None) -> list[int]:
        """How many windows save 0 bytes or less, 1, 2, ... or at least ``_MOST`` bytes."""
        alone, both = self.sizers()
        counts = [0] * (_MOST + 1)
        for words in words_of(text or ""):
            for at in range(0, len(words), self.window_words):
                window = b" " + b" ".join(words[at : at + self.window_words]) + b" "
                counts[min(max(alone(window) - both(window), 0), _MOST)] += 1
        return counts

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        x = features(np.array([self.savings(text)]), self.least_saving)[0]
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x.tolist(), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def features(savings: np.ndarray, least: int) -> np.ndarray:
    """Share of windows that count, their number, and how many save two bytes more."""
    count = savings[:, least:].sum(axis=1)
    strong = savings[:, min(least + 2, _MOST) :].sum(axis=1)
    return np.column_stack([np.sqrt(count / np.maximum(1, savings.sum(axis=1))), np.minimum(np.log1p(count), 4.0), np.minimum(np.log1p(strong), 4.0)])


def area_under_curve(scores: np.ndarray, toxic: np.ndarray) -> float:
    """Ties count a half."""
    both = np.sort(scores[~toxic])
    below = np.searchsorted(both, scores[toxic], "left") + np.searchsorted(both, scores[toxic], "right")
    return float(below.mean() / (2 * max(1, len(both))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray, beta: float = 1.5) -> float:
    """The value from which calling a text toxic has the best F-beta, halfway to the next lower one."""
    order = np.argsort(-z, kind="stable")
    z, hit, miss = z[order], np.cumsum((weight * toxic)[order]), np.cumsum((weight * ~toxic)[order])
    ends = np.flatnonzero(np.append(z[:-1] != z[1:], True))
    k = ends[np.argmax(hit[ends] / (hit[ends] + miss[ends] + beta**2 * hit[-1]))]
    return float(z[k] if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def _windows(words: list[bytes], n: int) -> list[bytes]:
    return [b" " + b" ".join(words[at : at + n]) + b" " for at in range(0, len(words), n)]


def fit(
    labelled: DataFrame,
    labels: DataFrame | None = None,
    key_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = 1200,
    max_ordinary: int = 2400,
    excerpt_chars: int = 2400,
    contrast: float = 20.0,
    least_share: float = 0.01,
    ordinary_bytes: int = 98_304,
    toxic_bytes: int = 1536,
    level: int = 12,
    min_match: int = 5,
    window_words: int = 8,
) -> ToxicityModel:
    """Fit on rows of ``labelled``; their labels are a column of it or, by key, the table
    ``labels``."""
    texts = labelled.select(F.col(key_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    marks = (labels if labels is not None else labelled).select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    # Only keys and hashes are joined and ordered; texts are fetched for the sample alone.
    order = F.abs(F.xxhash64(F.lit("sample"), "k") % 2**40)
    # A key counts once for a label, however often it stands in either table.
    rows = marks.distinct().join(texts.select("k").distinct(), "k").select("k", "y", order.alias("h"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    drawn = []
    for y, most in ((1, max_toxic), (0, max_ordinary)):
        upto = int(2**40 * min(1.0, 3.0 * most / max(1, counts.get(y, 0))))  # leaves about three times the sample
        drawn += rows.filter((F.col("y") == y) & (F.col("h") <= upto)).orderBy("h", "k").limit(most).collect()
    sample: dict[int, list[str]] = {0: [], 1: []}
    spark = labelled.sparkSession
    if drawn:
        wanted = F.broadcast(spark.createDataFrame([tuple(r) for r in drawn], rows.schema))
        place = f"cast(1 + h % greatest(1, coalesce(char_length(t), 0) - {excerpt_chars} + 1) as int)"
        # Of the texts of one key the least excerpt: a row for each key drawn, at most.
        found = texts.join(wanted, "k").groupBy("k", "y", "h").agg(F.min(F.expr(f"coalesce(substring(t, {place}, {excerpt_chars}), '')")).alias("x")).select("y", "h", "x")
        for r in sorted(found.collect(), key=lambda r: (r["h"], r["x"])):
            sample[r["y"]].append(r["x"])
    n1, n0 = len(sample[1]), len(sample[0])
    if any(counts.get(y) and not sample[y] for y in (0, 1)):
        raise RuntimeError("a label has texts of which none was drawn")
    if not n1 or not n0:
        return ToxicityModel(b"", b"", level, min_match, window_words, counts.get(1, 0) / max(1, sum(counts.values())))
    words = {y: [[w for ws in words_of(t) for w in ws] for t in sample[y]] for y in (0, 1)}

    def build(chosen: dict[int, list[int]]) -> ToxicityModel:
        seen = {y: Counter(w for i in chosen[y] for w in set(words[y][i])) for y in (0, 1)}
        m1, m0 = len(chosen[1]), max(1, len(chosen[0]))
        least = max(4, math.ceil(least_share * m1))
        recurs = {w for w, c in seen[1].items() if c >= least and seen[0][w] * m1 * contrast <= c * m0}
        toxic = [b" " + b" ".join(found) + b" " for i in chosen[1] if (found := [w for w in words[1][i] if w in recurs])]
        plain = [w for i in chosen[0] for w in _windows(words[0][i], window_words)]
        return ToxicityModel(trained(plain, ordinary_bytes, level), trained(toxic, toxic_bytes, level) if toxic else b"", level, min_match, window_words, counts[1] / sum(counts.values()))

    # Each half is measured by dictionaries trained on the other.
    halves = [build({y: [i for i in range(len(words[y])) if i % 2 != part or len(words[y]) < 2] for y in words}) for part in (0, 1)]
    shipped = spark.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shipped.value[p].savings(t) for p, t in zip(b.column("part").to_pylist(), b.column("t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(got, pa.list_(pa.int64()))], ["y", "savings"])

    excerpts = [(y, i % 2, t) for y in (0, 1) for i, t in enumerate(sample[y])]
    tries = spark.createDataFrame(excerpts, "y int, part int, t string").repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(measure, "y int, savings array<bigint>").collect()
    savings, toxic = np.array([r["savings"] for r in tries]), np.array([r["y"] == 1 for r in tries])
    shipped.unpersist()
    least = max(range(1, _MOST - 1), key=lambda k: (area_under_curve(features(savings, k)[:, 0], toxic), -k))
    x = features(savings, least)
    # The order of rows that come back isn't fixed; sums over them shall be.
    by = np.lexsort([*x.T, toxic])
    x, toxic = x[by], toxic[by]
    weights = _logistic(x, toxic.astype(float))
    weight = np.where(toxic, counts[1] / n1, counts[0] / n0)
    weights[0] -= best_cut(weights[0] + x @ weights[1:], toxic, weight)
    model = build({y: list(range(len(words[y]))) for y in words})
    return replace(model, least_saving=least, weights=tuple(weights.tolist()))


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score double, predicted int)`` per row."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            scores = [m.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["__id", "score"])

    found = rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, score double")
    return found.select(F.col("__id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
