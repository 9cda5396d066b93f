"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with snippets of its
training texts.  A text's letters are compressed, window by window, with each
dictionary; the language whose dictionary gives the fewest bytes wins.  Every window
goes behind a short lead-in from the dictionary itself, whose size is taken off again:
so the fixed cost of a compressed block is paid, and texts of a few words, which zstandard
would store as they are, are told apart by the same rule.

``margin`` is how many per cent more bytes the runner-up needs.  ``fit`` calibrates
``min_margin`` on training texts that no dictionary holds: it is the cut below which
most answers are wrong (0 if there is none), and rows below it are ``rejected``, as are
texts without a letter.

The model is fitted on a bounded sample, all of which the dictionaries hold: at most
``per_language`` snippets of ``snippet_chars`` characters for each language (64 KB of
characters by default), chosen by a hash of the id from all training rows, and as many
others, of at most ``calibration_chars`` characters, for the calibration.  Every text is
classified whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and
margin 0, and rejected; rows with a null language aren't learned from; with no
training row at all everything is ``und``; ids may be null or repeated; equal texts
get equal answers; of languages that need equally few bytes the first by name is taken,
with margin 0; very long texts are compressed in windows, one slice of 2**20 characters
at a time; an empty table gives an empty one; other columns, whatever their names, are
ignored unless kept by name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zdict import sizer, words_of

_LOADED: dict[str, list] = {}


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: tuple[tuple[str, bytes], ...]
    level: int
    window: int
    lead: int
    #: Margins, in per cent, under which an answer is rejected.
    min_margin: float = 0.0

    @cached_property
    def key(self) -> str:
        return hashlib.sha1(repr((self.dictionaries, self.level, self.lead)).encode()).hexdigest()

    def sizers(self) -> list:
        if self.key not in _LOADED:
            _LOADED[self.key] = [sizer(d, self.level, lead=d[len(d) // 2 :][: self.lead]) for _, d in self.dictionaries]
        return _LOADED[self.key]

    def sizes(self, text: str) -> tuple[list[int], int]:
        """Compressed bytes of the whole text by language, and the number of windows."""
        sizers, windows = self.sizers(), 0
        totals = [0] * len(sizers)
        for words in words_of(text):
            data = b" ".join(words)
            parts = [b" " + data[at : at + self.window] for at in range(0, len(data), self.window)]
            windows += len(parts)
            # Language by language, so that one dictionary at a time fills the cache.
            for k, size in enumerate(sizers):
                totals[k] += sum(map(size, parts))
        return totals, windows

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language or ``und``, score, margin in per cent)."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        totals, windows = self.sizes(text)
        order = sorted(range(len(totals)), key=lambda k: (totals[k], k))
        best = totals[order[0]]
        if len(order) == 1:
            return self.dictionaries[0][0], 1.0, 100.0
        scale = 2.0 * math.sqrt(max(1, windows))
        score = 1.0 / sum(math.exp(-min(700.0, (t - best) / scale)) for t in totals)
        return self.dictionaries[order[0]][0], score, 100.0 * (totals[order[1]] - best) / max(1, best)


def wrong_below(answers: list[tuple[float, bool]]) -> float:
    """The cut that leaves the most wrong answers less right ones below it; 0 where no cut
    leaves more wrong than right ones."""
    best, cut, ahead = 0, 0.0, 0
    answers = sorted(answers)
    for k, (margin, right) in enumerate(answers):
        ahead += -1 if right else 1
        upper = answers[k + 1][0] if k + 1 < len(answers) else math.nextafter(margin, math.inf)
        if ahead > best and upper > margin:
            best, cut = ahead, upper
    return cut


def fit(
    train: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key: Column | None = None,
    per_language: int = 256,
    snippet_chars: int = 256,
    calibration_chars: int = 2400,
    level: int = 12,
    window: int = 512,
    lead: int = 64,
    max_languages: int = 200,
) -> LanguageModel:
    """Fit on ``train``; ``key`` orders the sample (default: a hash of the text)."""
    rows = train.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.abs(F.xxhash64(F.lit("sample"), key if key is not None else F.col(text_col)) % 2**40).alias("h")
    ).filter("lang IS NOT NULL AND t IS NOT NULL AND t != ''")
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not counts:
        return LanguageModel((), level, window, lead)
    spark = train.sparkSession
    # A share of each language that leaves about 6 x per_language rows, whatever its size.
    shares = spark.createDataFrame([(r["lang"], int(2**40 * min(1.0, 6.0 * per_language / r["count"]))) for r in counts], "lang string, upto bigint")
    piece = lambda chars: F.expr(f"substring(t, cast(1 + h % greatest(1, char_length(t) - {chars} + 1) as int), {chars})")
    drawn = (
        rows.join(F.broadcast(shares), "lang")
        .filter("h <= upto")
        .select("lang", "h", piece(snippet_chars).alias("snippet"), piece(calibration_chars).alias("longer"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "longer")))
        .filter(F.col("n") <= 2 * per_language)
        .select("lang", "n", F.when(F.col("n") <= per_language, F.col("snippet")).otherwise(F.col("longer")).alias("t"))
        .orderBy("lang", "n")
        .collect()
    )
    content: dict[str, list[bytes]] = {r["lang"]: [] for r in drawn}
    for r in drawn:
        if r["n"] <= per_language:
            content[r["lang"]].append(b" ".join(w for ws in words_of(r["t"]) for w in ws))
    model = LanguageModel(tuple((lang, b" ".join(parts)) for lang, parts in sorted(content.items())), level, window, lead)
    unseen = [(r["lang"], r["t"]) for r in drawn if r["n"] > per_language]
    if not unseen:
        return model
    tried = identify(spark.createDataFrame(unseen, "lang string, t string"), model, "lang", "t").filter("lang_pred != 'und'")
    return replace(model, min_margin=wrong_below([(r["margin"], r["lang_pred"] == r["lang"]) for r in tried.collect()]))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, lang_pred, score, margin, rejected)`` per row; margins under
    ``min_margin`` (default: the model's own) are rejected."""
    least = model.min_margin if min_margin is None else min_margin
    carries_text = text_col in (keep or [])
    kept = [c for c in keep or [] if c != text_col]
    rows = df.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)), F.col(text_col).cast("string").alias("__text"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            out = [m.classify(t.as_py()) for t in b.column("__text")]
            names = [n for n in b.schema.names if n != "__text" or carries_text]
            made = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, "__lang", "__score", "__margin"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text" or carries_text)
    found = rows.mapInArrow(run, f"{schema}, __lang string, __score double, __margin double")
    return found.select(
        F.col("__id").alias(id_col), *(F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)), *[F.col("__text").alias(text_col)] * carries_text,
        F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__margin").alias("margin"), ((F.col("__lang") == "und") | (F.col("__margin") < least)).alias("rejected"),
    )
