"""Audit of how sources of a language diverge in their use of terms.

Terms are runs of letters (anything but ASCII non-letters), A-Z lower-cased.  A language
keeps its ``V`` terms that at least ``min_docs`` of its documents have.  Every (language,
source) group, and every language, gives a kept term with ``count`` occurrences there the
share ``p = 1 + floor(scale * (count + alpha) / (N + alpha * V))``, ``N`` being the sum of
count over kept terms.  All of it is whole numbers.

The distance of two groups is the sum of ``abs(p - q)`` over all kept terms.  It is taken
by cube partitioning: a task owns a cell (group block, group block, term block) of one
language, holds the two blocks' slices of the shares (each slice is replicated to the cells
that need it), and gives the cell's partial sums; these are added up along the term axis.
Term blocks are by hash and as many as the language's kept terms need, so that a cell has a
bounded number of shares at any size.  A cell sums over terms that occur in it and subtracts
what absent terms would give, so that terms absent from both groups cost nothing anywhere:
they are one product per pair of groups.

Counts are summed in the map tasks, group by group, before the only shuffle of them; no
language, source or term is one task's work.

Defined cases: a null text, language or source is the empty string; an empty text has no
term; a group without kept terms has no occurrences (all its shares are equal); a language
without kept terms has distances of 0; repeated rows count each time; very long texts are
read whole; an empty table gives an empty one; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_bytes, written

#: ASCII letters as lower case, everything else of ASCII as a blank.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Distinct counts that a map task holds before it gives them on.
_HELD = 200_000
#: Bytes of rows that a map task gathers, to count each group of them as a whole.
_GATHERED = 32 << 20
_PAIR_KEY = ["lang", "source", "other"]


def group_counts(rows: pa.Table, held: int) -> Iterator[tuple[str, str, Counter, Counter]]:
    """``(lang, source, occurrences, documents)`` of the terms of each group; a group's rows are
    counted together, and again from nothing after ``held`` terms."""
    groups: dict = {}
    for k, group in enumerate(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)):
        groups.setdefault(group, []).append(k)
    texts = list(rows.column("text"))
    for group, own in groups.items():
        counts, docs = Counter(), Counter()
        for k in own:
            words = texts[k].as_py().translate(_LETTERS).split(b" ")
            counts.update(words)
            docs.update(set(words))
            if len(counts) >= held:
                yield *group, counts, docs
                counts, docs = Counter(), Counter()
        yield *group, counts, docs


def count_batches(batches: Iterator[pa.RecordBatch], held: int, gathered: int) -> Iterator[pa.RecordBatch]:
    """Batches ``lang, source, term, n, docs`` from batches ``lang, source, text`` (bytes)."""

    def gather() -> Iterator[pa.Table]:
        some, size = [], 0
        for b in batches:
            some.append(b)
            size += b.nbytes
            if size >= gathered:
                yield pa.Table.from_batches(some)
                some, size = [], 0
        if some:
            yield pa.Table.from_batches(some)

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        lang, source, terms, n, docs = zip(*parts, strict=True)
        each = np.repeat(np.arange(len(parts)), [len(t) for t in terms])
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()).take(pa.array(each)), pa.array(source, pa.string()).take(pa.array(each)), pa.concat_arrays(terms), pa.array(np.concatenate(n)), pa.array(np.concatenate(docs))], ["lang", "source", "term", "n", "docs"])

    for rows in gather():
        parts, size = [], 0
        for lang, source, counts, docs in group_counts(rows, held):
            del counts[b""]
            if not counts:
                continue
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            parts.append((lang, source, terms, np.fromiter(counts.values(), np.int64, len(counts)), np.fromiter(map(docs.__getitem__, counts), np.int64, len(counts))))
            size += len(counts)
            if size >= held:
                yield batch(parts)
                parts, size = [], 0
        if parts:
            yield batch(parts)


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term per group.  Map
    tasks have summed them already; their rows are dealt by term and language, for this sum and
    for ``kept_terms``."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))), text_bytes(text_col).alias("text"))
    held, gathered = _HELD, _GATHERED
    raw = rows.mapInArrow(lambda batches: count_batches(batches, held, gathered), "lang string, source string, term string, n bigint, docs bigint")
    return raw.repartition("term", "lang").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = 30) -> DataFrame:
    """``(lang, source, term, n, n_lang)`` of the terms that the language keeps; ``first`` marks
    one row of each (language, term).  A window's partition has a row for each source; it is
    sorted by term first, as few languages tell rows apart."""
    over = Window.partitionBy("term", "lang")
    whole = counts.withColumns({"__docs": F.sum("docs").over(over), "n_lang": F.sum("n").over(over), "__least": F.min("source").over(over)})
    return whole.filter(F.col("__docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("__least")).alias("first"))


def floor_div(top: Column, low: Column) -> Column:
    """Whole quotient of two non-negative whole numbers or decimals as a bigint."""
    return F.call_function("div", top, low)


class Audit:
    """The tables that both parts read: kept terms, language and group totals."""

    def __init__(self, df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, scale: int = 1_000_000_000, alpha: int = 5):
        self.scale, self.alpha = scale, alpha
        self.kept = written(kept_terms(term_counts(df, text_col, lang_col, source_col), min_docs), "kept-terms")
        groups = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source")))).distinct()
        langs = self.kept.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # Sources of a language are numbered by a window over its groups: a row a source.
        at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        zero = F.lit(0).cast("bigint")
        whole = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", at.alias("g"), *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "total_lang")))
        self.groups = written(whole.withColumn("p0", self.share(zero, F.col("total"), F.col("v"))), "audit-groups")

    def share(self, count: Column, total: Column, terms: Column) -> Column:
        """A share in whole numbers, below ``scale + 2``; where the product passes 64 bits, 38
        digits hold it.  A language without kept terms has none (null)."""
        top, low = count + F.lit(self.alpha), total + F.lit(self.alpha) * terms
        wide = floor_div(top.cast("decimal(20,0)") * F.lit(self.scale).cast("decimal(12,0)"), low.cast("decimal(20,0)"))
        short = floor_div(top * F.lit(self.scale), low)
        return F.when(terms > 0, F.lit(1) + F.when(top <= (2**63 - 1) // self.scale, short).otherwise(wide))

    def shares(self) -> DataFrame:
        """``(lang, source, g, term, p, q, v, p0)``: the group's and the language's share of each
        kept term that the group has."""
        met = self.kept.join(self.groups, ["lang", "source"])
        return met.select("lang", "source", "g", "term", self.share(F.col("n"), F.col("total"), F.col("v")).alias("p"), self.share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"), "v", "p0")


def cell_partials(a: dict, b: dict) -> Iterator[tuple[int, int, int]]:
    """``(g, h, partial)``, g < h, of a cell: group number -> (share of an absent term, terms,
    shares) for its two blocks.  ``partial`` is the sum, over terms that occur in the cell,
    of ``abs(p - q)`` less what the two absent shares would give."""
    numbers = sorted({*a, *b})
    both = {**a, **b}
    if not numbers:
        return
    terms = np.unique(np.concatenate([both[g][1] for g in numbers]))
    table = np.empty((len(numbers), len(terms)), np.int64)
    for k, g in enumerate(numbers):
        p0, own, p = both[g]
        table[k] = p0
        table[k, np.searchsorted(terms, own)] = p
    absent = np.array([both[g][0] for g in numbers])
    for k, g in enumerate(numbers):
        if g not in a:
            continue
        sums = np.abs(table - table[k]).sum(axis=1) - np.abs(absent - absent[k]) * len(terms)
        for j, h in enumerate(numbers):
            if h > g and h in b and sums[j]:
                yield g, h, int(sums[j])


def pair_divergences(audit: Audit, block_groups: int = 16, block_terms: int = 4096) -> DataFrame:
    """``(lang, source, other, value)`` for every ordered pair of sources of a language."""
    groups, shares = audit.groups, audit.shares()
    per_lang = F.max("g").over(Window.partitionBy("lang"))
    blocks = groups.select("lang", "source", "g", "p0", "v", F.floor(F.col("g") / block_groups).cast("int").alias("gb"), F.floor(per_lang / block_groups).cast("int").alias("last"), F.ceil(F.col("v") / block_terms).cast("int").alias("k"))
    # A block's slice goes to the cells of all its partners, on the side it stands there.
    partners = F.expr("transform(sequence(0, last), o -> struct(least(gb, o) AS i, greatest(gb, o) AS j))")
    cells = blocks.filter("k > 0").select("lang", "g", "gb", "p0", "k", F.explode(partners).alias("c")).select("lang", "g", "gb", "p0", "k", "c.i", "c.j")
    dealt = shares.select("lang", "g", "term", "p", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / block_terms)).cast("int").alias("tb"))
    values = dealt.join(cells.select("lang", "g", "gb", "i", "j"), ["lang", "g"]).select("lang", "i", "j", "tb", "gb", "g", "term", "p")
    meta = cells.select("lang", "i", "j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("tb"), "gb", "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))

    def run(key, t):
        gb, g, p = (t.column(c).to_numpy() for c in ("gb", "g", "p"))
        coded = t.column("term").combine_chunks().dictionary_encode().indices
        named, term = np.asarray(coded.is_valid()), coded.fill_null(0).to_numpy()
        sides: tuple[dict, dict] = ({}, {})
        for n in np.flatnonzero(~named):
            own = np.flatnonzero(named & (g == g[n]))
            row = (int(p[n]), term[own], p[own])
            for side, block in zip(sides, key[1:3], strict=True):
                if gb[n] == block.as_py():
                    side[int(g[n])] = row
        found = list(zip(*cell_partials(*sides), strict=True)) or [()] * 3
        n = len(found[0])
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), *(pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int32(), pa.int64()), strict=True))], ["lang", "g", "h", "partial"])

    partial = values.unionByName(meta).groupBy("lang", "i", "j", "tb").applyInArrow(run, "lang string, g int, h int, partial bigint")
    along = partial.groupBy("lang", "g", "h").agg(F.sum("partial").alias("partial"))
    both = along.select("lang", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("e"), "partial").select("lang", "e.g", "e.h", "partial")
    left, right = groups.select("lang", "g", "source", "p0", "v"), groups.select("lang", F.col("g").alias("h"), F.col("source").alias("other"), F.col("p0").alias("q0"))
    every = left.join(right, "lang").filter("g != h").join(both, ["lang", "g", "h"], "left")
    base = F.coalesce(F.abs(F.col("p0") - F.col("q0")) * F.col("v"), F.lit(0))
    return every.select(*_PAIR_KEY, (base + F.coalesce("partial", F.lit(0))).cast("bigint").alias("value"))


def rising_terms(audit: Audit, most: int = 50) -> DataFrame:
    """``(lang, source, term, value, rank)``: the terms that a group has above its language's share,
    the ``most`` furthest above."""
    above = audit.shares().filter("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return above.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= most)


def report(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, most: int = 50, block_groups: int = 16, block_terms: int = 4096) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` has the other sources by distance, all
    of them; ``term`` the terms furthest above the language's share, ``most`` of them."""
    audit = Audit(df, text_col, lang_col, source_col, min_docs)
    pairs = pair_divergences(audit, block_groups, block_terms).withColumnRenamed("other", "item")
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(over).alias("rank"))
    terms = rising_terms(audit, most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
