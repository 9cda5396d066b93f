"""Benchmark decontamination by a prefix-filtered containment join.

Every window of ``window`` consecutive words of a benchmark item (a shorter item is
one window) is a record whose tokens are its word shingles.  Containment needs every
token of a record, so the prefix that has to be joined is its single rarest token:

1. document frequencies of all benchmark shingles are counted over all documents;
2. each record is filed under its rarest shingle with that shingle's position;
3. a document looks up its own shingles; a match fixes where the record would have
   to lie (positional bound) and whether the document is long enough around it
   (length bound);
4. what is left is verified word by word over the whole window.

The benchmark side is sent out in blocks of at most ``block_records`` records, so
what is broadcast has a bound; hits of several blocks are merged per document.

Defined cases: null and empty texts have no word and hit nothing, items without a
word have no window; repeated items or equal items with different ids all count;
repeated or null document ids give one row each; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes, written

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
#: Bytes of a text whose words are held at once.
_SLICE = 1 << 20


def words_of(data: bytes) -> list[bytes]:
    """Runs of ASCII digits, letters in ASCII lower case and anything outside ASCII."""
    return _WORD.findall(data.lower())


def word_slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    at = 0
    while at < len(data):
        cut = _SEPARATOR.search(data, min(len(data), at + _SLICE))
        to = cut.start() if cut else len(data)
        yield words_of(data[at:to])
        at = to


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def shingles_of(record: tuple[bytes, ...], width: int) -> list[tuple[bytes, ...]]:
    return [record[i : i + width] for i in range(max(1, len(record) - width + 1))]


def runs_of(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    """All shingles of ``width`` words, in order."""
    return zip(*(words[k:] for k in range(width)), strict=False)


class Records:
    """Records filed under their rarest shingle."""

    def __init__(self, records: dict[tuple[bytes, ...], list[str]], width: int, frequency: dict[tuple[bytes, ...], int]):
        self.filed: dict[int, dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], list[str]]]]] = {}
        self.longest = max(map(len, records), default=1)
        for record, items in records.items():
            tokens = shingles_of(record, width)
            # Rarity first; ties by text, then by place, so that the order is one for all records.
            at = min(range(len(tokens)), key=lambda i: (frequency.get(tokens[i], 0), tokens[i], i))
            self.filed.setdefault(len(tokens[at]), {}).setdefault(tokens[at], []).append((at, record, items))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(from, to) word ranges of all occurrences, and the items they belong to."""
        spans, items, n = [], set(), len(words)
        for width, filed in self.filed.items():
            for i in [i for i, token in enumerate(runs_of(words, width)) if token in filed]:
                for at, record, owners in filed[tuple(words[i : i + width])]:
                    start, to = i - at, i - at + len(record)
                    if start >= 0 and to <= n and tuple(words[start:to]) == record:
                        spans.append((start, to))
                        items.update(owners)
        return spans, items

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, and the hits, of a whole text."""
        total, spans, items, carry = 0, [], set(), []
        for part in word_slices(data):
            words, base = carry + part, total - len(carry)
            more, owners = self.hits(words)
            spans += [(base + a, base + b) for a, b in more]
            items |= owners
            total += len(part)
            carry = words[max(0, len(words) - self.longest + 1) :]
        return total, spans, items


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _records(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_records: int) -> Iterator[dict]:
    """Blocks of records: window -> item ids as strings."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), text_bytes(text_col).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        for record in item_windows(words_of(bytes(r["t"])), window):
            block.setdefault(record, []).append(r["i"] if r["i"] is not None else "null")
        if len(block) >= block_records:
            yield block
            block = {}
    if block:
        yield block


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_records: int = 200_000,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` per row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("__text"))
    id_type = rows.schema["__id"].dataType.simpleString()
    fields = f"__id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    names = ["__id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def finished(ids: pa.Array, found: list[tuple[int, list, set]]) -> pa.RecordBatch:
        out = [(n, _covered(spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(spans)) for n, spans, items in found]
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names)

    blocks = _records(benchmark, item_col, item_text_col, window, block_records)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        shipped = spark.sparkContext.broadcast((first, shingle, _frequencies(rows, first, shingle)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            records = Records(*shipped.value)
            for b in batches:
                yield finished(b.column(0), [records.scan(t.as_py()) for t in b.column(1)])

        return rows.mapInArrow(run, fields).withColumnRenamed("__id", id_col)

    # Several blocks: each block's hits are written, then merged by row.
    partial, keyed = [], rows.withColumn("__row", F.sha2(F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("null")).cast("binary"), F.lit("\u0001").cast("binary"), "__text"), 256))
    for block in itertools.chain([first, second], blocks):
        shipped = spark.sparkContext.broadcast((block, shingle, _frequencies(rows, block, shingle)))

        def part(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            records = Records(*shipped.value)
            for b in batches:
                found = [records.scan(t.as_py()) for t in b.column("__text")]
                made = [pa.array([x[0] for x in found], pa.int64()), pa.array([[list(s) for s in x[1]] for x in found], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__row"), *made], ["__id", "__row", "n", "spans", "items"])

        hits = keyed.mapInArrow(part, f"__id {id_type}, __row string, n bigint, spans array<array<bigint>>, items array<string>")
        partial.append(written(hits.groupBy("__row").agg(F.first("__id").alias("__id"), F.first("n").alias("n"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("copies")), "hits"))
        shipped.unpersist()
    merged = (
        functools.reduce(DataFrame.unionByName, partial)
        .groupBy("__row")
        .agg(F.first("__id").alias("__id"), F.first("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.first("copies").alias("copies"))
        .select("__id", "n", "spans", "items", F.expr("explode(array_repeat(0, cast(copies as int)))").alias("copy"))
        .select("__id", "n", "spans", "items")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finished(b.column(0), [(r["n"], [tuple(s) for s in r["spans"]], set(r["items"])) for r in b.select(["n", "spans", "items"]).to_pylist()])

    return merged.mapInArrow(merge, fields).withColumnRenamed("__id", id_col)


def _frequencies(rows: DataFrame, records: dict, width: int) -> dict[tuple[bytes, ...], int]:
    """In how many documents each shingle of the records occurs; as many numbers as
    the block has shingles come back."""
    names = sorted({s for r in records for s in shingles_of(r, width)})
    if not names:
        return {}
    shipped = rows.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shipped.value
        lengths = sorted({len(s) for s in place})
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                found, carry = set(), []
                for part in word_slices(t.as_py()):
                    words = carry + part
                    for k in lengths:
                        found |= place.keys() & set(runs_of(words, k))
                    carry = words[max(0, len(words) - lengths[-1] + 1) :]
                seen.update(found)
        yield pa.RecordBatch.from_arrays([pa.array([place[s] for s in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    got = rows.select("__text").mapInArrow(count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {names[r["s"]]: r["n"] for r in got}
