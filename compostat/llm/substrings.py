"""Substring deduplication over windows of words by super-k-mer partitioning.

A window is ``window`` consecutive words.  Its minimiser is the least hash of its
``m``-word sequences.  Consecutive windows that share a minimiser are one super-k-mer:
one packed string (their words joined by a space) that travels once to the bucket of the
minimiser, in place of a string for each window.  Equal windows have equal minimisers, so
each meets its equals in one bucket; there the windows are sorted and compared exactly, and
of each window the smallest document id is its owner.  Words covered by a window that has
a smaller owner than their document go.

* Before the shuffle, a map task keeps of each packed string the rows with its smallest
  document id; where another document has the same string, all its windows have a smaller
  owner, so it is decided at once.  A passage that a third of all documents share reaches
  its bucket about once a map task.
* Packed strings are compressed one by one with a dictionary that zstandard trains on a
  sample of them (20,000 strings of at most 1,024 bytes): they are most of what is moved.
* A minimiser that many *different* strings share (the ends of such a passage) is split:
  its windows travel one by one, to buckets by a hash of the whole window.  Which ones are
  split is found on a sample of the documents and moves rows between buckets only, never a
  result.  By counting they are at most twice as many as shuffle partitions.
* A bucket gives only ranges of words that go; they meet the texts in one join by row.

Defined cases: a null text has no words, an empty one neither; fewer words than a window
are never removed; a null id counts as the largest, 2^63-1; rows with the same id don't
remove one another's words; repeated rows get the same result; very long runs of one window
are cut into strings of at most 64 windows; a text must fit a row; an empty table gives an
empty one; other columns are carried by ``clean`` as they are, whatever their names, but
for ``__kept``, ``__n_words`` and ``__n_removed``, which it replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, settings, shared_path, text_bytes

_LAST = (1 << 63) - 1
_MADE = ("__kept", "__n_words", "__n_removed")
#: Windows of a packed string, at most.
_RUN = 64
#: Bytes of text whose packed strings a map task holds at once, about.
_CHUNK = 4 << 20
#: Strings that repeated in an earlier chunk, remembered by a map task at most.
_REMEMBERED = 100_000
#: Packed strings that a bucket's task compares at once, about.
_ROWS = 20_000
#: Bits of a bucket's number.
_BITS = np.uint64((1 << 40) - 1)
#: Strings a dictionary is trained on at most, their length at most, and the dictionary's.
_TRAINED_ON, _LENGTH, _DICTIONARY = 20_000, 1024, 112_640
_SCHEMA = "b bigint, doc bigint, row int, at int, n int, s binary"
_RANGES = "doc bigint, row int, at int, n int"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by a space, the offset of each, and a 64-bit hash of each."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1)
    starts = ends - lens - 1
    joined = b" ".join(words)
    raw = np.frombuffer(joined + b" ", np.uint8).astype(np.uint64)
    # Position within the word weighs the byte, so that anagrams differ.
    at = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lens + 1)
    sums = np.add.reduceat(_mix((raw + np.uint64(1)) + (at.astype(np.uint64) << np.uint64(8))), starts)
    return joined, starts, _mix(sums)


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k, c in enumerate(_multipliers(n)):
        out += h[k : k + len(out)] * c
    return _mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def super_kmers(words: list[bytes], window: int, m: int, split: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """``(bucket hash, first window, windows, packed string)`` of a text's words; windows
    whose minimiser is in ``split`` (sorted) come one by one, by their own hash."""
    if len(words) < window:
        return
    joined, starts, h = word_hashes(words)
    least = _sliding_min(_sequences(h, m), window - m + 1)
    n = len(least)
    cut = np.ones(n, bool)
    cut[1:] = least[1:] != least[:-1]
    if len(split):
        lone = np.isin(least & _BITS, split)
        if lone.any():
            cut |= lone
            cut[1:] |= lone[:-1]
            least = np.where(lone, _sequences(h, window) ^ np.uint64(1), least)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    if (size > _RUN).any():
        parts = -(-size // _RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + k * _RUN
        size = np.diff(np.append(first, n))
    ends = np.append(starts[1:] - 1, len(joined))
    yield from zip((least[first] & _BITS).tolist(), first.tolist(), size.tolist(), (joined[a:b] for a, b in zip(starts[first].tolist(), ends[first + size + window - 2].tolist(), strict=True)), strict=True)


def _spread(doc: int, row: int) -> int:
    return (doc * 0x9E3779B97F4A7C15 ^ row) & _LAST


class Packing:
    """Compression of short strings; pickled with tasks, opened once in each."""

    def __init__(self, dictionary: bytes = b""):
        self.dictionary = dictionary

    def _options(self) -> dict:
        import zstandard

        return {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}

    def packer(self):
        import zstandard

        return zstandard.ZstdCompressor(level=3, write_content_size=True, write_dict_id=False, **self._options()).compress

    def unpacker(self):
        import zstandard

        return zstandard.ZstdDecompressor(**self._options()).decompress


def _combine(chunk: list, seen: dict[bytes, int], window: int, m: int, split: np.ndarray, pack) -> pa.RecordBatch:
    """The rows of a chunk of (doc, row, words): of each string those with the least id,
    and ranges already decided (null string)."""
    found: dict[bytes, list] = {}
    for doc, row, words in chunk:
        for b, at, n, s in super_kmers(words, window, m, split):
            have = found.get(s)
            if have is None:
                found[s] = [(doc, row, at, n, b)]
            else:
                have.append((doc, row, at, n, b))
    out, gone = [], []
    for s, have in found.items():
        least = min(seen.get(s, _LAST), *(x[0] for x in have))
        if len(have) > 1 or s in seen:
            if len(seen) >= _REMEMBERED:
                seen.clear()
            seen[s] = least
        small = pack(s) if pack else s
        for doc, row, at, n, b in have:
            if doc > least:
                gone.append((doc, row, at, n))
            else:
                out.append((b, doc, row, at, n, small))
    gone.sort()
    for doc, row, at, n in _merged(gone):
        out.append((_spread(doc, row), doc, row, at, n, None))
    cols = list(zip(*out, strict=True)) or [()] * 6
    kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["b", "doc", "row", "at", "n", "s"])


def _merged(ranges: list[tuple]) -> Iterator[tuple]:
    """Sorted ranges of windows, those that touch made one."""
    now = None
    for doc, row, at, n in ranges:
        if now and now[:2] == (doc, row) and at <= now[2] + now[3]:
            now = (doc, row, now[2], max(now[3], at + n - now[2]))
        else:
            if now:
                yield now
            now = (doc, row, at, n)
    if now:
        yield now


def _row(text: Column) -> Column:
    """What tells rows of one id apart: 32 bits of a hash of the text."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_bytes(text_col)
    return df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), _row(text).alias("row"), text.alias("text"))


def _packed(rows: DataFrame, window: int, m: int, split: np.ndarray, packing: Packing | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chunk, held = {}, [], 0
        pack = packing.packer() if packing else None
        for batch in batches:
            for doc, row, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = text.as_py()
                chunk.append((doc.as_py(), row.as_py(), data.split()))
                held += len(data)
                if held >= _CHUNK:
                    yield _combine(chunk, seen, window, m, split, pack)
                    chunk, held = [], 0
        if chunk:
            yield _combine(chunk, seen, window, m, split, pack)

    return rows.mapInArrow(run, _SCHEMA)


def _sampled(rows: DataFrame, window: int, m: int, share: float) -> DataFrame:
    """Packed strings of a sample of the documents, as they are."""
    sample = rows.filter(F.pmod(F.xxhash64("doc", "row"), F.lit(1_000_000)) < int(share * 1_000_000))
    return _packed(sample, window, m, np.array([], np.uint64), None).filter("s IS NOT NULL")


def trained(sample: DataFrame, strings: int) -> Packing:
    """A dictionary from about ``_TRAINED_ON`` of the sample's ``strings``, by hash, so that no
    task sends more than its part; none where there are few."""
    import zstandard

    some = sample.filter(F.octet_length("s") <= _LENGTH)
    if strings > _TRAINED_ON:
        some = some.filter(F.pmod(F.xxhash64("s"), F.lit(1_000_000_000)) < int(1_000_000_000 * _TRAINED_ON / strings))
    # In a fixed order that isn't the words': the trainer takes neighbouring samples together.
    got = sorted((bytes(r["s"]) for r in some.select("s").limit(2 * _TRAINED_ON).collect()), key=lambda s: (zlib.crc32(s), s))
    return Packing(zstandard.train_dictionary(_DICTIONARY, got, level=3).as_bytes() if len(got) >= _TRAINED_ON // 4 else b"")


def split_minimisers(sample: DataFrame, partitions: int) -> tuple[np.ndarray, int]:
    """Hashes of minimisers that more than half of a shuffle partition's packed strings
    have, ``2 * partitions`` at most, and the number of strings; of a sample."""
    spark, at = sample.sparkSession, shared_path(sample.sparkSession, "minimisers")
    counts = sample.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    # Rare ones are one row without hash.  No Observation: a session that has had one can't be
    # serialised, and what a logistic regression scores with holds its session.
    counts.groupBy(F.when(F.col("n") >= 100, F.col("b")).alias("b")).agg(F.sum("n").alias("n")).write.parquet(at)
    found = spark.read.schema("b bigint, n bigint").parquet(at)
    total = found.agg(F.sum("n")).first()[0] or 0
    # At most 2 * partitions can have so many.
    hot = found.filter("b IS NOT NULL").filter(F.col("n") * (2 * partitions) >= total).select("b").collect()
    drop_path(spark, at)
    return np.sort(np.array([r["b"] for r in hot], np.uint64)), total


def bucket_ranges(doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, strings: list[bytes], window: int) -> list[np.ndarray]:
    """``doc, row, at, n`` of the windows that have an owner of smaller id, from whole
    buckets: windows are sorted by hash and id, neighbours compared word for word."""
    words: list[bytes] = []
    for s in strings:
        words += s.split(b" ")
    ids = np.asarray(pa.array(words, pa.binary()).dictionary_encode().indices).astype(np.uint64)
    size = n.astype(np.int64)
    off = np.cumsum(size + window - 1) - (size + window - 1)
    of = np.repeat(np.arange(len(n)), size)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    pos = off[of] + inner
    key = _sequences(_mix(ids + np.uint64(1)), window)[pos]
    docs = doc[of]
    order = np.lexsort((docs, key))
    same = key[order][1:] == key[order][:-1]
    left, right = pos[order[:-1][same]], pos[order[1:][same]]
    if any((ids[left + k] != ids[right + k]).any() for k in range(window)):
        # Two windows with one hash: number the windows by their words.
        rows = np.stack([ids[pos + k] for k in range(window)], axis=1)
        key = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((docs, key))
        same = key[order][1:] == key[order][:-1]
    head = np.append(True, ~same)
    owner = np.empty(len(of), np.int64)
    owner[order] = docs[order][head][np.cumsum(head) - 1]
    gone = np.flatnonzero(owner < docs)
    first = np.append(True, (of[gone][1:] != of[gone][:-1]) | (gone[1:] != gone[:-1] + 1)) if len(gone) else np.array([], bool)
    begin = np.flatnonzero(first)
    r = of[gone][begin]
    return [doc[r], row[r], (at[r] + inner[gone][begin]).astype(np.int32), np.diff(np.append(begin, len(gone))).astype(np.int32)]


def _owned(packed: DataFrame, window: int, packing: Packing) -> DataFrame:
    """Ranges of windows that go; ``packed`` is dealt and sorted by bucket."""

    def settle(parts: list[pa.RecordBatch], unpack) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        b, doc, row, at, n = (t.column(k).to_numpy() for k in range(5))
        text = np.asarray(t.column(5).is_valid())
        early = np.flatnonzero(~text)
        edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        group = np.cumsum(np.append(True, b[1:] != b[:-1])) - 1
        # Buckets that one document has alone take nothing from it.
        met = (np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge))[group]
        use = np.flatnonzero(text & met)
        cols = [c[early] for c in (doc, row, at, n)]
        if len(use):
            got = bucket_ranges(doc[use], row[use], at[use], n[use], [unpack(x) for x in t.column(5).take(pa.array(use)).to_pylist()], window)
            cols = [np.concatenate(x) for x in zip(cols, got, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "row", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, unpack = [], 0, packing.unpacker()
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            b = t.column(0).to_numpy()
            last = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            if last:
                yield from settle(t.slice(0, last).to_batches(), unpack)
            held, rows = t.slice(last).to_batches(), t.num_rows - last
        if rows:
            yield from settle(held, unpack)

    return packed.mapInArrow(run, _RANGES)


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, m: int = 2, share: float = 1 / 16) -> DataFrame:
    """``(doc, row, ranges)``: ``ranges`` of ``(at, n)``, ``n`` windows from word ``at`` on that
    go; ``row`` is 32 bits of a hash of the text.  Only texts that lose words have a row."""
    if not 1 <= m <= window:
        raise ValueError("a minimiser has at least one word and at most a window's")
    spark, rows = df.sparkSession, _rows(df, id_col, text_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = _sampled(rows, window, m, share)
    split, strings = split_minimisers(sample, partitions)
    packing = trained(sample, strings)
    dealt = _packed(rows, window, m, split, packing).repartition("b").sortWithinPartitions("b")
    at = shared_path(spark, "substring-ranges")
    # The packed strings are the largest thing on disk: they go when the ranges are written.
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        _owned(dealt, window, packing).groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n")).alias("ranges")).write.parquet(at)
    return spark.read.schema("doc bigint, row int, ranges array<struct<at: int, n: int>>").parquet(at)


def without(data: bytes, ranges: list | None, window: int) -> tuple[bytes, int, int]:
    """Kept words joined by a space, words, and words that went."""
    words = data.split()
    if not ranges:
        return b" ".join(words), len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array([r["at"] for r in ranges])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.array([r["n"] for r in ranges]) + window - 1, -1)
    stays = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, k in zip(words, stays.tolist(), strict=True) if k), len(words), int(len(words) - stays.sum())


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, m: int = 2) -> DataFrame:
    """All columns of ``df`` with ``__kept`` (the words that stay, joined by a space),
    ``__n_words`` and ``__n_removed``."""
    gone = removed(df, id_col, text_col, window, m)
    names = [c for c in df.columns if c not in _MADE]
    text = text_bytes(text_col)
    whole = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), _row(text).alias("row"), text.alias("text"))
    met = whole.join(gone, ["doc", "row"], "left").select(*(f"c{k}" for k in range(len(names))), "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns - 2
            done = [without(t.as_py(), r.as_py(), window) for t, r in zip(b.column(k), b.column(k + 1), strict=True)]
            kept, n, lost = zip(*done, strict=True) if done else ((), (), ())
            new = [pa.array([x.decode() for x in kept], pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(k)), *new], [*(f"c{j}" for j in range(k)), *_MADE])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    out = met.mapInArrow(run, ", ".join([*(f"c{k} {kinds[f'c{k}']}" for k in range(len(names))), "__kept string, __n_words bigint, __n_removed bigint"]))
    return out.toDF(*names, *_MADE)
