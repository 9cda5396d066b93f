"""SimHash fingerprints and near-duplicate components by pigeonring filtering.

A fingerprint is a ring of ``segments`` equal bit segments.  If two fingerprints
differ in at most ``max_bits`` bits, some segment starts a chain whose cumulative
differences stay within the proportional budgets: at most ``floor(l * max_bits /
segments)`` bits over its first ``l`` segments, for every ``l``.  With ``max_bits <
segments`` the first segment of such a chain is equal and the first two differ in
one bit at most, so chains are looked for by an equi-join on two segments: every
fingerprint is filed under both as they are, and looks itself up under both and
under the second with one of its zero bits set.  The remaining budgets prune the
matches before the full Hamming distance is taken.

The join runs over distinct fingerprints (copies have collapsed into one), and its
keys have ``2 * 64 / segments`` bits, so chance matches stay few as the corpus
grows.  Components come from alternating large-star and small-star rounds on the
links, every round written to the shared folder.

Defined cases: null and empty texts have no word and get fingerprint 0, linked like
any other; null ids are ignored by the smallest-id rule (a component of only null
ids has a null id); repeated rows give repeated rows; empty tables give empty
tables; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, shared_path, text_bytes, written

_SEED = 42
#: Links of a round that one task writes at most, about.
_LINKS_PER_FILE = 1_000_000
#: Bytes of a text whose words are held at once.
_SLICE = 1 << 20


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The words, in lists of bounded size."""
    at = 0
    while at < len(data):
        to = min(len(data), at + _SLICE)
        while to < len(data) and data[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        yield data[at:to].split()
        at = to


def fingerprint(data: bytes, words: int = 3) -> int:
    """64-bit SimHash of the whole text: ASCII lower case, runs of anything but
    space and \\t-\\r as words, XXH64 (seed 42) of each shingle of ``words`` words
    joined by a space; fewer words are one shingle, none gives 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for part in _slices(data.lower()):
        found = carry + part
        carry = found[max(0, len(found) - words + 1) :] if words > 1 else []
        if len(found) < words:
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(found) - words] + 1))
        hashes = np.array([digest(joined[a:b], _SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    if not n:
        return digest(b" ".join(carry), _SEED) if carry else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp bigint)`` per row."""
    rows = df.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["__id", "fp"])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, fp bigint").withColumnRenamed("__id", id_col)


def links(fps: DataFrame, max_bits: int = 3, segments: int = 4) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) that differ
    in at most ``max_bits`` bits."""
    if 64 % segments or segments > 16 or not 0 <= max_bits < segments:
        raise ValueError("segments must divide 64 and exceed max_bits")
    width = 64 // segments
    rot = " ".join(["CASE i", *(f"WHEN {i} THEN (shiftleft(fp, {width * i}) | shiftrightunsigned(fp, {64 - width * i}))" for i in range(1, segments)), "ELSE fp END"])
    turned = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("i")).select("i", F.expr(rot).alias("r"))
    key = f"shiftrightunsigned(r, {64 - 2 * width})"
    filed = turned.select("i", F.expr(key).alias("k"), F.col("r").alias("r2"))
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << j).cast("bigint") for j in range(width))) if 2 * max_bits >= segments else F.array(F.lit(0).cast("bigint"))
    asked = (
        turned.select("i", F.col("r").alias("r1"), F.expr(key).alias("k0"), F.explode(flips).alias("flip"))
        .filter("(k0 & flip) = 0")
        .select("i", F.expr("k0 | flip").alias("k"), "r1", "flip")
    )
    # Both sides have a multiple of the rows that Spark counts on: neither may be broadcast.
    met = asked.join(filed.hint("merge"), ["i", "k"]).filter("flip != 0 OR r1 != r2")
    for length in range(3, segments):
        met = met.filter(F.expr(f"bit_count(shiftrightunsigned(r1 ^ r2, {64 - length * width})) <= {length * max_bits // segments}"))
    met = met.filter(f"bit_count(r1 ^ r2) <= {max_bits}")
    back = " ".join(["CASE i", *(f"WHEN {i} THEN (shiftrightunsigned(%s, {width * i}) | shiftleft(%s, {64 - width * i}))" for i in range(1, segments)), "ELSE %s END"])
    pair = met.select(F.expr(back.replace("%s", "r1")).alias("x"), F.expr(back.replace("%s", "r2")).alias("y"))
    return pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``pairs (a, b)``; root is the smallest node
    reachable.  No link set or component is gathered anywhere: each half-round is
    a minimum per node and a join."""
    spark = pairs.sparkSession
    edges, path = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), None

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before, n = None, edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        new = shared_path(spark, "links")
        # A round has at most two rows for each link of the round before.
        small.coalesce(1 + 2 * n // _LINKS_PER_FILE).write.parquet(new)
        edges = spark.read.schema("u bigint, v bigint").parquet(new)
        if path:
            drop_path(spark, path)
        path, now = new, signature(edges)
        n = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, segments: int = 4, files: int | None = None) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row: 16 hexadecimal digits, and the
    smallest id reachable over links of at most ``max_bits`` differing bits.  The links
    are written to ``files`` files at most, if given."""
    marked = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    kinds = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    near = links(kinds.select("fp"), max_bits, segments)
    pairs = written(near.coalesce(files) if files else near, "pairs")
    found = components(pairs)
    member = kinds.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(heads, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
