"""Byte-level BPE encoding and decoding over overlapping chunks.

A text of up to ``chunk_chars`` is one chunk and is encoded where it lies.  Longer
texts are cut into overlapping chunks that are dealt over the cluster:

1. every chunk is pre-tokenised on its own;
2. per text, neighbouring chunks are stitched at the first pre-token boundary of
   their overlap on which both agree (pre-tokenisation from a true boundary on
   depends only on what follows, so from there both agree for good);
3. the pieces between stitches are encoded in parallel and joined in order.

A stitch must follow a character that isn't white space (white-space runs look at
what follows them), and the earlier chunk's boundary must lie ``_GUARD``
characters before its end, so that the cut-off end can't have shaped it.  Where an
overlap holds no such boundary (one run of letters longer than the overlap), the
rest of that text is a single piece: exact, only less parallel.

Decoding looks up each id's raw bytes and concatenates them; bytes are decoded to
text, if at all, only once they are whole.

Defined cases: null text counts as empty and has no ids; ids may be null, repeated
or of any type; equal rows give equal rows; an empty table gives an empty table.
Input columns other than the two named are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters before a chunk's end within which boundaries aren't trusted; the
#: pattern looks at most two characters past the end of a match.
_GUARD = 4

_CODERS: dict[str, "Coder"] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of ``base64(token) rank``."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Coder:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = parse_ranks(ranks)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.tokens = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            self.tokens[rank] = token
        # The regex module's \s also holds four control characters that aren't White_Space.
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])

    def boundaries(self, text: str) -> list[int]:
        """Starts of pre-tokens that follow a character that isn't white space."""
        return [m.start() for m in self.pattern.finditer(text) if m.start() and not text[m.start() - 1].isspace()]


def coder(ranks: bytes, pattern: str) -> Coder:
    key = hashlib.sha1(ranks + pattern.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def stitch(n_chars: int, starts: list[int], ends: list[int], heads: list[list[int]], tails: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(chunk, piece, from, to) for every chunk of one text that carries part of a
    piece; offsets count characters of the text."""
    out, begin, k, last = [], 0, 0, len(starts) - 1
    while k < last:
        common = set(heads[k + 1]).intersection(p for p in tails[k] if p > begin)
        if not common:
            break
        cut = min(common)
        out.append((k, k, begin, cut))
        begin, k = cut, k + 1
    for j in range(k, last + 1):  # the last piece: one chunk, or all that found no stitch
        to = n_chars if j == last else starts[j + 1]
        if to > begin:
            out.append((j, k, begin, to))
            begin = to
    return out


def _result(doc_id, ids: np.ndarray, c: Coder) -> tuple:
    raw = ids.tobytes()
    return doc_id, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode_documents(
    df: DataFrame,
    ranks: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 512,
    with_ids: bool = True,
) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if ``with_ids``, ``ids`` (little-endian unsigned 32-bit
    integers).  ``ranks`` is the content of a rank file; it is broadcast, and is
    of the vocabulary's size whatever the corpus."""
    if overlap_chars <= _GUARD or chunk_chars < 2 * overlap_chars:
        raise ValueError("chunks must be at least twice the overlap, and the overlap over 4 characters")
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast((ranks, pattern))
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    id_type = rows.schema["__id"].dataType.simpleString()
    fields = f"__id {id_type}, n_tokens bigint, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def pack(out: list[tuple], schema_names: list[str], id_arrow) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        made = {"__id": pa.array(cols[0], id_arrow), "n_tokens": pa.array(cols[1], pa.int64()), "ids": pa.array(cols[2], pa.binary()), "ids_sha256": pa.array(cols[3], pa.string()), "decoded_sha256": pa.array(cols[4], pa.string())}
        return pa.RecordBatch.from_arrays([made[n] for n in schema_names], schema_names)

    names = ["__id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shipped.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 256):  # bounds what is held at once
                part = [_result(i.as_py(), c.encode(t.as_py()), c) for i, t in zip(ids[at : at + 256], texts[at : at + 256], strict=True)]
                yield pack(part, names, ids.type)

    short = rows.filter(F.char_length("__text") <= chunk_chars).mapInArrow(encode_whole, fields)

    step = chunk_chars - overlap_chars
    longer = (
        rows.filter(F.char_length("__text") > chunk_chars)
        .groupBy("__id", "__text")
        .agg(F.count(F.lit(1)).alias("__copies"))
        .select("__id", "__text", "__copies", F.char_length("__text").alias("__n"), F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("__id").cast("string"), F.lit("\u0002")), "__text"), 256).alias("__key"))
    )
    last = F.ceil((F.col("__n") - chunk_chars) / F.lit(step)).cast("int")
    chunks = longer.select(
        "__key", "__id", "__copies", "__n", F.explode(F.sequence(F.lit(0), last)).alias("__chunk"), "__text"
    ).select(
        "__key", "__id", "__copies", "__n", "__chunk", F.expr(f"substring(__text, __chunk * {step} + 1, {chunk_chars})").alias("__part")
    ).repartition("__key", "__chunk")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shipped.value)
        for b in batches:
            heads, tails = [], []
            for chunk, part in zip(b.column("__chunk").to_pylist(), b.column("__part"), strict=True):
                text, start = part.as_py(), chunk * step
                found = c.boundaries(text)
                heads.append([start + p for p in found if p < overlap_chars])
                tails.append([start + p for p in found if step <= p <= len(text) - _GUARD])
            yield pa.RecordBatch.from_arrays(
                [b.column("__key"), b.column("__n"), b.column("__chunk"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                ["__key", "__n", "__chunk", "heads", "tails"],
            )

    marks = chunks.select("__key", "__n", "__chunk", "__part").mapInArrow(pretokenise, "__key string, __n int, __chunk int, heads array<bigint>, tails array<bigint>")

    def stitch_text(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["__chunk"])
        starts = [r["__chunk"] * step for r in rows]
        cuts = stitch(rows[0]["__n"], starts, [], [r["heads"] for r in rows], [r["tails"] for r in rows])
        return pa.table({"__key": pa.array([key[0].as_py()] * len(cuts), pa.string()), "__chunk": pa.array([x[0] for x in cuts], pa.int32()), "__piece": pa.array([x[1] for x in cuts], pa.int32()), "__from": pa.array([x[2] for x in cuts], pa.int64()), "__to": pa.array([x[3] for x in cuts], pa.int64())})

    cuts = marks.groupBy("__key").applyInArrow(stitch_text, "__key string, __chunk int, __piece int, __from bigint, __to bigint")
    pieces = (
        chunks.join(cuts, ["__key", "__chunk"])
        .select("__key", "__id", "__copies", "__piece", F.struct("__chunk", F.expr(f"substring(__part, cast(__from - __chunk * {step} + 1 as int), cast(__to - __from as int))").alias("t")).alias("__s"))
        .groupBy("__key", "__piece")
        .agg(F.first("__id").alias("__id"), F.first("__copies").alias("__copies"), F.array_join(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["t"]), "").alias("__text"))
    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shipped.value)
        for b in batches:
            ids = pa.array([c.encode(t.as_py()).tobytes() for t in b.column("__text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("__id"), b.column("__copies"), b.column("__piece"), ids], ["__key", "__id", "__copies", "__piece", "ids"])

    coded = (
        pieces.select("__key", "__id", "__copies", "__piece", "__text")
        .mapInArrow(encode_pieces, f"__key string, __id {id_type}, __copies bigint, __piece int, ids binary")
        .groupBy("__key")
        .agg(F.first("__id").alias("__id"), F.first("__copies").alias("__copies"), F.array_sort(F.collect_list(F.struct("__piece", "ids"))).alias("__parts"))
        .select("__id", F.expr("explode(array_repeat(0, cast(__copies as int)))").alias("__copy"), "__parts")
        .select("__id", "__parts.ids")
    )

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shipped.value)
        for b in batches:
            for i, parts in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(b"".join(parts.as_py()), dtype="<u4")
                yield pack([_result(i.as_py(), ids, c)], names, b.column(0).type)

    return short.unionByName(coded.mapInArrow(join_pieces, fields)).withColumnRenamed("__id", id_col)


def decode_documents(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Ids (little-endian unsigned 32-bit integers; null counts as none) back to
    raw bytes: one row ``(id, decoded binary)`` per input row."""
    shipped = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(ids_col), F.lit("").cast("binary")).alias("__ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shipped.value)
        for b in batches:
            out = [c.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["__id", "decoded"])

    return rows.mapInArrow(decode, f"__id {rows.schema['__id'].dataType.simpleString()}, decoded binary").withColumnRenamed("__id", id_col)
