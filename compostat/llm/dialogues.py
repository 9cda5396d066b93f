"""Repair of conversation structure by Four-Russians block tables.

A conversation is to be an optional system turn and then user and assistant in turn, ending
with the assistant (role initials ``(s?(ua)+)?``).  Edits of a row are Keep (0), Rerole to
user or assistant (3) and Delete (4, and the only one for blank and duplicate rows); an empty
user or assistant turn can be Inserted anywhere (3); a truncated row that isn't deleted adds
3.  Of the cheapest edit sequences the one with the least letters in ASCII order is taken.

The grammar has four states, so what is left to pay after some row is a vector of four
costs.  Less its minimum it is one of a few dozen vectors.  For every block of ``BLOCK`` row
symbols (role initial and fault: nine symbols) and every such vector the table has the vector
before the block and what was taken off: a conversation is read from its end, a lookup a
block.  Letters are found from its start: each block is expanded backward from the vector
kept at its end, and at each row the least letter that keeps the cost is taken.  In a state,
a letter leads to one other state, so choices never tie, and no cost is compared across
sequences of letters.

Conversations of any length are split.  Rows are dealt out by ranges of (conversation, turn,
role, text) and cut into segments of bounded rows and text.  For each segment, the same table
gives the costs between its states at both ends (a 4 x 4 matrix); for conversations of several
segments these small matrices are put together from the last to the first, then the states
reached from the first to the last, and then every segment finds its letters alone.  Digests
of repaired conversations are taken over segments in order, as a stream.

Defined cases: nulls in role and text read as one space (so does a null id or turn in the
damage's checksum); rows without an id are one conversation; rows without a turn come first;
rows of a turn are ordered by role and text, so equal rows are neighbours; other roles than
those that begin with s, u or a can't be kept; an empty table gives an empty one; very long
texts are read whole (a row must fit); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols a block.
BLOCK = 4
#: Rows and characters of a segment, about.
_ROWS, _CHARS = 16_384, 1 << 20
_ROLE = {"u": "user", "a": "assistant"}
#: State after a role initial: 0 at the start, 1 after s, 2 after u, 3 after a; ends in 0 or 3.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_INITIALS = "sua"
#: The symbol of a row that must go; the others are 2 * initial + truncated.
MUST_GO = 8
SYMBOLS = 9
_FAR = 10**6
Vector = tuple[int, int, int, int]


def _with_inserts(v: list[int]) -> Vector:
    """Least costs where a missing turn may be inserted first (as often as it takes)."""
    for _ in range(3):
        for q, to in enumerate(_NEXT):
            for c in "ua":
                if c in to and v[to[c]] + INSERT < v[q]:
                    v[q] = v[to[c]] + INSERT
    return tuple(v)


#: What is left to pay behind the last row.
AT_END = _with_inserts([0, _FAR, _FAR, 0])


def _row_costs(symbol: int, after: Vector, q: int) -> dict[str, tuple[int, int]]:
    """Letter -> (cost, state after) of the edits that take the row, in state ``q``."""
    found = {"D": (DELETE + after[q], q)}
    if symbol == MUST_GO:
        return found
    extra = TRUNCATED * (symbol & 1)
    initial = "suax"[symbol >> 1]
    if initial in _NEXT[q]:
        found["K"] = (KEEP + extra + after[_NEXT[q][initial]], _NEXT[q][initial])
    to = next(_NEXT[q][c] for c in "ua" if c in _NEXT[q])
    found["R"] = (REROLE + extra + after[to], to)
    return found


@lru_cache
def step(symbol: int, after: Vector) -> Vector:
    """Costs before a row, from those behind it; not normalised."""
    return _with_inserts([min(c for c, _ in _row_costs(symbol, after, q).values()) for q in range(4)])


def _normal(v: Vector) -> tuple[Vector, int]:
    low = min(v)
    return tuple(_FAR if x - low >= _FAR // 2 else x - low for x in v), low


class Tables:
    """All normalised vectors that rows can lead to, and the transitions of symbols and
    blocks between their numbers."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[Vector] = []
        number: dict[Vector, int] = {}

        def of(v: Vector) -> tuple[int, int]:
            v, low = _normal(v)
            if v not in number:
                number[v] = len(self.vectors)
                self.vectors.append(v)
            return number[v], low

        self.end, self.end_low = of(AT_END)
        # Only state q at the far end is free: for the costs between states of a segment.
        self.units = [of(_with_inserts([0 if q == k else _FAR for q in range(4)])) for k in range(4)]
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            one.append([of(step(s, self.vectors[len(one)])) for s in range(SYMBOLS)])
        to, low = np.array(one).transpose(2, 1, 0)  # by symbol and vector
        self.one_to, self.one_low = to.tolist(), low.tolist()
        # A block is a number in base 9, its first row the highest digit; rows go in from the end.
        whole, paid = np.arange(len(self.vectors))[None, :], np.zeros((1, len(self.vectors)), int)
        for _ in range(block):
            # A row before the blocks so far.
            paid = np.stack([paid + low[s][whole] for s in range(SYMBOLS)]).reshape(-1, len(self.vectors))
            whole = np.stack([to[s][whole] for s in range(SYMBOLS)]).reshape(-1, len(self.vectors))
        self.to, self.low = whole, paid

    def blocks(self, symbols: bytes) -> tuple[list[int], bytes]:
        """Numbers of the whole blocks, and the rows behind them."""
        n = len(symbols) // self.block
        digits = np.frombuffer(symbols[: n * self.block], np.uint8).reshape(n, self.block).astype(np.int64)
        return (digits @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))).tolist(), symbols[n * self.block :]

    def back(self, symbols: bytes, at: int) -> tuple[list[int], int]:
        """Vector numbers at the ends of the blocks, the first at the start, last the one
        behind the last whole block; and what was taken off."""
        blocks, rest = self.blocks(symbols)
        paid = 0
        for s in reversed(rest):
            paid += self.one_low[s][at]
            at = self.one_to[s][at]
        marks = [at]
        for b in reversed(blocks):
            paid += int(self.low[b, at])
            at = int(self.to[b, at])
            marks.append(at)
        return marks[::-1], paid

    def matrix(self, symbols: bytes) -> list[int]:
        """Cheapest cost from each state before the segment to each behind it, by rows."""
        out = [0] * 16
        for k, (at, low) in enumerate(self.units):
            marks, paid = self.back(symbols, at)
            for q, cost in enumerate(self.vectors[marks[0]]):
                out[4 * q + k] = _FAR if cost >= _FAR else cost + paid + low
        return out

    def number(self, v: Vector) -> int:
        """The number of a vector of costs behind a segment."""
        return self.vectors.index(_normal(v)[0])

    @lru_cache  # noqa: B019  one object for a worker's life
    def choice(self, symbol: int, after: int, q: int) -> tuple[str, int, str]:
        """Letters up to the one that takes the row, the state then, and the initials of
        turns inserted before."""
        behind, letters, new = self.vectors[after], "", ""
        before = step(symbol, behind)
        while True:
            taken = {c: to for c, (cost, to) in _row_costs(symbol, behind, q).items() if cost == before[q]}
            if "D" in taken:
                return letters + "D", taken["D"], new
            role = next(c for c in "ua" if c in _NEXT[q])
            if before[_NEXT[q][role]] + INSERT == before[q]:
                letters, new, q = letters + "I", new + role, _NEXT[q][role]
                continue
            c = min(taken)
            return letters + c, taken[c], new

    def trace(self, symbols: bytes, behind: int, q: int) -> Iterator[tuple[str, int, str]]:
        """``choice`` of each row, in order, from state ``q`` and the vector behind them."""
        marks, _ = self.back(symbols, behind)
        size = self.block
        for k in range(len(marks)):
            part = symbols[k * size : (k + 1) * size] if k < len(marks) - 1 else symbols[k * size :]
            at, ends = marks[k + 1] if k < len(marks) - 1 else behind, []
            for s in reversed(part):
                ends.append(at)
                at = self.one_to[s][at]
            for s, end in zip(part, reversed(ends), strict=True):
                found = self.choice(s, end, q)
                q = found[1]
                yield found


@lru_cache
def tables() -> Tables:
    return Tables()


def closing(q: int) -> str:
    """Initials of the turns to insert behind the last row, in state ``q``."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[q]


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with every twentieth row dropped, emptied, stripped of its
    ends of sentences, repeated, or given to the user, by a checksum of id and turn."""
    space = F.lit(" ")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.filter("kind != 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__n")).drop("__n")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, times, symbol, fault)``: distinct rows with how often each
    stands there; fault 1 is blank, 2 duplicate, 3 truncated (of the first of its copies)."""
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    # The first of a conversation's rows with a role and text is no duplicate: a minimum per key.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    least = once.groupBy("conv", "role", "text").agg(F.min(order).alias("least")).toDF("c", "r", "t", "least")
    met = once.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", 1).when(order != F.col("least"), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(first == c, k) for k, c in enumerate(_INITIALS)), F.lit(len(_INITIALS)))
    symbol = F.when(F.col("fault").isin(1, 2), MUST_GO).otherwise(2 * initial + F.when(F.col("fault") == 3, 1).otherwise(0))
    return met.withColumn("fault", fault).withColumn("symbol", symbol).select("conv", "turn", "role", "text", "times", "symbol", "fault")


def _fields(kind: pa.DataType, names: str) -> pa.Schema:
    kinds = {"i": pa.int64(), "s": pa.string(), "b": pa.binary(), "S": pa.list_(pa.string()), "I": pa.list_(pa.int64()), "t": pa.bool_()}
    return pa.schema([("conv", kind), ("part", pa.int64()), ("serial", pa.int64()), *((n[2:], kinds[n[0]]) for n in names.split())])


_SEGMENT = "b:symbols S:roles S:texts s:first s:last i:blank i:duplicate i:truncated i:illegal"


class _Segment:
    """A run of a conversation's rows while it is put together."""

    def __init__(self, conv, part: int, serial: int):
        self.conv, self.part, self.serial = conv, part, serial
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.first = self.last = None
        self.faults, self.illegal = [0, 0, 0, 0], 0

    def add(self, symbol: int, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.symbols.append(symbol)
        # What must go needs no text.
        self.roles.append(role if symbol != MUST_GO else "")
        self.texts.append(text if symbol != MUST_GO else "")
        self.chars += len(self.texts[-1])
        self.faults[fault] += 1

    def full(self, rows: int, chars: int) -> bool:
        return len(self.symbols) >= rows or self.chars >= chars

    def row(self) -> dict:
        return {"conv": self.conv, "part": self.part, "serial": self.serial, "symbols": bytes(self.symbols), "roles": self.roles, "texts": self.texts, "first": self.first, "last": self.last, "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3], "illegal": self.illegal}


def segments(rows: DataFrame, most_rows: int = _ROWS, most_chars: int = _CHARS) -> DataFrame:
    """Runs of a conversation's rows in order, of bounded size, one row each; ``part`` and
    ``serial`` order them."""
    key = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = faults(rows).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id().cast("bigint"))
    kind = dealt.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, serial = None, 0
        for b in batches:
            schema, out = _fields(b.schema.field("conv").type, _SEGMENT), []
            for r in b.to_pylist():
                for k in range(r["times"]):
                    if now is None or now.conv != r["conv"] or now.full(most_rows, most_chars):
                        if now is not None:
                            out.append(now.row())
                        now, serial = _Segment(r["conv"], r["part"], serial), serial + 1
                    if k:  # a copy of the row before
                        now.add(MUST_GO, r["role"], "", 1 if r["fault"] == 1 else 2)
                    else:
                        now.add(r["symbol"], r["role"], r["text"], r["fault"])
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return dealt.mapInArrow(run, f"conv {kind}, part bigint, serial bigint, symbols binary, roles array<string>, texts array<string>, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def _each(df: DataFrame, make, names: str, spec: str) -> DataFrame:
    """``make(row)`` for every row; what it returns goes behind the segment's key."""
    kind = df.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = _fields(b.schema.field("conv").type, names)
            for at in range(0, b.num_rows, 64):
                out = [{k: r[k] for k in ("conv", "part", "serial")} | make(r) for r in b.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(out, schema)

    return df.mapInArrow(run, f"conv {kind}, part bigint, serial bigint, {spec}")


def _in_order(df: DataFrame, fold, names: str, spec: str) -> DataFrame:
    """``fold(rows)`` of each conversation's small rows in order, one result a row."""
    kind = df.schema["conv"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["serial"]))
        out = [{k: r[k] for k in ("conv", "part", "serial")} | new for r, new in zip(rows, fold(rows), strict=True)]
        return pa.Table.from_pylist(out, _fields(t.schema.field("conv").type, names))

    return df.groupBy("conv").applyInArrow(run, f"conv {kind}, part bigint, serial bigint, {spec}")


def _behind(rows: list[dict]) -> list[dict]:
    """The vector behind each segment, from the segments' matrices."""
    v, out = list(AT_END), []
    for r in reversed(rows):
        out.append({"behind": v})
        m = r["matrix"]
        v = [min(m[4 * q + k] + v[k] for k in range(4)) for q in range(4)]
        low = min(v)
        v = [x - low for x in v]
    return out[::-1]


def _begins(rows: list[dict]) -> list[dict]:
    """The state before each segment, from the states each leads to."""
    q, out = 0, []
    for k, r in enumerate(rows):
        out.append({"behind": r["behind"], "begin": q, "final": k == len(rows) - 1})
        q = r["ends"][q]
    return out


def _led_to(r: dict) -> dict:
    t = tables()
    at = t.number(tuple(r["behind"]))
    ends = []
    for q in range(4):
        for _, q, _new in t.trace(r["symbols"], at, q):  # noqa: B020, PLW2901
            pass
        ends.append(q)
    return {"behind": r["behind"], "ends": ends}


def _edited(r: dict) -> dict:
    """Letters, cost and repaired lines of a segment."""
    t = tables()
    at = t.end if r["behind"] is None else t.number(tuple(r["behind"]))
    q, audit, cost, lines = r["begin"] or 0, [], 0, []
    for k, (letters, after, new) in enumerate(t.trace(r["symbols"], at, q)):
        symbol = r["symbols"][k]
        audit.append(letters)
        lines += [f"{_ROLE[c]}:" for c in new]
        cost += INSERT * len(new) + (DELETE if letters[-1] == "D" else (REROLE if letters[-1] == "R" else KEEP) + TRUNCATED * (symbol & 1))
        if letters[-1] == "K":
            lines.append(f"{r['roles'][k]}:{r['texts'][k]}")
        elif letters[-1] == "R":
            lines.append(f"{_ROLE['a' if after == 3 else 'u']}:{r['texts'][k]}")
        q = after
    if r["final"] is not False:
        new = closing(q)
        audit.append("I" * len(new))
        cost += INSERT * len(new)
        lines += [f"{_ROLE[c]}:" for c in new]
    return {"audit": "".join(audit), "cost": cost, "lines": "\n".join(lines) if lines else None, **{k: r[k] for k in ("first", "last", "blank", "duplicate", "truncated", "illegal")}}


def edits(rows: DataFrame, most_rows: int = _ROWS, most_chars: int = _CHARS) -> DataFrame:
    """Per segment of ``rows (conv, turn, role, text)``, in order of ``part`` and ``serial``: the
    cheapest edits' letters, their cost and the repaired lines (null: none), with the
    segment's counts of faults."""
    whole = written(segments(rows, most_rows, most_chars), "dialogue-segments")
    # Conversations of one segment need no vectors of others.
    several = whole.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"))
    long = whole.select("conv", "part", "serial", "symbols").join(several, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    matrices = _each(long, lambda r: {"matrix": tables().matrix(r["symbols"])}, "I:matrix", "matrix array<bigint>")
    behind = _in_order(matrices, _behind, "I:behind", "behind array<bigint>")
    known = long.join(behind.toDF("c", "p", "s", "behind"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("serial") == F.col("s")))
    ends = _each(known, _led_to, "I:behind I:ends", "behind array<bigint>, ends array<bigint>")
    begins = written(_in_order(ends, _begins, "I:behind i:begin t:final", "behind array<bigint>, begin bigint, final boolean"), "dialogue-states")
    met = whole.join(begins.toDF("c", "p", "s", "behind", "begin", "final"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("serial") == F.col("s")), "left").drop("c", "p", "s")
    return _each(met, _edited, "s:audit i:cost s:lines s:first s:last i:blank i:duplicate i:truncated i:illegal", "audit string, cost bigint, lines string, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = _ROWS, most_chars: int = _CHARS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every
    conversation of ``df`` after ``damage``; see the module for nulls and order."""
    rows = damage(df, conv_col, turn_col, role_col, text_col)
    done = edits(rows, most_rows, most_chars)
    kind = done.schema["conv"].dataType.simpleString()
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    names = " ".join([*(f"i:{c}" for c in numbers), "s:audit", "s:repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        for b in batches:
            schema, out = _fields(b.schema.field("conv").type, names), []
            for r in b.to_pylist():
                if now is None or now["conv"] != r["conv"]:
                    if now is not None:
                        out.append(now | {"audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()})
                    now, digest, empty, last = {"conv": r["conv"], "part": 0, "serial": 0, "audit": []} | dict.fromkeys(numbers, 0), hashlib.sha256(), True, None
                for c in numbers:
                    now[c] += r[c]
                if last is not None and last + r["first"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                last = r["last"]
                now["audit"].append(r["audit"])
                if r["lines"] is not None:
                    digest.update((("" if empty else "\n") + r["lines"]).encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now | {"audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}], schema)

    streamed = done.repartition("conv").sortWithinPartitions("conv", "part", "serial").mapInArrow(run, f"conv {kind}, part bigint, serial bigint, " + ", ".join(f"{c} bigint" for c in numbers) + ", audit string, repaired_sha256 string").drop("part", "serial")
    span = rows.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n")).select(F.col("conv").alias("d"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    every = df.select(F.col(conv_col).alias("conv_id")).distinct()
    met = every.join(streamed, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(span, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zero = F.lit(0).cast("bigint")
    return met.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ["gaps", *numbers]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
