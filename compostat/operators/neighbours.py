"""Nearest neighbours by a table of cells around pivots.

Every distinct vector lies in the cell of its nearest pivot.  What a query must look at
follows from the triangle inequality: a vector x of the cell of pivot p is at least
``d(q, p) - r_max``, ``r_min - d(q, p)`` and, p being x's nearest pivot, ``(d(q, p) - d(q, o)) / 2``
away from q, for every other pivot o.  An exact search first looks into the nearest cells that
hold enough vectors, which bounds the k-th distance from above, and then into the cells whose
bound from below isn't beyond it: nothing else can be nearer.  An approximate search looks
into the ``probes`` nearest cells alone.

Where a search looks into few cells, these are dealt to tasks in blocks of vectors and parts of
queries, both bounded, as a cogrouped join by cell: no pair outside the cells asked for is ever
formed.  The cells that an exact search still has to see may be most of them, so a copy of each
query for each cell would grow with the square of the table: cells are packed into blocks there, and
blocks of queries meet blocks of vectors as a Cartesian product of partitions, which shuffles
nothing; queries that ask for none of a block's cells are left out of it.  Equal vectors are
one row of the index with their smallest ids, so a vector that a third of all rows share costs
what any other does.  Pivots are the means of a few rounds of k-means on a bounded sample and are
all that is sent out.  Rows without a vector have no neighbours and are nobody's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import cut

#: Rows of requests that leave a task at once, and blocks of vectors that one task sees.
_REQUESTS, _BLOCKS = 4096, 8
#: What two distances may differ by and still round to one at nine digits, with some slack.
_TIE = 2e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a to all of b; by differences, so that equal vectors are at 0."""
    return np.sqrt(np.stack([((b - u) ** 2).sum(axis=1) for u in a])) if len(a) else np.zeros((0, len(b)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def means(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """K-means on a sample in a fixed order; empty cells keep their pivot."""
    at = sample[:: max(1, len(sample) // pivots)][:pivots].copy()
    for _ in range(rounds):
        near = ((sample**2).sum(axis=1)[:, None] - 2 * sample @ at.T + (at**2).sum(axis=1)).argmin(axis=1)
        for c in np.unique(near):
            at[c] = sample[near == c].mean(axis=0)
    return at


class Cells:
    """Sizes of the cells and the least and largest distance from their pivots."""

    def __init__(self, size: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.size, self.low, self.high, self.k = size, low, high, k

    def to_ask(self, d: np.ndarray, within: np.ndarray | None, probes: int) -> list[np.ndarray]:
        """For each row of distances to the pivots: the first cells of a search, or (with the
        bound ``within`` found there) the cells that may still hold something nearer."""
        out = []
        for k, row in enumerate(d):
            order = np.argsort(row, kind="stable")
            order = order[self.size[order] > 0]
            enough = int(np.searchsorted(np.cumsum(self.size[order]), self.k + 1)) + 1
            first = order[: max(enough, probes)]
            if within is None:
                out.append(first)
                continue
            out.append(np.setdiff1d(np.flatnonzero(self.may(row, within[k])), first, assume_unique=True))
        return out

    def may(self, row: np.ndarray, within: float) -> np.ndarray:
        """Whether each cell may hold something ``within`` reach of a row of distances to the pivots."""
        bound = np.maximum.reduce([row - self.high, self.low - row, (row - row.min()) / 2])
        # A little slack for rounding: a cell too many costs time only.
        return (self.size > 0) & (bound <= within * (1 + 1e-9) + _TIE)


class Best:
    """The nearest of all blocks seen so far of each row of ``q``, with all ties of the last."""

    def __init__(self, q: np.ndarray, within: np.ndarray, k: int):
        self.q, self.k, self.qq, self.bound = q, k, (q * q).sum(axis=1), within.copy()
        self.src, self.dst, self.dist = np.zeros(0, int), None, np.zeros(0)

    def see(self, rows: np.ndarray, x: np.ndarray, names: pa.Array) -> None:
        """Look at the vectors ``x`` for the given rows."""
        xx, most = (x * x).sum(axis=1), 1 << 16
        src, dst, dist = [self.src], [], [self.dist]
        step = max(1, (1 << 20) // max(1, len(x)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            # By dot products, to choose whose distance is taken by differences.
            d2 = self.qq[part][:, None] + xx - 2 * (self.q[part] @ x.T)
            slack = 1e-11 * (self.qq[part] + xx.max())
            reach = (self.bound[part] * (1 + 1e-9) + _TIE) ** 2 + slack
            if len(x) > self.k + 1 and np.count_nonzero(d2 <= reach[:, None]) > 4 * (self.k + 1) * len(part):
                last = np.sqrt(np.maximum(0.0, np.partition(d2, self.k, axis=1)[:, self.k] + slack))
                reach = np.minimum(reach, (last * (1 + 1e-9) + _TIE) ** 2 + slack)
            i, j = np.nonzero(d2 <= reach[:, None])
            for a in range(0, len(i), most):
                u, w = part[i[a : a + most]], j[a : a + most]
                src.append(u)
                dst.append(w)
                dist.append(np.sqrt(((x[w] - self.q[u]) ** 2).sum(axis=1)))
        found = names.take(pa.array(np.concatenate([*dst, np.zeros(0, int)])))
        self.src, self.dist = np.concatenate(src), np.concatenate(dist)
        self.dst = found if self.dst is None else pa.concat_arrays([self.dst, found])
        self._prune()

    def _prune(self) -> None:
        order = np.lexsort((self.dist, self.src))
        src, dist = self.src[order], self.dist[order]
        start = np.searchsorted(src, np.arange(len(self.q)))
        # The k + 1 nearest: one may be the row itself.
        end, last = np.append(start[1:], len(src)), start + self.k
        full = last < end
        self.bound[full] = np.minimum(self.bound[full], dist[last[full]])
        stays = dist <= self.bound[src] * (1 + 1e-9) + _TIE
        self.src, self.dist, self.dst = src[stays], dist[stays], self.dst.take(pa.array(order[stays]))


class PivotIndex:
    """An index over ``vectors``; at most ``pivots`` cells, from about ``sample`` vectors."""

    def __init__(self, vectors: DataFrame, id_col: str = "sample", vec: str = "vec", k: int = 10, pivots: int | None = None, sample: int = 8192, block: int = 4096):
        self.k, self.block = k, block
        self.rows = vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL")
        self.kind = self.rows.schema["id"].dataType.simpleString()
        # Equal vectors are one; of their ids only the k + 1 smallest can be anyone's neighbours.
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        self.members = self.rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
        reps = self.members.select("rep", "v")
        n = reps.count()
        some = reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000_000)) < int(min(1.0, sample / max(1, n)) * 1_000_000_000)) if n > sample else reps
        drawn = np.array([r["v"] for r in some.orderBy(F.xxhash64("rep"), "rep").limit(2 * sample).collect()], float)
        self.n, self.dim = n, drawn.shape[1] if len(drawn) else 1
        self.pivots = means(drawn, min(pivots or max(1, int(n**0.5)), 4096, max(1, len(drawn)))) if len(drawn) else np.zeros((1, 1))
        at = self.pivots

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _distances(_matrix(b.column("v")), at)
                cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], ["rep", "v", "cell", "r"])

        self.table = reps.mapInArrow(assign, f"rep {self.kind}, v array<double>, cell int, r double")
        # A row a cell: at most 4,096.
        got = {r["cell"]: r for r in self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
        of = lambda c, none: np.array([got[i][c] if i in got else none for i in range(len(self.pivots))], float)
        self.size, self.low, self.high = of("n", 0), of("low", np.inf), of("high", -np.inf)
        blocks = F.element_at(F.array(*(F.lit(max(1, -(-int(s) // block))) for s in self.size)), F.col("cell") + 1)
        self.points = self.table.select("cell", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.col("rep").alias("dst"), F.col("v").alias("w"))

    def _requests(self, queries: DataFrame, probes: int) -> DataFrame:
        """``(src, v, within, cell)`` for ``queries (src, v, within)``."""
        at, first = self.pivots, "within" not in queries.columns
        # Tasks get the cells' numbers, not the index with its DataFrames.
        ask = Cells(self.size, self.low, self.high, self.k).to_ask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                within = None if first else b.column("within").to_numpy()
                cells = ask(_distances(_matrix(b.column("v")), at), within, probes)
                rows, asked = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate([*cells, np.zeros(0, int)])
                for k in range(0, len(rows), _REQUESTS):
                    which = pa.array(rows[k : k + _REQUESTS], pa.int64())
                    bound = pa.array(np.full(len(which), np.inf)) if first else b.column("within").take(which)
                    yield pa.RecordBatch.from_arrays([b.column("src").take(which), b.column("v").take(which), bound, pa.array(asked[k : k + _REQUESTS], pa.int32())], ["src", "v", "within", "cell"])

        return queries.mapInArrow(run, f"src {self.kind}, v array<double>, within double, cell int")

    def _search(self, requests: DataFrame) -> DataFrame:
        """``(src, dst, dist)``: of each cell asked for, the ``k`` nearest not beyond ``within``."""
        k, block, kind = self.k, self.block, self.kind
        parts = requests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        left = requests.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int"))
        blocks = self.points.select("cell", "block").distinct()
        asked = left.select("cell", "part", "src", "v", "within").join(F.broadcast(blocks), "cell")
        held = self.points.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("part").alias("p"), "dst", "w")

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            q, x = _matrix(left.column("v")), _matrix(right.column("w"))
            within = left.column("within").to_numpy()
            src, dst, dist = [], [], []
            for i, u in enumerate(q if len(x) else ()):
                d = np.sqrt(((x - u) ** 2).sum(axis=1))
                # The k + 1 nearest (one may be the query itself) and all ties with the last.
                last = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
                near = np.flatnonzero(d <= min(last, within[i]) * (1 + 1e-9) + _TIE)
                src.append(np.full(len(near), i))
                dst.append(near)
                dist.append(d[near])
            src, dst, dist = (np.concatenate([*c, np.zeros(0, t)]) for c, t in ((src, int), (dst, int), (dist, float)))
            names, others = left.column("src").combine_chunks().take(pa.array(src)), right.column("dst").combine_chunks().take(pa.array(dst))
            return pa.Table.from_arrays([names, others, pa.array(dist, pa.float64())], ["src", "dst", "dist"])

        found = asked.groupBy("cell", "block", "part").cogroup(held.groupBy("c", "b", "p")).applyInArrow(run, f"src {kind}, dst {kind}, dist double")
        return found.filter("src != dst")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("src").orderBy(F.round("dist", 9), "dst")
        return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)

    def _reps(self, probes: int | None) -> DataFrame:
        """Neighbours among distinct vectors."""
        every = self.table.select(F.col("rep").alias("src"), "v")
        first = self._best(self._search(self._requests(every, probes or 1)), self.k)
        if probes is not None:
            return first
        # The k-th distance so far is the bound; where there are fewer others, all must be seen.
        bound = first.groupBy("src").agg(F.max("dist").alias("within"), F.count(F.lit(1)).alias("n")).select("src", F.when(F.col("n") < self.k, F.lit(float("inf"))).otherwise(F.col("within")).alias("within"))
        return self._best(self._within(bound), self.k)

    def _within(self, bound: DataFrame) -> DataFrame:
        """``(src, dst, dist)`` for every vector: the nearest of all that are ``bound (src, within)`` away
        at most, ``k`` of them or more, from each part of the table."""
        k, at, cells = self.k, self.pivots, Cells(self.size, self.low, self.high, self.k)
        may = cells.may
        # Cells side by side fill a block; large ones fill several.
        first, parts, n, room = [], [], -1, 0
        for s in self.size.astype(int).tolist():
            several = max(1, -(-s // self.block))
            if several > 1 or s > room:
                n, room = n + 1, self.block
            first.append(n)
            parts.append(several)
            n, room = n + several - 1, 0 if several > 1 else room - s
        blocks, first, parts = max(1, n + 1), np.array(first), np.array(parts)
        of = lambda x: F.element_at(F.array(*(F.lit(int(c)) for c in x)), F.col("cell") + 1)
        dealt = self.table.select("rep", "v", (of(first) + F.pmod(F.xxhash64("rep"), of(parts))).cast("int").alias("b"))
        held = dealt.groupBy("b").agg(F.collect_list(F.struct("rep", "v")).alias("r")).select("b", F.col("r.rep").alias("dst"), F.flatten("r.v").alias("w"))
        asks = dealt.join(bound, F.col("rep") == F.col("src"), "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
        asked = asks.groupBy(F.col("b").alias("a")).agg(F.collect_list(F.struct("rep", "v", "within")).alias("q")).select("a", F.col("q.rep").alias("src"), F.flatten("q.v").alias("v"), "q.within")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = best = src = wants = None

            def found() -> pa.RecordBatch:
                dst = best.dst if best.dst is not None else src[:0]
                return pa.RecordBatch.from_arrays([src.take(pa.array(best.src)), dst, pa.array(best.dist)], ["src", "dst", "dist"])

            for b in batches:
                for r in range(b.num_rows):
                    a = b.column("a")[r].as_py()
                    if a != now:
                        if now is not None:
                            yield found()
                        src = b.column("src")[r].values
                        q, within = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("v", "within"))
                        q = q.reshape(len(src), -1)
                        now, best, wants = a, Best(q, within, k), np.zeros((len(q), blocks), bool)
                        for i, row in enumerate(_distances(q, at)):
                            own = may(row, within[i])
                            for s in np.unique(parts[own]):
                                starts = first[own & (parts == s)]
                                for more in range(s):
                                    wants[i, starts + more] = True
                    rows = np.flatnonzero(wants[:, b.column("b")[r].as_py()])
                    if len(rows):
                        names = b.column("dst")[r].values
                        best.see(rows, b.column("w")[r].values.to_numpy(zero_copy_only=False).reshape(len(names), -1), names)
            if now is not None:
                yield found()

        # A block of queries stays with a task, which sees a few blocks of vectors, one at a time.
        left, right = asked.repartition(blocks, "a"), held.repartition(-(-blocks // _BLOCKS), "b").hint("shuffle_replicate_nl")
        met = cut(left.crossJoin(right).mapInArrow(run, f"src {self.kind}, dst {self.kind}, dist double"), "neighbours", batch_rows=1)
        return met.filter("src != dst")

    def nearest(self, probes: int | None = None) -> DataFrame:
        """``(src, dst, dist, place)``: the ``k`` nearest others of each row, ties by id; exact, or in
        the ``probes`` nearest cells."""
        near = self._reps(probes)
        ids = self.members.select(F.col("rep").alias("dst"), "ids")
        other = near.join(ids, "dst").select(F.col("src").alias("rep"), F.explode(F.transform("ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("id")))).alias("c"))
        own = self.members.select("rep", F.explode(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")))).alias("c"))
        w = Window.partitionBy("rep").orderBy(F.round("c.dist", 9), "c.id")
        best = other.unionByName(own).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= self.k + 1)
        lists = best.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda s: s["c"]).alias("list"))
        # A row's list leaves out itself; rows of one vector share the list.
        named = self.members.select("rep", F.col("v").alias("u"))
        of = self.rows.join(named, F.col("v") == F.col("u")).select("id", "rep").join(lists, "rep")
        mine = of.select(F.col("id").alias("src"), F.slice(F.filter("list", lambda c: c["id"] != F.col("id")), 1, self.k).alias("list"))
        return mine.select("src", F.posexplode("list").alias("at", "c")).select("src", F.col("c.id").alias("dst"), F.col("c.dist").alias("dist"), (F.col("at") + 1).alias("place"))

    def candidates(self, probes: int | None = None) -> DataFrame:
        """How many vectors a row looks at: ``n, mean, most``, over all distinct vectors."""
        every = self.table.select(F.col("rep").alias("src"), "v")
        asked = self._requests(every, probes or 1).select("src", "cell")
        if probes is None:
            first = self._best(self._search(self._requests(every, 1)), self.k).groupBy("src").agg(F.max("dist").alias("within"))
            asked = asked.unionByName(self._requests(every.join(first, "src").select("src", "v", "within"), 1).select("src", "cell"))
        size = F.element_at(F.array(*(F.lit(int(s)) for s in self.size)), F.col("cell") + 1)
        return asked.groupBy("src").agg(F.sum(size).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.max("c").alias("most"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours found; one at the same distance as a missing one counts."""
    last = exact.groupBy("src").agg(F.max("dist").alias("last"), F.count(F.lit(1)).alias("k"))
    hit = approximate.join(last, "src").filter(F.round("dist", 9) <= F.round("last", 9)).groupBy("src").agg(F.count(F.lit(1)).alias("hit"))
    met = last.join(hit, "src", "left")
    return met.agg(F.sum("k").alias("n"), (F.sum(F.least("k", F.coalesce("hit", F.lit(0)))) / F.sum("k")).alias("recall"))
