"""Rank tests of sparse values: a sorted list of zeros, a few cells ranked in it.

A sample's absent taxa all have its zero value, so the absent values of a contrast are one
list per arm, the same for every taxon.  U counts the pairs of a case and a control in which
the case's value is larger (ties half).  Over the lists that count is taken once; a taxon
changes it by the few samples in which it is present: their zeros go, their values come, each
placed in the sorted lists by binary search.  No dense cell is made anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import _block, _cells


def pairs_above(a: np.ndarray, b: np.ndarray) -> float:
    """Pairs in which a's value is above b's, ties half; ``b`` sorted."""
    return float((np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).sum()) / 2


class Zeros:
    """The zero values of a contrast, by arm."""

    def __init__(self, y: np.ndarray, zero: np.ndarray):
        self.case, self.control = np.sort(zero[y == 1]), np.sort(zero[y == 0])
        self.all = np.sort(zero)
        self.u = pairs_above(self.case, self.control)
        n = np.unique(self.all, return_counts=True)[1].astype(float)
        self.ties = float((n**3 - n).sum())

    def test(self, y: np.ndarray, v: np.ndarray, zero: np.ndarray) -> tuple[float, float]:
        """U and the sum of t^3 - t over ties, of a taxon with these cells."""
        up, low = y == 1, y == 0
        z1, z0, v1, v0 = np.sort(zero[up]), np.sort(zero[low]), v[up], np.sort(v[low])
        cases_below = lambda x: len(self.case) * len(x) - pairs_above(x, self.case)
        u = self.u - pairs_above(z1, self.control) - cases_below(z0) + pairs_above(z1, z0)
        u += pairs_above(v1, self.control) - pairs_above(v1, z0)  # present cases, absent controls
        u += cases_below(v0) - pairs_above(z1, v0)  # absent cases, present controls
        u += pairs_above(v1, v0)
        touched, at = np.unique(np.concatenate([v, zero]), return_inverse=True)
        before = (np.searchsorted(self.all, touched, "right") - np.searchsorted(self.all, touched, "left")).astype(float)
        change = np.zeros(len(touched))
        np.add.at(change, at[: len(v)], 1)
        np.add.at(change, at[len(v) :], -1)
        after = before + change
        return u, self.ties + float((after**3 - after - before**3 + before).sum())


def sparse_rank_sums(values: DataFrame, rows: DataFrame, scenario: Sequence[str] = (), taxa: DataFrame | None = None, cells_per_task: int = 500_000) -> DataFrame:
    """``(.., taxon, n_case, n_control, u, rank_biserial, ties)`` of every contrast in ``rows``
    (``contrast_rows``; those that miss a covariate don't count) for each taxon present in it,
    or for all of ``taxa``.  A task has a contrast's zeros (a number a sample) and about
    ``cells_per_task`` of its cells.  Null with under 3 in an arm or nothing that varies."""
    block = _block(scenario)
    whole = rows.filter("complete").select(*block, "sample", "y", "zero")
    cells = _cells(whole, values, scenario).select(*block, "taxon", F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"), F.col("zero").cast("double").alias("zero"))
    # A contrast without a present cell still has its zeros.
    sizes = cells.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / cells_per_task).cast("int").alias("parts"))
    sizes = whole.select(*block).distinct().join(sizes, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("taxon"), F.col("parts")).cast("int"))
    dealt = part(cells.join(sizes, block)).drop("parts")
    lists = whole.join(sizes, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*block, "part", F.col("y").cast("int").alias("y"), F.col("zero").cast("double").alias("zero"))
    # Both sides come from the same rows: other names keep their columns apart.
    lists = lists.toDF(*(f"__{c}" for c in lists.columns))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        zeros = Zeros(right.column("__y").to_numpy(), right.column("__zero").to_numpy())
        n1, n0 = len(zeros.case), len(zeros.control)
        found = [(None, zeros.u, zeros.ties)]
        if left.num_rows:
            coded = left.column("taxon").combine_chunks().dictionary_encode()
            of = coded.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            y, v, z = (left.column(c).to_numpy()[order] for c in ("y", "v", "zero"))
            edge = np.append(np.flatnonzero(np.append(True, np.diff(of[order]) != 0)), len(of))
            names = coded.dictionary.to_pylist()
            found += [(names[of[order[a]]], *zeros.test(y[a:b], v[a:b], z[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        taxon, u, ties = zip(*found, strict=True)
        n = len(found)
        cols = [pa.array([k.as_py()] * n, k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*cols, pa.array([key[-1].as_py()] * n, pa.int32()), pa.array(taxon, pa.string()), pa.array([n1] * n, pa.int64()), pa.array([n0] * n, pa.int64()), pa.array(u, pa.float64()), pa.array(ties, pa.float64())], [*block, "part", "taxon", "n_case", "n_control", "u", "ties"])

    spec = ", ".join(f"{c} {kinds[c]}" for c in block) + ", part int, taxon string, n_case bigint, n_control bigint, u double, ties double"
    got = dealt.groupBy(*block, "part").cogroup(lists.groupBy(*(f"__{c}" for c in (*block, "part")))).applyInArrow(run, spec)
    if taxa is None:
        got = got.filter("taxon IS NOT NULL")
    else:
        # Taxa absent from a contrast have what its zeros give.
        none = got.filter("taxon IS NULL AND part = 0").drop("taxon", "part")
        grid = part(none.join(sizes, block).crossJoin(taxa.select("taxon").distinct())).drop("parts")
        mine = got.filter("taxon IS NOT NULL").select(*block, "taxon", F.col("u").alias("__u"), F.col("ties").alias("__ties"))
        got = grid.join(mine, [*block, "taxon"], "left").withColumns({"u": F.coalesce("__u", "u"), "ties": F.coalesce("__ties", "ties")})
    n = F.col("n_case") + F.col("n_control")
    good = (F.col("n_case") >= 3) & (F.col("n_control") >= 3) & (F.col("ties") < (n * n * n - n).cast("double"))
    u = F.when(good, F.col("u"))
    return got.select(*block, "taxon", "n_case", "n_control", u.alias("u"), (2.0 * u / (F.col("n_case") * F.col("n_control")) - 1.0).alias("rank_biserial"), "ties")
