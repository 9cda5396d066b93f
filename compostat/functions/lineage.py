"""Dotted lineages of ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus")


def parse_lineage(c: Column, n_ranks: int = len(RANKS)) -> Column:
    """The ranks as an array; the last one keeps any further dots.  Fewer ranks raise."""
    parts = F.split(c, "[.]", n_ranks)
    bad = F.raise_error(F.concat(F.lit(f"a lineage needs {n_ranks} ranks: "), c))
    return F.when(c.isNull() | (F.size(parts) == n_ranks), parts).otherwise(bad.cast("array<string>"))


def _resolved(parts: Column) -> Column:
    return F.filter(parts, lambda x: ~x.isin("NA", ""))


def genus_label(parts: Column, full: Column, lowest: int = 3) -> Column:
    """The last resolved rank among ranks ``lowest``.. (counted from 1), else the full text."""
    tail = F.slice(parts, lowest, 1_000)
    return F.coalesce(F.try_element_at(_resolved(tail), F.lit(-1)), full)


def last_rank(c: Column) -> Column:
    """The last rank that isn't NA, whichever it is."""
    return F.try_element_at(F.filter(F.split(c, "[.]"), lambda x: x != "NA"), F.lit(-1))


def prefixes(parts: Column) -> Column:
    """All proper prefixes, shortest first."""
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice(parts, 1, k))).otherwise(F.array().cast("array<array<string>>"))
