"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities.  A flow network (old shard ->
new shard, cost 0 for bytes that stay, 1 for bytes that move, or any cost matrix) is
solved for the block transfers that move the fewest bytes; then the files of the
shards that lose or gain rows are rewritten.  The files of other shards are neither read
nor written: the new layout names them where they lie.

Rows of an old shard are ordered by a 64-bit row hash and counted in ``2**hist_bits``
equal hash ranges, so what comes back to the driver is of fixed size.  A transfer is
a range of that order.  Only the few ranges in which a transfer ends are ordered row
by row to find the hash at which to cut; from then on a row's new shard is a function
of its old shard and hash, computed where the row lies, and texts move once, into the
rewritten files.

Defined cases: a null text has no byte (size 1, CRC of nothing); null, repeated and
tied ids are ordered by hash of id and text, equal rows in the order they were read, so that a cut may part them; a very long text is
a row like any other, so the shards at whose bounds it lies differ by its size at most; an
empty table gives an empty one; other columns are rewritten with their row by ``rewrite``
and left out of ``documents_to_shards``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import files_for, shared_path, text_bytes


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Send all supply within the capacities at least cost; successive shortest paths
    with potentials.  ``cost`` must not be negative; total capacity must suffice."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    source, sink, total = n + m, n + m + 1, n + m + 2
    to, left, price, out = [], [], [], [[] for _ in range(total)]

    def arc(a: int, b: int, most: int, c: int) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((most, 0))
        price.extend((c, -c))
        return len(to) - 2

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    between = [[arc(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    potential = [0] * total
    while True:
        distance, via, heap = [float("inf")] * total, [-1] * total, [(0, source)]
        distance[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for e in out[a]:
                b = to[e]
                if left[e] and d + price[e] + potential[a] - potential[b] < distance[b]:
                    distance[b] = d + price[e] + potential[a] - potential[b]
                    via[b] = e
                    heapq.heappush(heap, (distance[b], b))
        if distance[sink] == float("inf"):
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, distance, strict=True)]
        push, b = min(sum(supply), sum(capacity)), sink
        while b != source:
            push, b = min(push, left[via[b]]), to[via[b] ^ 1]
        b = sink
        while b != source:
            left[via[b]] -= push
            left[via[b] ^ 1] += push
            b = to[via[b] ^ 1]
    return [[left[e + 1] for e in row] for row in between]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _mixed(*cols: Column) -> Column:
    return F.xxhash64(F.lit("row"), *cols)


class Plan:
    """Which hash range of which old shard goes to which new shard."""

    def __init__(self, cuts: list[tuple[int, int | None, int]], moved_bytes: int, total_bytes: int, flow: list[list[int]]):
        self.cuts, self.moved_bytes, self.total_bytes, self.flow = cuts, moved_bytes, total_bytes, flow

    def shard_of(self, old: str, place: str) -> Column:
        """``place`` is the row hash as an order; cuts are upper bounds, inclusive."""
        text, by_old = "CASE ", {}
        for o, upto, new in self.cuts:
            by_old.setdefault(o, []).append((upto, new))
        for o, parts in by_old.items():
            inner = "".join(f"WHEN {place} <= {upto} THEN {new} " for upto, new in parts[:-1])
            inner = f"CASE {inner}ELSE {parts[-1][1]} END" if inner else str(parts[-1][1])
            text += f"WHEN {old} = {o} THEN {inner} "
        return F.expr(text + "ELSE 0 END") if by_old else F.lit(0)

    def affected(self, old_shards: int, new_shards: int) -> list[int]:
        """New shards whose files change: those that lose or gain rows, or are new."""
        out = []
        for j in range(new_shards):
            keeps = j < old_shards and all(not f for k, f in enumerate(self.flow[j]) if k != j)
            gains = any(self.flow[i][j] for i in range(old_shards) if i != j)
            if not keeps or gains:
                out.append(j)
        return out


def plan_transfers(rows: DataFrame, old_shards: int, capacities: list[int] | None, new_shards: int, hist_bits: int = 12) -> Plan:
    """``rows`` has ``__old``, ``__place`` (row hash) and ``__size``."""
    width = 64 - hist_bits
    # shiftright keeps the sign, so the ranges ascend with the hash.
    counted = rows.groupBy("__old", F.shiftright("__place", width).alias("range")).agg(F.sum("__size").alias("bytes")).collect()
    blocks: list[list[tuple[int, int]]] = [[] for _ in range(old_shards)]
    for r in counted:
        blocks[r["__old"]].append((r["range"], r["bytes"]))
    supply = [sum(b for _, b in x) for x in blocks]
    total = sum(supply)
    capacities = capacities or even_capacities(total, new_shards)
    flow = min_cost_flow(supply, capacities, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    whole: list[tuple[int, int | None, int]] = []
    torn: list[tuple[int, int, int, int]] = []  # (position in whole, old, range, bytes into it)
    for i, found in enumerate(blocks):
        parts = [j for j in range(new_shards) if flow[i][j]]
        found.sort()
        k, before, upto = 0, 0, 0
        for j in parts[:-1]:
            upto += flow[i][j]
            while k < len(found) and before + found[k][1] <= upto:
                before += found[k][1]
                k += 1
            torn.append((len(whole), i, found[k][0] if k < len(found) else found[-1][0] + 1, upto - before))
            whole.append((i, None, j))
        if parts:
            whole.append((i, None, parts[-1]))
    if torn:
        spots = sorted({(i, r) for _, i, r, _ in torn})
        inside = rows.withColumn("range", F.shiftright("__place", width)).filter(" OR ".join(f"(__old = {i} AND range = {r})" for i, r in spots))
        order = Window.partitionBy("__old", "range").orderBy("__place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        summed = inside.withColumn("upto", F.sum("__size").over(order))
        # The last row hash that still lies, to the nearest row, before the cut.
        wanted = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(i).alias("i"), F.lit(r).cast("bigint").alias("r"), F.lit(b).cast("bigint").alias("b")) for at, i, r, b in torn))
        cut = summed.select("__old", "range", "__place", "upto", "__size", F.explode(F.filter(wanted, lambda w: (w["i"] == F.col("__old")) & (w["r"] == F.col("range")))).alias("w"))
        found = {r["at"]: r["p"] for r in cut.filter("2 * upto - __size <= 2 * w.b").groupBy("w.at").agg(F.max("__place").alias("p")).collect()}
        for at, i, r, _ in torn:
            whole[at] = (i, found.get(at, (r << width) - 1), whole[at][2])
    moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    return Plan(whole, moved, total, flow)


def layout(df: DataFrame, old_shards: int, old_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``__old``, ``__size``, ``__crc`` and ``__place``.  Without ``old_col`` rows
    lie in old shards by CRC-32 of their id.  A row's place is a hash of id and text; its last
    24 bits are the row's own, so that a cut may fall between equal rows."""
    text = text_bytes(text_col)
    old = F.col(old_col).cast("int") if old_col else (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % old_shards).cast("int")
    return df.withColumns({"__old": old, "__size": F.octet_length(text).cast("bigint") + 1, "__crc": F.crc32(text), "__place": _mixed(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(-1 << 24)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1)))})


def reshard(
    df: DataFrame,
    new_shards: int = 16,
    old_shards: int = 12,
    old_col: str | None = None,
    capacities: list[int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    hist_bits: int = 12,
) -> tuple[DataFrame, Plan]:
    """``df`` with ``__old``, ``__place``, ``__size``, ``__crc`` and ``__shard``, and
    the plan."""
    rows = layout(df, old_shards, old_col, id_col, text_col)
    plan = plan_transfers(rows.select("__old", "__place", "__size"), old_shards, capacities, new_shards, hist_bits)
    return rows.withColumn("__shard", plan.shard_of("__old", "__place")), plan


def write_layout(rows: DataFrame, folder: str, by: str, shard_col: str) -> None:
    """A folder for each shard: ``by`` is its number.  A task takes about half a gigabyte, so
    that the file it writes for each shard isn't small."""
    rows.coalesce(files_for(rows, 512 << 20)).withColumn(shard_col, F.col(by)).write.partitionBy(shard_col).parquet(folder)


def rewrite(old: DataFrame, plan: Plan, folder: str, old_shards: int, new_shards: int) -> DataFrame:
    """Write the files of all shards that lose or gain rows, a folder each; returns the rows
    of the new layout as read from its files.  ``old`` reads the old layout and has
    ``__shard`` (the row's new shard); of untouched shards its own files are read."""
    changed = plan.affected(old_shards, new_shards)
    sources = [i for i in range(old_shards) if any(plan.flow[i][j] for j in changed)]
    if not changed or not sources:
        return old
    # Only folders of shards that give rows to a rewritten one are read.
    write_layout(old.filter(F.col("__old").isin(sources) & F.col("__shard").isin(changed)), folder, "__shard", "__folder")
    back = old.sparkSession.read.schema(old.schema).parquet(folder).select(old.columns)
    same = [j for j in range(min(old_shards, new_shards)) if j not in changed]
    return back.unionByName(old.filter(F.col("__old").isin(same))) if same else back


def with_slots(rows: DataFrame, shard_col: str = "__shard", hist_bits: int = 12) -> DataFrame:
    """Adds ``__slot``: the row's place in its shard, gapless from 0.  Rows are numbered
    within (shard, old shard, hash range); a small table of range counts gives each
    range its first number."""
    width = 64 - hist_bits
    rows = rows.withColumn("__range", F.shiftright("__place", width))
    key = [shard_col, "__old", "__range"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard_col).orderBy("__old", "__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__place")) - 1)
    return inside.join(firsts, key).withColumn("__slot", (F.col("__first") + F.col("__n")).cast("bigint")).drop("__range", "__n", "__first")


def documents_to_shards(df: DataFrame, new_shards: int = 16, old_shards: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the old layout (``old_shards`` folders by a checksum of the id) to the shared
    folder, reshard it, rewrite the affected files, and list all rows: ``(id, size,
    text_crc32, law, shard, slot, grown_shard, moved)``; law ``bytes``."""
    spark = df.sparkSession
    before = shared_path(spark, "shards-before")
    laid = layout(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), old_shards, None, "__id", "__text")
    write_layout(laid, before, "__old", "__folder")
    old = spark.read.schema(laid.schema).parquet(before)
    plan = plan_transfers(old.select("__old", "__place", "__size"), old_shards, None, new_shards)
    placed = with_slots(rewrite(old.withColumn("__shard", plan.shard_of("__old", "__place")), plan, shared_path(spark, "shards"), old_shards, new_shards).drop("__text"))
    return placed.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("__shard") != F.col("__old")).alias("moved"),
    )
