"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of the ring. Counts by cell are all that the driver sees, whatever the input's size.
CELLS = 1 << 16
#: Rows of one repeated key that are unfolded at a time.
FOLD = 4096


def virtual_nodes(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order. A shard's nodes do not depend on how many shards there are."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float | None) -> list[int]:
    """Most rows of each shard: ceil((1 + slack) * mean), or with slack None exact parts that differ by one at most."""
    if slack is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-(1 + slack) * total // shards)] * shards


def placements(counts: dict[int, int], shards: int, vnodes: int, slack: float | None, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): which ranks of each cell go where.

    Each cell's rows go to the next virtual node clockwise. A shard takes rows in ring order until it is full; what
    is left of a cell goes on clockwise to the next node whose shard has room.
    """
    ring = virtual_nodes(shards, vnodes, cells)
    room, used, out, over = capacities(sum(counts.values()), shards, slack), [0] * shards, [], []

    def place(cell: int, first: int, end: int, shard: int) -> int:
        take = min(end - first, room[shard] - used[shard])
        if take > 0:
            out.append((cell, first, first + take, shard, used[shard]))
            used[shard] += take
        return first + take

    node = 0
    for cell in sorted(counts):
        while node < len(ring) and ring[node][0] < cell:
            node += 1
        own = node % len(ring)
        first = place(cell, 0, counts[cell], ring[own][1])
        if first < counts[cell]:
            over.append((cell, first, counts[cell], own))
    for cell, first, end, own in over:
        for step in range(1, len(ring) + 1):
            first = place(cell, first, end, ring[(own + step) % len(ring)][1])
            if first == end:
                break
    return out


def cell_of(key: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("ring")), F.lit(cells)).cast("int")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float | None = None, key: str = "doc_id", cells: int = CELLS) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 is 0 for a null text. With slack None the shards'
    row counts differ by one at most; else no shard holds more than ceil((1 + slack) * rows / shards). Slots of a
    shard count from 0 without gaps.

    The key's hash picks a cell of the ring. Rows are counted by cell (cells is a constant, so the counts have a fixed
    bound), the overflow of full shards is worked out on these counts, and each row finds its place by its rank in its
    cell. Rows alike in key, size and text_crc32 are one weighted row until the end, so a key with a third of all rows
    is one row in its cell. A null key is a key like others; an empty table gives no rows; other columns are ignored.
    Rows that tie in all of key, size and text_crc32 get different slots; which gets which cannot be told.
    """
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    counts = {r[0]: r[1] for r in docs.groupBy(cell_of(F.col(key), cells)).count().collect()}
    plan = placements(counts, shards, vnodes, slack, cells)
    parts = spark.createDataFrame(plan, "cell int, part_first long, part_end long, shard int, part_slot long")
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("cell", cell_of(F.col(key), cells))
    order = Window.partitionBy("cell").orderBy(F.xxhash64(key, F.lit("order")), key, "text_crc32", "size")
    ranked = once.withColumn("row_end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # parts has a row per cell and one per shard that fills up, so its size is bounded by the ring's constants
    placed = ranked.join(F.broadcast(parts), "cell").where((F.col("part_first") < F.col("row_end")) & (F.col("part_end") > F.col("row_end") - F.col("n")))
    first = F.greatest("part_first", F.col("row_end") - F.col("n"))
    spread = placed.withColumns({"slot0": F.col("part_slot") + first - F.col("part_first"), "many": F.least("part_end", "row_end") - first})
    spread = spread.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / FOLD))))
    spread = spread.withColumn("unfold", F.explode(F.sequence(F.col("fold") * FOLD, F.least(F.col("many"), (F.col("fold") + 1) * FOLD) - 1)))
    return spread.select(key, "size", "text_crc32", "shard", (F.col("slot0") + F.col("unfold")).alias("slot"))
