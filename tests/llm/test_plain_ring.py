"""Shards against a ring that is walked one row at a time."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ephemera.llm import ring


def walked(rows, shards, vnodes, room, cells):
    """(id, crc, size) -> shard of rows (cell, order, id, crc, size): first the own node's shard, then clockwise to the next with room."""
    nodes = sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(shards) for v in range(vnodes))
    load, out, waiting = [0] * shards, {}, []
    for row in sorted(rows):
        at = next((k for k, (cell, _) in enumerate(nodes) if cell >= row[0]), 0)
        if load[nodes[at][1]] < room[nodes[at][1]]:
            load[nodes[at][1]] += 1
            out.setdefault(row[2:], []).append(nodes[at][1])
        else:
            waiting.append((row, at))
    for row, at in waiting:
        s = next(nodes[(at + k) % len(nodes)][1] for k in range(1, len(nodes) + 1) if load[nodes[(at + k) % len(nodes)][1]] < room[nodes[(at + k) % len(nodes)][1]])
        load[s] += 1
        out.setdefault(row[2:], []).append(s)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("shards,slack", [(16, None), (5, None), (7, 0.1)])
def test_rows_stand_where_a_walk_puts_them(spark, sf, shards, slack):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    # one id with many texts, one with many copies, one without a text
    docs = docs.unionByName(spark.range(60).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))).unionByName(spark.range(90).select(F.lit(9).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    docs = docs.unionByName(spark.createDataFrame([(77, None)], "doc_id long, text string"))
    cells = 512
    rows = docs.select("doc_id", "text", ring.cell_of(F.col("doc_id"), cells).alias("cell"), F.xxhash64("doc_id", F.lit("order")).alias("o")).collect()
    own = [(r["cell"], r["o"], r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in rows]
    room = [len(own) // shards + (s < len(own) % shards) for s in range(shards)] if slack is None else [-int(-(1 + slack) * len(own) // shards)] * shards
    want = walked(own, shards, 8, room, cells)
    got, slots = {}, {}
    for r in ring.shard(spark, docs, shards, 8, slack, cells=cells).collect():
        got.setdefault((r["doc_id"], r["text_crc32"], r["size"]), []).append(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
