"""Removal of repeated byte strings by suffix sorting: shared anchors deal suffixes out, deep-shallow sorting orders them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, prefix_hash, slices, span_hash, string_parts, written

#: A string of LENGTH bytes that starts at two places is removed at both.
LENGTH = 200
#: Bytes of an anchor. Every string of LENGTH bytes holds LENGTH - ANCHOR + 1 such substrings; its anchor is the one
#: with the least hash, the first of equals, so equal strings have equal anchors at equal places.
ANCHOR = 80
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 40
#: Anchors with more differing surroundings than this compare 128-bit hashes of the strings, counted by Spark.
CROWD = 4096
#: Suffixes that a task sorts at a time, unless one anchor has more.
BATCH = 400_000


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, whose order is the bytes' order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(data)]
    return out


def deep_shallow(words: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """The order of suffixes by (group, first limit bytes); suffixes equal that far keep their order.

    First multikey quicksort with 8 bytes as a key: each step splits the runs of suffixes that are still equal, and
    runs of one are done. At shallow bytes the remaining runs go into blind tries, built path by path: a run's first
    suffix is a path from the root to a leaf, the others leave it at the node where they first differ, and of the edge
    that they leave by only the first 8 bytes count. Those that leave by one edge form the next run, a path that begins
    behind these bytes, so that no byte of a suffix is looked at twice.
    """
    order = np.argsort(group, kind="stable")
    run = group[order]
    run = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])]) if len(run) else run
    open_ = np.flatnonzero(_shared(run))
    for depth in range(0, min(shallow, limit), 8):
        if not len(open_):
            return order
        key = _masked(words, starts[order[open_]], depth, limit)
        open_, run = _split(order, open_, run, (key,))
    known = np.full(len(starts), -(-min(shallow, limit) // 8) * 8)  # bytes in which a suffix equals its run's
    while len(open_) and shallow < limit:
        own, rows = run[open_], order[open_]
        head = open_[np.searchsorted(own, own)]
        lcp, mine, other = _first_difference(words, starts[rows], starts[order[head]], known[rows], limit)
        known[rows] = lcp + 8
        side = np.sign((mine > other).astype(np.int8) - (mine < other).astype(np.int8))
        # smaller suffixes leave the path from the top down, then those on the path, then larger ones from the bottom up
        open_, run = _split(order, open_, run, (mine, np.where(side > 0, -lcp, lcp), side), done=side == 0)
    return order


def _shared(run: np.ndarray) -> np.ndarray:
    """True where a row's run has a neighbour."""
    same = run[1:] == run[:-1]
    return np.concatenate([same, [False]])[: len(run)] | np.concatenate([[False], same])[: len(run)]


def _split(order: np.ndarray, open_: np.ndarray, run: np.ndarray, keys: tuple[np.ndarray, ...], done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the open places' runs by keys (the last is the first to count), in place; the places still open, and runs."""
    own = run[open_]
    by = np.lexsort((*keys, own))
    order[open_] = order[open_[by]]
    new = own[by][1:] != own[by][:-1]
    for k in keys:
        new |= k[by][1:] != k[by][:-1]
    split = np.concatenate([[0], np.cumsum(new)])
    still = _shared(split)
    if done is not None:
        still &= ~done[by]
    out = np.zeros(len(run), np.int64)
    out[open_] = split
    return open_[still], out


def _masked(words: np.ndarray, at: np.ndarray, depth: int | np.ndarray, limit: int) -> np.ndarray:
    """The word depth bytes on, without bytes from limit on; zeros follow the end."""
    place = at + depth
    key = words[np.minimum(place, len(words) - 1)]
    key = np.where(place < len(words), key, np.uint64(0))
    return key >> (8 * np.maximum(depth + 8 - limit, 0)).astype(np.uint64)


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of suffixes equal in known bytes: the first step where their words differ (limit if none), and their words there."""
    where, mine, other = np.full(len(a), limit), np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    left, depth = np.arange(len(a)), known.copy()
    while len(left := left[depth[left] < limit]):
        d = depth[left]
        x, y = _masked(words, a[left], d, limit), _masked(words, b[left], d, limit)
        off = x != y
        at = left[off]
        where[at], mine[at], other[at] = d[off], x[off], y[off]
        left = left[~off]
        depth[left] += 8
    return where, mine, other


def repeated(words: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """True for suffixes whose first limit bytes are also those of another suffix of the group."""
    order = deep_shallow(words, starts, group, limit)
    a, b = order[:-1], order[1:]
    lcp, _, _ = _first_difference(words, starts[a], starts[b], np.zeros(len(a), np.int64), limit)
    same = (lcp == limit) & (group[a] == group[b])
    out = np.zeros(len(starts), bool)
    out[a[same]] = out[b[same]] = True
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, anchor position (all of one anchor's strings), anchor hash and surroundings' hash."""
    wide, n = length - anchor + 1, len(data) - anchor + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    at = np.arange(n)
    low = np.uint64((1 << 30) - 1)
    value = span_hash(prefix, at, at + anchor) & ~low | at.astype(np.uint64)
    padded = np.full(-(-n // wide) * wide, np.uint64(2**64 - 1))
    padded[:n] = value
    table = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(len(data) - length + 1)
    least = np.minimum(behind[start], ahead[start + wide - 1])
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    start, row, place = start[inside], row[inside], (least[inside] & low).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    begin, end, place, row = start[first], start[last], place[first], row[first]
    around = mixed(span_hash(prefix, begin, end + length) + (place - begin).astype(np.uint64))
    base = offsets[row]
    return row, begin - base, end - base, place - base, span_hash(prefix, place, place + anchor), around


#: again: 0 for surroundings met once in a slice of the input, 1 for the first of several, 2 for the others.
_ANCHOR_ROW = "k long, s long, doc long, more int, first int, last int, place int, again int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text. What recurs within a slice is settled here: only its first row goes to the anchor's
    others, the rest are dealt out evenly, so that copies and periodic texts do not gather at one place."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        more = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = string_parts(batch.column(2))
        for lo, _, part, cuts in slices(data, offsets):
            row, first, last, place, k, s = anchors(part, cuts)
            order = np.lexsort((s, k))
            same = (k[order][1:] == k[order][:-1]) & (s[order][1:] == s[order][:-1])
            after, before = np.concatenate([same, [False]])[: len(k)], np.concatenate([[False], same])[: len(k)]
            again = np.zeros(len(k), np.int64)
            again[order] = np.where(before, 2, after)
            k = np.where(again == 2, mixed(k + (ids[lo + row].view(np.uint64) + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)), k)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ids[lo + row]), pa.array(more[lo + row]), *(pa.array(x.astype(np.int32)) for x in (first, last, place, again))], [f.split()[0] for f in _ANCHOR_ROW.split(", ")])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k and s, those whose k is not alone: copy (the same s is there again), and lead (the first of its s)."""
    kept: pa.Table | None = None
    before: tuple[int, int] | None = None

    def judged(table: pa.Table, after: tuple[int, int] | None) -> pa.RecordBatch:
        k, s = (table.column(i).to_numpy() for i in (0, 1))
        k1 = np.concatenate([[before[0] if before else 0], k, [after[0] if after else 0]])
        s1 = np.concatenate([[before[1] if before else 0], s, [after[1] if after else 0]])
        same = k1[1:] == k1[:-1]
        same[0] &= before is not None
        same[-1] &= after is not None
        equal = same & (s1[1:] == s1[:-1])
        again = table.column(7).to_numpy()
        out = table.append_column("copy", pa.array(equal[1:] | equal[:-1] | (again > 0))).append_column("lead", pa.array(~equal[:-1] & (again < 2)))
        return out.filter(pa.array(same[1:] | same[:-1] | (again > 0))).combine_chunks()

    for batch in batches:
        if not len(batch):
            continue
        if kept is not None:
            yield from judged(kept, (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())).to_batches()
            before = kept.column(0)[-1].as_py(), kept.column(1)[-1].as_py()
        kept = pa.Table.from_batches([batch])
    if kept is not None:
        yield from judged(kept, None).to_batches()


_PIECE = "k long, h1 long, h2 long, doc long, more int, first int, last int, place int, copy boolean, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor asked for; of a crowded anchor instead a row with the hash of each string."""
    names = [f.split()[0] for f in _PIECE.split(", ")]
    for batch in batches:
        for doc, more, text, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
            doc, more = doc.as_py(), more.as_py()
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            wanted = asked.as_py()
            crowded = [w for w in wanted if w["crowd"]]
            rows = [(w["k"], 0, 0, doc, more, w["first"], w["last"], w["place"], w["copy"], data[w["first"] : w["last"] + LENGTH].tobytes()) for w in wanted if not w["crowd"]]
            if crowded:
                prefix, other = prefix_hash(data), prefix_hash(255 - data)
                for w in crowded:
                    p = np.arange(w["first"], w["last"] + 1)
                    h1, h2 = (span_hash(x, p, p + LENGTH).view(np.int64).tolist() for x in (prefix, other))
                    rows += [(w["k"], a, b, doc, more, i, i, w["place"], w["copy"], None) for a, b, i in zip(h1, h2, p.tolist(), strict=True)]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sorted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts whose strings recur, from pieces sorted by k."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        data, cuts = string_parts(pa.array([r[6] for r in rows], pa.binary()))
        key, doc, more, first, last, place = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        n = last - first + 1
        piece = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        # equal strings have their anchor at an equal distance
        ident = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])[piece] * (1 << 20) + (place - first)[piece] - step
        hit = np.flatnonzero(repeated(words_at(data), cuts[piece] + step, ident))
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0)
        a = hit[new]
        b = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1] if len(hit) else hit
        return pa.RecordBatch.from_arrays([pa.array(doc[piece[a]]), pa.array(more[piece[a]].astype(np.int32)), pa.array((first[piece[a]] + step[a]).astype(np.int32)), pa.array((first[piece[b]] + step[b]).astype(np.int32))], ["doc", "more", "first", "last"])

    held: list[tuple] = []
    weight = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if weight >= BATCH and row[0] != held[-1][0]:
                yield judge(held)
                held, weight = [], 0
            held.append(row)
            weight += row[4] - row[3] + 1
    if held:
        yield judge(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["first"], r["last"] + LENGTH) for r in ranges.as_py() or []):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            edges = [0, *(x for s in spans for x in s), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def row_key() -> list[Column]:
    """doc, more: 96 bits of hashes of a row's id and text, by which rows are told apart. Rows equal in both are copies.

    Among 10**11 different rows two have one key with a probability of 1e-7.
    """
    return [F.xxhash64("doc_id", "text").alias("doc"), F.hash("doc_id", "text").alias("more")]


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc, more, first, last: starts first..last of the row with this key all begin strings that start elsewhere too."""
    rows = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= LENGTH)
    dealt = rows.mapInArrow(_anchor_rows, _ANCHOR_ROW).repartition("k").sortWithinPartitions("k", "s")
    paired = written(spark, dealt.mapInArrow(_paired, _ANCHOR_ROW + ", copy boolean, lead boolean"), "anchors")
    # surroundings that recur are settled; the others are compared with one another and with one of each recurring kind
    counts = paired.where("lead").groupBy("k").agg(F.count("*").alias("kinds"), F.count_if(~F.col("copy")).alias("single")).where("kinds > 1 AND single > 0")
    asked = paired.where("lead").join(counts.select("k", (F.col("kinds") > CROWD).alias("crowd")), "k")
    asked = asked.groupBy("doc", "more").agg(F.collect_list(F.struct("k", "first", "last", "place", "copy", "crowd")).alias("asked"))
    pieces = written(spark, rows.dropDuplicates(["doc", "more"]).join(asked, ["doc", "more"]).mapInArrow(_pieces, _PIECE), "pieces")
    few = pieces.where("bytes IS NOT NULL").select("k", "doc", "more", "first", "last", "place", "bytes")
    sorted_ = few.repartition("k").sortWithinPartitions("k").mapInArrow(_sorted_pieces, "doc long, more int, first int, last int")
    crowded = pieces.where("bytes IS NULL")
    often = crowded.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hashed = crowded.join(often, ["h1", "h2"]).select("doc", "more", "first", "last")
    return paired.where("copy").select("doc", "more", "first", "last").union(sorted_).union(hashed)


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes): one row per row of docs.

    Each byte is removed that a string of LENGTH bytes covers which also starts anywhere else, in this row or another;
    strings are judged on the input and never cross rows. Null and empty texts have no bytes. Repeated rows are copies
    of one another, and lose all their strings. kept may end within a character. An empty table gives no rows.
    """
    found = repeats(spark, docs).groupBy("doc", "more").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = docs.select("doc_id", "text", *row_key()).join(found, ["doc", "more"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
