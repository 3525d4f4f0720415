"""Benchmark decontamination by spaced seeds: masked token windows find hits, aligned tokens around them decide."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, powers, slices, string_parts, word_hashes, written

#: Fixed masks: 1 marks a token position that is hashed, 0 one that may differ. Together they see every alignment that
#: counts: no way of placing the changed tokens hides all of needed(n) others from them (the tests count these ways).
MASKS = ("1111", "10111", "101011", "1010011", "1100101", "11001001", "100000111", "1100000011")
#: An item is leaked into a document where at least this share of its tokens stands in place, on one alignment or on near
#: ones, and no fewer than LEAST, or all of a shorter item.
OVERLAP, LEAST = 0.6, 7
#: So many tokens of an item in a row are a leak too, whatever share of the item they are.
VERBATIM = 20
#: Shorter items are refused: a phrase of so few words says nothing about where it comes from.
SHORTEST = 5
#: Bits of the filter that documents' seeds pass: 16 to 32 times the items' seeds, between these powers of two.
FILTER_BITS = range(16, 29)
_PIECE = 1 << 12  # bytes of a filter that are put together at a time


def needed(n: int, overlap: float = OVERLAP) -> int:
    """So many of an item's n tokens must stand in place."""
    return max(math.ceil(overlap * n - 1e-9), min(n, LEAST))


def seed_values(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed of each window: its marked tokens' hashes, each times an own odd number, told apart by mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = powers(np.uint64(0xD6E8FEB86659FD93), len(mask) + 1)
    return mixed(reduce(np.add, (tokens[j : j + n] * odd[j + 1] for j, c in enumerate(mask) if c == "1")) + np.uint64(int(mask, 2)))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, item_id, tokens of each item that is long enough."""
    for batch in batches:
        tokens, row = word_hashes(*string_parts(batch.column(2)))
        at = np.searchsorted(row, np.arange(len(batch) + 1))
        fit = np.flatnonzero(np.diff(at) >= SHORTEST)
        packed = pa.array([tokens[at[i] : at[i + 1]].tobytes() for i in fit], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit)), batch.column(1).take(pa.array(fit)), packed], ["item", "item_id", "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = [seed_values(np.frombuffer(packed, np.uint64), m) for m in MASKS]
            offset = np.concatenate([np.arange(len(v)) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(np.full(len(offset), item)), pa.array(offset)], ["seed", "item", "offset"])


def _pieces(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a filter over these seeds in which a bit is set."""
    own = np.zeros(1 << bits, bool)
    for batch in batches:
        own[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
    packed = np.packbits(own).reshape(-1, min(_PIECE, 1 << bits - 3))
    some = np.flatnonzero(packed.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["piece", "bits"])


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A bit for each leading part of a seed's hash; at most 2 ** FILTER_BITS[-1] bits, whatever the number of items."""
    bits = min(max(FILTER_BITS[0], count.bit_length() + 4), FILTER_BITS[-1])
    # executors set bits; of each piece the driver gets one copy from each of 16 groups of tasks at most
    found = seeds.select("seed").coalesce(16).mapInArrow(functools.partial(_pieces, bits), "piece long, bits binary")
    out = np.zeros((-(-(1 << bits - 3) // _PIECE), min(_PIECE, 1 << bits - 3)), np.uint8)
    for r in found.toLocalIterator():
        out[r["piece"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def doc_seeds(spark: SparkSession, docs: DataFrame, passed: np.ndarray) -> DataFrame:
    """seed, doc, at: the seeds of documents that pass the filter, with the token they begin at."""
    shared, shift = spark.sparkContext.broadcast(passed), np.uint64(64 - (len(passed).bit_length() + 2))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = string_parts(batch.column(1))
            for first, _, part, cuts in slices(data, offsets):
                tokens, row = word_hashes(part, cuts)
                begin = np.searchsorted(row, np.arange(len(cuts)))
                for mask in MASKS:
                    v = seed_values(tokens, mask)
                    place = v >> shift
                    w = np.flatnonzero(bits[place >> np.uint64(3)] & (np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)))
                    w = w[row[w] == row[w + len(mask) - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(v[w].view(np.int64)), pa.array(ids[first + row[w]]), pa.array(w - begin[row[w]])], ["seed", "doc", "at"])

    return docs.select("doc", "text").mapInArrow(seeds, "seed long, doc long, at long")


def together(places: list[tuple[int, np.ndarray]], n: int) -> tuple[int, int]:
    """Most of an item's n tokens that near alignments find together, and the start of the fullest of these.

    Alignments are near if their starts are at most n tokens apart. Tokens of the item and of the document both count
    once each, so that a phrase which the item repeats must be repeated in the document too.
    """
    own, theirs = Counter(), Counter()
    lo, best = 0, (0, 0, 0)
    for hi, (at, same) in enumerate(places):
        own.update(same.tolist())
        theirs.update((same + at).tolist())
        while at - places[lo][0] > n:
            early, gone = places[lo]
            for count, keys in ((own, gone), (theirs, gone + early)):
                for k in keys.tolist():
                    count[k] -= 1
                    if not count[k]:
                        del count[k]
            lo += 1
        best = max(best, (min(len(own), len(theirs)), -lo, -hi))
    count, lo, hi = best[0], -best[1], -best[2]
    return count, max(places[lo : hi + 1], key=lambda p: (len(p[1]), -p[0]))[0]


def longest_run(same: np.ndarray) -> int:
    """The most numbers in a row, of ascending ones."""
    ends = np.flatnonzero(np.concatenate([[True], np.diff(same) != 1, [True]])) if len(same) else np.zeros(2)
    return int(np.diff(ends).max())


def longest_run(same: np.ndarray) -> int:
    """The most numbers in a row, of ascending ones."""
    ends = np.flatnonzero(np.concatenate([[True], np.diff(same) != 1, [True]])) if len(same) else np.zeros(2)
    return int(np.diff(ends).max())


def judged(doc: np.ndarray, item: np.ndarray, starts: list[int], overlap: float) -> tuple[int, int] | None:
    """(start, matching tokens) if the document's tokens overlap the item's enough, or hold VERBATIM of them in a row.

    An alignment lays the whole item onto the document, and counts places whose tokens are equal; those beyond the
    document's ends count as different. The best alignment decides, of equal counts the first in the document. Where it
    has too few, near alignments are taken together, as words put in or left out move the rest of an item; where these
    have too few as well, the best alignment with a verbatim run stands for the pair.
    """
    places = []
    for at in sorted(starts):
        first, end = max(at, 0), min(at + len(item), len(doc))
        places.append((at, np.flatnonzero(doc[first:end] == item[first - at : end - at]) + first - at))
    whole = needed(len(item), overlap)
    at, same = max(places, key=lambda p: (len(p[1]), -p[0]))
    if len(same) >= whole:
        return at, len(same)
    if len(places) > 1:
        count, at = together(places, len(item))
        if count >= whole:
            return at, count
    runs = [p for p in places if len(p[1]) >= VERBATIM and longest_run(p[1]) >= VERBATIM]
    if not runs:
        return None
    at, same = max(runs, key=lambda p: (len(p[1]), -p[0]))
    return at, len(same)


_FIELDS = ["doc_id", "item_id", "start_token", "n_match", "n_item"]


def _verified(overlap: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_parts(batch.column(1))
        ids, asked, out = batch.column(0).to_pylist(), batch.column(2), []
        for first, end, part, cuts in slices(data, offsets):
            tokens, row = word_hashes(part, cuts)
            begin = np.searchsorted(row, np.arange(end - first + 1))
            for r in range(end - first):
                for a in asked[first + r].as_py():
                    item = np.frombuffer(a["tokens"], np.uint64)
                    found = judged(tokens[begin[r] : begin[r + 1]], item, a["starts"], overlap)
                    if found:
                        out.append((ids[first + r], a["item_id"], *found, len(item)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * len(_FIELDS)], _FIELDS)


def refused(benchmark: DataFrame) -> DataFrame:
    """The rows of benchmark that are not searched for: those without an id or text, and those under SHORTEST words."""
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    return benchmark.where(F.col("item_id").isNull() | F.col("text").isNull() | (words < SHORTEST))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, start_token, n_match, n_item: one row per row of docs and test item found in it.

    Tokens are runs of bytes other than ASCII white space, A-Z in lower case. Seeds of documents and items are joined;
    each join is an alignment of a pair, which counts if overlap * n_item tokens agree on it, and LEAST at least (or all
    of a shorter item), or, where words are put in or left out, on near ones together, or if VERBATIM tokens in a row
    agree. An alignment that counts by itself, at OVERLAP or more, is never missed, whichever tokens are changed; near
    ones are taken together if each holds a seed. Items under SHORTEST tokens are refused (see refused). start_token
    is where the item's first token lies in the document, by the fullest of near alignments; it is negative if the
    document begins within the item. Null and empty texts contain nothing and are contained in nothing; repeated rows of
    docs give repeated pairs, repeated items count once, items of one id with different texts each for themselves; an
    empty table gives no rows; rows of either table without an id are left out.
    """
    # the keys only gather candidates: two rows with one key would each be held against the candidates of both
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = written(spark, items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(_items, "item long, item_id long, tokens binary"), "items")
    seeds = written(spark, items.select("item", "tokens").mapInArrow(_item_seeds, "seed long, item long, offset long"), "item-seeds")
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = doc_seeds(spark, keyed, seed_filter(seeds, seeds.count())).hint("merge").join(seeds, "seed")
    pairs = met.groupBy("doc", "item").agg(F.collect_set(F.col("at") - F.col("offset")).alias("starts"))
    asked = pairs.hint("merge").join(items, "item").groupBy(F.col("doc").alias("own")).agg(F.collect_list(F.struct("item_id", "tokens", "starts")).alias("asked"))
    asked = written(spark, asked, "asked")
    both = keyed.join(asked.hint("merge"), F.col("doc") == F.col("own")).select("doc_id", "text", "asked")
    return both.mapInArrow(functools.partial(_verified, overlap), ", ".join(f"{f} long" for f in _FIELDS))
