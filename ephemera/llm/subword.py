"""Quality classifier: supervised embeddings of hashed words and character n-grams, averaged per document."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, BYTE_VALUES, INVERSE, SPACE, held_out, mixed, powers, slices, string_parts, written

#: Buckets of the hashed vectors (a power of two), their length, and the character n-grams' lengths.
BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
#: The model is fitted on at most this many labelled rows, those with the smallest hash of their id, and of these on no
#: more than come to so many bytes of text together (the first counts whatever its length).
LABELLED_ROWS, LABELLED_BYTES = 5000, 64_000_000
#: Steps of the descent, a document each, however few rows there are; and the first step's rate.
STEPS, RATE = 30_000, 0.4
THRESHOLD = 0.7
#: The bucket of a word that follows itself.
REPEAT = 0
_SHIFT = np.uint64(64 - 17)


class Model(NamedTuple):
    weight: np.ndarray  # of each bucket: its vector times the difference of the softmax rows
    bias: float


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature: whole words, n-grams of words with a mark at either end, and repeats.

    A word pair whose two words are equal counts in one bucket for all words, as no single pair recurs often enough.
    Words are runs of bytes other than ASCII white space, as they stand. Marks are white space or the text's ends.
    """
    n = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    text = np.full(len(data) + n + 1, 32, np.uint8)
    text[at] = data
    row = np.zeros(len(text), np.int64)
    row[at] = np.repeat(np.arange(n), np.diff(offsets))
    gap = SPACE[text]
    text[gap] = 32
    prefix = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[text] * powers(BASE, len(text)), out=prefix[1:])
    back = powers(INVERSE, len(text) + 1)
    edge = np.diff(gap.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    whole, own = mixed((prefix[ends] - prefix[starts]) * back[starts] + np.uint64(1)), row[starts]
    again = own[1:][(whole[1:] == whole[:-1]) & (own[1:] == own[:-1])]
    found, rows = [(whole >> _SHIFT).astype(np.int32), np.full(len(again), REPEAT, np.int32)], [own, again]
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    for k in GRAMS:
        i = np.flatnonzero(gaps[k - 1 : len(text)] == gaps[1 : len(text) - k + 2])[: len(text) - k + 1]
        found.append((mixed((prefix[i + k] - prefix[i]) * back[i] + np.uint64(k << 8)) >> _SHIFT).astype(np.int32))
        rows.append(row[i + 1])
    return np.concatenate(found), np.concatenate(rows)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent, a document a step. With one label only, a constant."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else 3.0 if y[0] else -3.0)
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    features = []
    for t in texts:
        found, _ = buckets(*string_parts(pa.array([t], pa.string())))
        ids, counts = np.unique(found, return_counts=True)
        features.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-STEPS // len(y)))])[:STEPS]
    for step, i in enumerate(order.tolist()):
        ids, share = features[i]
        hidden = share @ vectors[ids]
        z = out @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        p *= np.float32(RATE * (1 - step / STEPS))
        push = p @ out
        out -= np.outer(p, hidden)
        bias -= p
        vectors[ids] -= np.outer(np.minimum(share * len(ids), 1), push)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Softmax probability of label 1 for each text: the mean of the vectors times the softmax rows, which is linear."""
    found, rows = buckets(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    z = np.bincount(rows, weights=model.weight[found], minlength=n) / np.maximum(count, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, most_bytes: int = LABELLED_BYTES) -> tuple[list[str], list[int]]:
    """Texts and quality labels of at most most rows; one text of each id. Held-out ids, null ids and null labels are never learned from."""
    fit = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    # most bounds the broadcast side
    chosen = fit.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("rank")).distinct().orderBy("rank", "doc_id", "quality").limit(most)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    one = keyed.select("doc_id", "text_hash", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min(F.struct("text_hash", "size")).alias("one"))
    total = F.sum("one.size").over(Window.orderBy("rank", "doc_id", "quality"))
    place = F.row_number().over(Window.orderBy("rank", "doc_id", "quality"))
    within = one.withColumns({"total": total, "place": place}).where((F.col("total") <= most_bytes) | (F.col("place") == 1)).select(*chosen.columns, "one.text_hash")
    # no more than most rows, so that they may go to every executor
    kept = written(spark, within, "labelled")
    rows = keyed.join(F.broadcast(kept), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "quality"]).select("rank", "doc_id", "quality", "text").collect()
    rows.sort(key=lambda r: (r["rank"], r["doc_id"], r["quality"]))
    return [r["text"] for r in rows], [r["quality"] for r in rows]


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text has no features and gets the bias' score. Repeated rows give repeated rows; an empty table
    gives none. Without labels every score is 0.5, and so no document is predicted 1 at a threshold above that.
    """
    scored = with_scores(spark, docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def with_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """docs with one more column; an own column of that name is replaced."""
    docs = docs.drop(column)
    shared = spark.sparkContext.broadcast(train(*labelled(spark, docs, labels)))
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(at))
            parts = [scores(shared.value, part, cuts) for _, _, part, cuts in slices(data, offsets, 1 << 19)]
            value = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, column])

    return docs.mapInArrow(add, f"{docs._jdf.schema().toDDL()}, {column} double")
