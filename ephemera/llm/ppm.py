"""Language identification by partial matching: per-language variable-order byte context trees under frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, held_out, mixed, slices, string_parts, written

#: Longest context in bytes.
ORDER = 4
#: The statistics come from this many whole texts of each language, those with the smallest hash of their id, and of
#: these from no more than come to so many bytes together (the first counts whatever its length).
TEXTS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 300, 2_000_000
UNDETERMINED = "und"


class Table(NamedTuple):
    """Whole numbers with a place each: sorted by their hash, with the first place of each run of leading hash bits."""

    keys: np.ndarray
    first: np.ndarray
    shift: np.uint64

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each number, or -1."""
        bucket = mixed(wanted.astype(np.uint64)) >> self.shift
        at, end = self.first[bucket], self.first[bucket + np.uint64(1)]
        out, left = np.full(len(wanted), -1, np.int32), np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == wanted[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return out


class Model(NamedTuple):
    languages: list[str]
    grams: Table  # order, context and next byte, where some language saw them together
    cost: np.ndarray  # bits of each in each language
    contexts: Table  # order and context
    escape: np.ndarray  # bits of falling back to the next shorter context, for bytes that no language saw in this one


def table(keys: np.ndarray) -> tuple[Table, np.ndarray]:
    """The table of distinct numbers, and the order that their values go into."""
    h = mixed(keys.astype(np.uint64))
    order = np.argsort(h)
    bits = max(4, int(len(keys)).bit_length() + 1)
    first = np.searchsorted(h[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
    return Table(keys[order], first, np.uint64(64 - bits)), order


def positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes before each byte as one number, the nearest lowest, and how many of them lie in its text."""
    context = np.zeros(len(data), np.int64)
    for d in range(1, ORDER + 1):
        context[d:] |= data[: max(0, len(data) - d)].astype(np.int64) << 8 * (d - 1)
    return context, np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)


def cut(context: np.ndarray, order: int) -> np.ndarray:
    """The order nearest bytes of contexts, told apart from those of other orders."""
    return context & (1 << 8 * order) - 1 | order << 32


def train(texts: dict[str, list[str]]) -> Model:
    """Escape-method-C statistics with exclusion, frozen: each context holds a full distribution in each language.

    A byte unseen in a context costs its escape plus its cost in the next shorter context, where the bytes seen in the
    longer one are excluded; order -1 is uniform over 256 bytes. A language that never saw a context uses its longest
    that it saw, at no cost. Contexts do not reach over a text's start. Every context that occurs is kept.
    """
    languages = sorted(texts)
    streams = [string_parts(pa.array(texts[k], pa.string())) for k in languages]
    places = [positions(*s) for s in streams]
    grams, cost, contexts, escape = [], [], [], []
    before: tuple[np.ndarray, np.ndarray] | None = None
    for order in range(ORDER + 1):
        seen = []
        for (data, _), (context, depth) in zip(streams, places, strict=True):
            fit = depth >= order
            seen.append(np.unique(cut(context[fit], order) << 8 | data[fit], return_counts=True))
        keys = np.unique(np.concatenate([k for k, _ in seen])) if seen else np.zeros(0, np.int64)
        n = np.zeros((len(keys), len(languages)))
        for j, (k, count) in enumerate(seen):
            n[np.searchsorted(keys, k), j] = count
        nodes, node = np.unique(keys >> 8, return_inverse=True)
        if before is None:
            shorter = np.full(n.shape, 1 / 256)
        else:
            shorter = before[1][np.searchsorted(before[0], cut(keys >> 8, order - 1) << 8 | keys & 255)]
        gather = lambda values: np.stack([np.bincount(node, v, len(nodes)) for v in values.T], 1) if len(nodes) else np.zeros((0, len(languages)))  # noqa: E731, B023
        sums, kinds, left = gather(n), gather((n > 0) * 1.0), np.maximum(1 - gather(shorter * (n > 0)), 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(sums > 0, kinds / (sums + kinds) / left, 1.0)
            p = np.where(n > 0, n / (sums + kinds)[node], out[node] * shorter)
        grams.append(keys)
        cost.append(-np.log2(p))
        contexts.append(nodes)
        escape.append(-np.log2(out))
        before = keys, p
    gram_table, by = table(np.concatenate(grams))
    context_table, at = table(np.concatenate(contexts))
    return Model(languages, gram_table, np.concatenate(cost)[by].astype(np.float32), context_table, np.concatenate(escape)[at].astype(np.float32))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language; contexts never reach over a text's start."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(data) or not model.languages:
        return out
    context, depth = positions(data, offsets)
    bits, left = np.zeros((len(data), len(model.languages)), np.float32), np.arange(len(data))
    for order in range(ORDER, -1, -1):
        deep = depth[left] >= order
        at = left[deep]
        key = cut(context[at], order)
        gram = model.grams.find(key << 8 | data[at])
        hit = gram >= 0
        bits[at[hit]] += model.cost[gram[hit]]
        at, key = at[~hit], key[~hit]
        node = model.contexts.find(key)
        known = node >= 0
        bits[at[known]] += model.escape[node[known]]
        left = np.concatenate([left[~deep], at])
    bits[left] += 8
    full = np.flatnonzero(np.diff(offsets))
    out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
    return out


def sample(spark: SparkSession, docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> dict[str, list[str]]:
    """Whole texts of each non-null lang, never held-out rows, rows without id or null texts; one text of each id."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    fit = fit.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    once = fit.groupBy("lang", "doc_id").agg(F.min(F.struct("text_hash", F.octet_length("text").alias("size"))).alias("one"))
    # without texts first, in two steps, as one language may have most rows; then only the chosen rows' texts
    parts = once.select("lang", "doc_id", "one.*", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(256)))
    for by in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*by).orderBy("h", "doc_id")
        parts = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("rank"))
    chosen = parts.withColumn("total", total).where((F.col("rank") == 1) | (F.col("total") <= most_bytes)).select("doc_id", "lang", "text_hash", "rank")
    # as a table of its own, so that its size is known when Spark chooses how to join it
    found = fit.join(written(spark, chosen, "chosen"), ["doc_id", "lang", "text_hash"]).dropDuplicates(["doc_id", "lang"])
    out: dict[str, list[str]] = {}
    for r in sorted(found.select("lang", "rank", "text").collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: the language with the shortest code for the whole text.

    score is that language's share when each language weighs 2 ** -bits. A null text or one without a letter is 'und'
    with score 0, as is every text when no row can be learned from. Equal lengths go to the first language by name.
    Repeated rows give repeated rows; an empty table gives none; further columns are ignored.
    """
    model = model or train(sample(spark, docs))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = string_parts(batch.column(2))
            labels, scores = [], []
            for first, end, part, cuts in slices(data, offsets, 1 << 19):
                if not own.languages:
                    labels += [UNDETERMINED] * (end - first)
                    scores += [0.0] * (end - first)
                    continue
                bits = code_lengths(own, part, cuts)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                ascii_letter = (LOWER[part] >= 97) & (LOWER[part] <= 122)
                count = np.concatenate([[0], np.cumsum(ascii_letter)])[cuts]
                for i in range(end - first):
                    lettered = count[i + 1] > count[i] or any(map(str.isalpha, part[cuts[i] : cuts[i + 1]].tobytes().decode(errors="replace")))
                    labels.append(own.languages[best[i]] if lettered else UNDETERMINED)
                    scores.append(float(share[i]) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
