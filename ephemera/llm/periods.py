"""Runs of words that repeat with a period: every lag is compared over whole word arrays, long documents by lag ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, mixed, prefix_hash, slices, span_hash, string_parts, words, written

#: A run is so many periods long, and so many words.
MIN_EXP, MIN_WORDS = 4, 6
#: Texts of more bytes are dealt out by ranges of lags.
LONG_BYTES = 1 << 16
#: Lags in one range of a long text.
LAGS = 1 << 12
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_SPACES = r"[\x20\x09-\x0D]+"


def stretches(ids: np.ndarray, sizes: np.ndarray, low: int, high: int, min_exp: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and lag of each maximal stretch that repeats with a lag of low to high - 1, and is long enough.

    ids holds documents one after another, longest first, of the given sizes; no word of one equals a word of another.
    A lag is compared over all documents that are long enough for it at once: they stand at the front.
    """
    ends, found = np.cumsum(sizes), []
    for lag in range(low, min(high, int(sizes[0]) // min_exp + 1) if len(sizes) else low):
        need = max(min_words, min_exp * lag)
        documents = int(np.searchsorted(-sizes, -need, "right"))
        if not documents:
            break
        n = int(ends[documents - 1])
        same = ids[: n - lag] == ids[lag:n]
        if np.count_nonzero(same) < need - lag:
            continue
        at = np.flatnonzero(same)
        cut = np.flatnonzero(np.diff(at) != 1)
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
        keep = last - first + 1 >= need - lag
        if keep.any():
            start = at[first[keep]]
            found.append((start, at[last[keep]] - start + 1 + lag, np.full(len(start), lag)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def smallest(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of stretches with one start and length, that of the smallest period: start, length, period in that order."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in best.items())


def numbered(tokens: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.int32)


def runs_of(data: np.ndarray, offsets: np.ndarray, min_exp: int = MIN_EXP, min_words: int = MIN_WORDS) -> tuple[list[list[tuple[int, int, int]]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text, and the words' starts, ends and rows.

    Words are compared by hashes; each run's words are then compared themselves, and a text where two words that differ
    have one hash is done again with numbers given to its words.
    """
    start, end, row = words(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(-n, kind="stable")
    order = order[: int(np.searchsorted(-n[order], -max(min_words, min_exp), "right"))]
    sizes, out = n[order], [[] for _ in n]
    if not len(order):
        return out, (start, end, row)
    own = mixed(span_hash(prefix_hash(data), start, end) ^ mixed(row.astype(np.uint64)))
    ids = np.unique(np.concatenate([own[first[i] : first[i + 1]] for i in order]), return_inverse=True)[1].astype(np.int32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    at, length, lag = stretches(ids, sizes, 1, int(sizes[0]), min_exp, min_words)
    place = np.searchsorted(begins, at, "right") - 1
    for p, s, m, q in zip(place.tolist(), (at - begins[place]).tolist(), length.tolist(), lag.tolist(), strict=True):
        out[order[p]].append((s, m, q))
    raw = data.tobytes()
    for i in {int(order[p]) for p in place.tolist()}:
        out[i] = smallest(out[i])
        tokens = [raw[a:b] for a, b in zip(start[first[i] : first[i + 1]].tolist(), end[first[i] : first[i + 1]].tolist(), strict=True)]
        if any(tokens[s : s + m - q] != tokens[s + q : s + m] for s, m, q in out[i]):
            out[i] = smallest(list(zip(*(x.tolist() for x in stretches(numbered(tokens), n[i : i + 1], 1, len(tokens), min_exp, min_words)), strict=True)))
    return out, (start, end, row)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _found(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))


def _collapsed(data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The words that stay of each text, joined by one space."""
    start, end, row = spans
    first = np.searchsorted(row, np.arange(len(rows) + 1))
    stay = np.ones(len(row), bool)
    for i, runs in enumerate(rows):
        if runs:
            stay[first[i] : first[i + 1]] = kept(first[i + 1] - first[i], runs)
    start, end, row = start[stay], end[stay], row[stay]
    gap = end[:-1][row[:-1] == row[1:]]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    here = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    here[gap] = True
    out = data.copy()
    out[gap] = 32
    cuts = np.concatenate([[0], np.cumsum(here)])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(out[here])])


def _whole(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, runs and collapsed; runs are those given in a last column of that name, or else looked for."""
    for batch in batches:
        given = batch.column(len(batch.schema.names) - 1) if batch.schema.names[-1] == "_runs" else None
        data, offsets = string_parts(batch.column(at))
        for first, end, part, cuts in slices(data, offsets):
            if given is None:
                rows, spans = runs_of(part, cuts)
            else:
                spans = words(part, cuts)
                rows = [smallest([(r["start"], r["length"], r["period"]) for r in x or []]) for x in given.slice(first, end - first).to_pylist()]
            n = np.bincount(spans[2], minlength=end - first)
            more = [pa.array(n, pa.int64()), _found(rows), _collapsed(part, cuts, spans, rows)]
            own = batch.columns if given is None else batch.columns[:-1]
            names = batch.schema.names[: len(own)]
            yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in own), *more], [*names, "n_words", "runs", "collapsed"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, runs of each row of key, text, low, high: the stretches of lags of low to high - 1."""
    for batch in batches:
        rows = []
        for i in range(len(batch)):
            data, offsets = string_parts(batch.column("text").slice(i, 1))
            start, end, _ = words(data, offsets)
            raw = data.tobytes()
            ids = numbered([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            found = stretches(ids, np.array([len(ids)]), batch.column("low")[i].as_py(), batch.column("high")[i].as_py(), MIN_EXP, MIN_WORDS)
            rows.append(smallest(list(zip(*(x.tolist() for x in found), strict=True))))
        yield pa.RecordBatch.from_arrays([batch.column("key"), _found(rows)], ["key", "runs"])


def n_words(text: Column) -> Column:
    """Words of a text; one that begins or ends with white space has an empty piece there."""
    return F.size(F.filter(F.split(text, _SPACES, -1), lambda w: w != ""))


def with_runs(spark: SparkSession, docs: DataFrame, text: str = "text", long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed (the words that stay).

    A run is a stretch of words, white space apart, whose smallest period is at most a quarter of its length, at least
    six words long, that no neighbouring word continues. Texts beyond long_bytes are told apart by their hash, once each,
    and unfolded to ranges of some lags, which are dealt out evenly; the others are done where they are read. Null texts count as empty: no words, no runs, an empty rest. Repeated rows stay, and so do all other
    columns, but own columns of the three names are replaced. An empty table gives none.
    """
    docs = docs.drop("n_words", "runs", "collapsed", "_runs")
    at, schema = docs.columns.index(text), docs._jdf.schema().toDDL()
    added = f"n_words long, runs array<{RUN}>, collapsed string"
    is_long = F.coalesce(F.octet_length(text) > long_bytes, F.lit(False))
    whole = lambda batches: _whole(at, batches)
    short = docs.where(~is_long).mapInArrow(whole, f"{schema}, {added}")
    key, id_ = F.sha2(text, 256), free_name(docs, "key")
    long = docs.where(is_long)
    most = F.floor(F.col("n") / MIN_EXP)
    sized = long.select(key.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"]).withColumn("n", n_words(F.col("text"))).where(F.col("n") >= MIN_WORDS)
    dealt = sized.select("key", "text", most.alias("most"), F.explode(F.sequence(F.lit(1), most.cast("int"), F.lit(lags))).alias("low"))
    ranges = dealt.select("key", "text", F.col("low").cast("long").alias("low"), F.least(F.col("low") + lags, F.col("most") + 1).cast("long").alias("high"))
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "key", "low")
    each = spread.mapInArrow(_ranges, f"key string, runs array<{RUN}>")
    found = written(spark, each.select("key", F.explode("runs").alias("run")).groupBy("key").agg(F.collect_set("run").alias("_runs")), "runs")
    joined = long.withColumn(id_, key).join(found.withColumnRenamed("key", f"{id_}_"), F.col(id_) == F.col(f"{id_}_"), "left").select(*docs.columns, "_runs")
    return short.unionByName(joined.mapInArrow(whole, f"{schema}, {added}"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256.

    Of runs of one length the first, then the shortest period, stands for the document; without runs its four are null.
    """
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit("\n"))), "")
    said = F.replace(said, F.lit(",\n"), F.lit("\n"))
    named = docs.withColumn("best", longest)
    return named.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document of ten repeats words from some place on, as its id says.

    With h the crc32 of the decimal id and g = h // 10, those with h % 10 = 0 and n words repeat, from word a = g % n on,
    the p = 1 + (n - a) // (3 + g % 8) words that stand there, until they have n words again.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), _SPACES, -1), lambda w: w != "")).alias("w"))
    n, g = F.nullif(F.size("w"), F.lit(0)), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("w", 1, a.cast("int")), again), " ")).otherwise(F.col("text"))
    return split.select("doc_id", text.alias("text"))


#: The DuckDB twin of digest(with_runs(looped(documents))). A run of three periods and more of equal pairs covers three
#: multiples of its lag, which says which lags of a document are worth looking at place by place.
SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
hashed AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w0,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM documents, crc),
sized AS (SELECT *, len(w0)::BIGINT AS n, h // 10 AS g FROM hashed),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
d AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM placed),
lags AS (SELECT rid, n, w, unnest(range(1, n // 4 + 1)) AS p FROM d WHERE n >= 6),
likely AS (SELECT * FROM lags WHERE len(list_filter(range(0, n - 2 * p, p), lambda k: w[k + 1] = w[k + p + 1] AND w[k + p + 1] = w[k + 2 * p + 1])) > 0),
same AS (SELECT rid, p, unnest(list_filter(range(0, n - p), lambda i: w[i + 1] = w[i + p + 1])) AS i FROM likely),
islands AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM same),
found AS (SELECT rid, p, min(i) AS s, count(*) + p AS l FROM islands GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT rid, s, l, min(p) AS p FROM found GROUP BY rid, s, l),
said AS (SELECT rid, count(*) AS n_runs, first(struct_pack(s := s, l := l, p := p) ORDER BY l DESC, s, p) AS best, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS said FROM runs GROUP BY rid),
places AS (SELECT rid, unnest(w) AS word, unnest(range(n)) AS i FROM d),
gone AS (SELECT DISTINCT places.rid, i FROM places JOIN runs ON places.rid = runs.rid AND i >= s + p AND i < s + l),
rest AS (SELECT places.rid, string_agg(word, ' ' ORDER BY i) AS rest FROM places ANTI JOIN gone ON places.rid = gone.rid AND places.i = gone.i GROUP BY places.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (rid) LEFT JOIN rest USING (rid)
"""
