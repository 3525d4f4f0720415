"""Near-duplicate documents by an LSH forest: sorted signature orders, prefix neighbours, and confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, powers, slices, string_parts, word_hashes, written

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Minima of a signature, and the forest's orders. Orders begin with disjoint runs of ROOT minima.
MINIMA, ORDERS, ROOT = 128, 32, 4
#: Depths, in minima, at which a region is looked at again; the last is the deepest.
DEPTHS = (4, 6, 8, 10, 12)
#: Documents of a region that are all compared; larger regions go a depth further, and their documents are also joined
#: on their rarest shingles, as depth costs them candidates.
REGION = 10
#: Shingles are counted by so many leading bits of their hash, to order those of crowded documents.
COUNT_BITS = 21
#: Candidates whose signatures agree in a smaller share are not confirmed: 4.5 standard deviations below 0.75.
AGREE = 0.58
#: Sorted rows that a task holds at a time.
RUN = 100_000

_ODD = powers(np.uint64(0xA0761D6478BD642F), MINIMA + WORDS + 2)
_ORDER = [np.concatenate([np.arange(ROOT * t, ROOT * t + ROOT), np.random.default_rng(t).permutation(np.r_[0 : ROOT * t, ROOT * t + ROOT : MINIMA])[: DEPTHS[-1] - ROOT]]) for t in range(ORDERS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and each row's first place (and the end).

    A row with fewer words than a shingle has its whole word sequence as its one shingle; without words it has none.
    """
    rows = len(offsets) - 1
    tokens, row = word_hashes(data, offsets)
    count = np.bincount(row, minlength=rows)
    n = max(0, len(tokens) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h += tokens[j : j + n] * _ODD[j + 1]
    inside = row[:n] == row[len(row) - n :] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    begin = np.concatenate([[0], np.cumsum(count)])
    few = [np.uint64(sum(int(t) * int(_ODD[j + 1]) for j, t in enumerate(tokens[begin[r] : begin[r + 1]])) + int(count[r]) & 2**64 - 1) for r in short]
    h, own = np.concatenate([mixed(h[inside]), mixed(np.array(few, np.uint64))]), np.concatenate([row[:n][inside], short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(rows + 1))


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA 16-bit values for each non-empty set: the low end of its least member under each of MINIMA orders."""
    out = np.zeros((len(starts), MINIMA), np.uint16)
    for k in range(MINIMA):
        out[:, k] = mixed(np.minimum.reduceat(h * _ODD[k + 1], starts)).astype(np.uint16)
    return out


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set, 0 for an empty one."""
    full = np.flatnonzero(np.diff(at))
    keys = np.zeros((2, len(at) - 1), np.uint64)
    for j in range(2 if len(full) else 0):
        keys[j, full] = np.add.reduceat(mixed(h + _ODD[j + 1]), at[full])
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key1, key2 (of the set), signature (null for an empty set), text_hash."""
    fields = ["doc_id", "n_shingles", "key1", "key2", "signature", "text_hash"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            for first, end, part, cuts in slices(data, offsets):
                h, at = shingle_sets(part, cuts)
                size = np.diff(at)
                full = np.flatnonzero(size)
                keys = set_keys(h, at)
                sign: list[bytes | None] = [None] * len(size)
                if len(full):
                    for r, s in zip(full.tolist(), signatures(h, at[full]), strict=True):
                        sign[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(size, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.array(sign, pa.binary()), batch.column(2).slice(first, end - first)], fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, key1 long, key2 long, signature binary, text_hash long")


def orders(sketched: DataFrame) -> DataFrame:
    """key, rest, doc_id, n: a row per document and order; key is the order with its first ROOT minima, rest the further ones."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                ids, n, sign = (batch.column(i).slice(at, 2000) for i in range(3))
                values = np.frombuffer(b"".join(sign.to_pylist()), np.uint16).reshape(-1, MINIMA)
                for t, own in enumerate(_ORDER):
                    root = np.ascontiguousarray(values[:, own[:ROOT]]).view(np.uint64).ravel()
                    rest = np.ascontiguousarray(values[:, own[ROOT:]]).view(f"S{2 * (DEPTHS[-1] - ROOT)}").ravel()
                    width = rest.dtype.itemsize
                    blob = pa.Array.from_buffers(pa.binary(width), len(rest), [None, pa.py_buffer(rest.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(mixed(root + _ODD[t + 1]).view(np.int64)), blob, ids, n], ["key", "rest", "doc_id", "n"])

    return sketched.select("doc_id", "n_shingles", "signature").mapInArrow(spread, "key long, rest binary, doc_id long, n long")


def neighbours(key: np.ndarray, rest: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Candidate pairs among rows in sorted order.

    A region is a run of rows that agree to some depth. Of regions with at most REGION rows whose region one depth up is
    larger (or which lie at the first depth) all pairs count; regions larger than that at the deepest depth pair each
    row with the first. Rows next to each other, the longest common prefixes, count wherever they agree at the root.
    A document also comes paired with itself if it lies in a region larger than REGION at the first depth.
    """
    size = len(key)
    if size < 2:
        return np.zeros((0, 2), np.int64)
    pairs, undecided = [], np.ones(size, bool)
    same = key[1:] == key[:-1]
    pairs.append(np.stack([np.flatnonzero(same), np.flatnonzero(same) + 1], 1))
    for depth in DEPTHS:
        if depth > ROOT:
            same = same & (rest[1:, depth - ROOT - 1] == rest[:-1, depth - ROOT - 1]) & (rest[1:, depth - ROOT - 2] == rest[:-1, depth - ROOT - 2])
        region = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(region)[region]
        fit = undecided & (many <= REGION)
        if depth == ROOT:
            crowd = ids[~fit]
        for step in range(2, REGION):
            i = np.flatnonzero(fit[:-step] & (region[step:] == region[:-step]))
            if not len(i):
                break
            pairs.append(np.stack([i, i + step], 1))
        undecided &= many > REGION
        if not undecided.any():
            break
    i = np.flatnonzero(undecided)
    first = np.searchsorted(region, region[i])
    pairs.append(np.stack([first, i], 1)[first != i])
    p = np.concatenate(pairs)
    a, b = n[p[:, 0]], n[p[:, 1]]
    p = ids[p[100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)]]
    p = np.sort(p, axis=1)
    return np.concatenate([np.unique(p[p[:, 0] < p[:, 1]], axis=0), np.stack([crowd, crowd], 1)])


def candidates(ordered: DataFrame) -> DataFrame:
    """a, b: distinct candidate pairs of the sorted orders, a < b; and with a = b the documents crowded in some order.

    A region of more than RUN rows is looked at in parts. All its documents are crowded, so that no pair is lost by that.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, rest, ids, n = (np.concatenate([r[i] for r in rows]) for i in range(4))
            p = neighbours(key, rest, ids, n)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        held = 0
        for batch in batches:
            key, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            rest = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(key), -1)
            rows = key, rest, ids, n
            # the rows of the batch's last key may go on in the next batch
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if kept and len(key) and (cut or key[0] != kept[-1][0][-1]):
                yield flush([*kept, tuple(x[:cut] for x in rows)])
                kept, held = [], 0
            elif cut:
                yield flush([tuple(x[:cut] for x in rows)])
            elif held >= RUN:
                yield flush(kept)
                # so many rows that the region's next part is crowded as well
                kept = [tuple(np.concatenate([k[i] for k in kept])[-REGION - 1 :] for i in range(4))]
                held = 0
            kept.append(tuple(x[cut:] for x in rows))
            held += len(key) - cut
        if kept:
            yield flush(kept)

    found = ordered.repartition("key").sortWithinPartitions("key", "rest", "doc_id").mapInArrow(scan, "a long, b long")
    return found.distinct()


def agreeing(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """a, b, agree: pairs with the share of minima that agree, if it is AGREE at least."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, MINIMA) for i in (2, 3))
            agree = (x == y).mean(1)
            fit = pa.array(agree >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit), pa.array(agree).filter(fit)], ["a", "b", "agree"])

    own = sketched.select("doc_id", "signature")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(share, "a long, b long, agree double")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, members, crowded: the whole shingle set of each text, sorted, if it is the set that its keys name."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            wanted = [batch.column(i).to_numpy().view(np.uint64) for i in (3, 4)]
            for first, end, part, cuts in slices(data, offsets):
                h, at = shingle_sets(part, cuts)
                keys = set_keys(h, at)
                own = np.flatnonzero((keys[0] == wanted[0][first:end]) & (keys[1] == wanted[1][first:end]))
                packed = pa.array([h[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + own)), packed, batch.column(2).take(pa.array(first + own))], ["doc_id", "members", "crowded"])

    return docs.select("doc_id", "text", "crowded", "key1", "key2").mapInArrow(members, "doc_id long, members binary, crowded boolean")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles lie whose hashes begin with the same COUNT_BITS; at least each one's own frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - COUNT_BITS), 1)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["start", "n"])

    found = sets.select("members").mapInArrow(count, "start long, n long").groupBy("start").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.ones(1 << COUNT_BITS, np.uint32)
    out[found["start"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """h, doc_id, n, rest: each set's shingles that may be the first common one of a link, the rarest first.

    All sets are in one order, by shingle_counts and hash. n is the set's size and rest counts the shingle and those
    after it: what two sets share from their first common shingle on is no more than either's rest, and a link shares at
    least PERCENT of the larger set. Shingles of one set alone are left out.
    """
    shared = spark.sparkContext.broadcast(shingle_counts(sets))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, members = (batch.column(i).slice(at, 500) for i in range(2))
                out: list[tuple[np.ndarray, ...]] = []
                for i, x in zip(ids.to_pylist(), members, strict=True):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    times = counts[h >> np.uint64(64 - COUNT_BITS)]
                    order = np.lexsort((h, times))
                    rest = np.arange(len(h), 0, -1)
                    fit = (100 * rest >= PERCENT * len(h)) & (times[order] > 1)
                    h, rest = h[order][fit], rest[fit]
                    out.append((h.view(np.int64), np.full(len(h), i), np.full(len(h), len(np.frombuffer(x.as_buffer(), np.uint64))), rest))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["h", "doc_id", "n", "rest"])

    return sets.select("doc_id", "members").mapInArrow(prefix, "h long, doc_id long, n long, rest long")


def linkable(least: Column, both: Column) -> Column:
    """Whether two sets may be linked that share least shingles at most and have both together."""
    return (100 + PERCENT) * least >= PERCENT * both


def exact_pairs(spark: SparkSession, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: all pairs of sets in different components of labels that can be linked, a < b; no pair that is one is missing.

    A link's first common shingle lies in the prefixes of both, so that an equi-join on the prefixes finds it. Only the
    smaller of two sets decides whether a shingle can be of use: a passage that all documents of a crowd share lies so late
    in their order that it joins nothing, unless documents have little else. Of a shingle's documents those in its most
    frequent component are only joined with the others.
    """
    entries = prefixes(spark, sets).join(labels.toDF("doc_id", "c").hint("merge"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    entries = written(spark, entries, "prefixes")
    sizes = entries.groupBy("h", "c").agg(F.count("*").alias("size"), F.max(linkable(F.col("rest"), 2 * F.col("n"))).alias("small"))
    useful = sizes.groupBy("h").agg(F.max_by("c", F.struct("size", "c")).alias("most"), F.count("*").alias("parts"), F.max("small").alias("small")).where("small AND parts > 1")
    # as a table of its own, so that Spark can split a shingle's rows when it joins them
    asked = written(spark, entries.join(written(spark, useful.select("h", "most"), "shingles"), "h"), "asked")
    one = asked.where("c <> most").select("h", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("c").alias("ca"))
    two = asked.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("c").alias("cb"))
    met = one.join(two, "h").where((F.col("ca") != F.col("cb")) & linkable(F.least("ra", "rb"), F.col("na") + F.col("nb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets fulfil the link's condition."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                fit.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            fit = pa.array(fit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit)], ["a", "b"])

    own = sets.select("doc_id", "members")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """doc_id, component: the smallest id reachable, for every id that has a link.

    Each round takes the least label among a node's neighbours, then the label of that label; every round is a written
    table, so a lost executor costs one round at most.
    """
    both = written(spark, links.select("a", "b").union(links.select("b", "a")).toDF("doc_id", "other"), "links")
    labels = written(spark, both.groupBy("doc_id").agg(F.min("other").alias("m")).select("doc_id", F.least("doc_id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("other", "label"), "other").groupBy("doc_id").agg(F.min("label").alias("label"))
        hop = labels.join(near, "doc_id").select("doc_id", F.least("component", "label").alias("mid"), F.col("component").alias("was"))
        jump = hop.join(labels.select(F.col("doc_id").alias("mid"), F.col("component").alias("far")), "mid", "left")
        moved = written(spark, jump.select("doc_id", F.least("mid", "far").alias("component"), "was"), "labels")
        labels = moved.select("doc_id", "component")
        if not moved.where("component < was").limit(1).count():
            return labels


def numbered_classes(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """classes with the column node, an own number for each: its doc_id, or where an id heads several, for all but one a hash.

    Those hashes are few, so that 64 bits tell them from one another and from the ids.
    """
    several = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("key1", "key2")).alias("one")).where("n > 1").select("doc_id", "one")
    node = F.when(F.col("one").isNull() | (F.struct("key1", "key2") == F.col("one")), F.col("doc_id")).otherwise(F.xxhash64(F.lit("class"), "key1", "key2"))
    return written(spark, classes.join(written(spark, several, "several"), "doc_id", "left").select(*classes.columns, node.alias("node")), "nodes")


def between_ids(links: DataFrame, others: DataFrame) -> DataFrame:
    """Links of classes as links of the ids that head them."""
    named = links.join(others.toDF("a", "ia"), "a", "left").join(others.toDF("b", "ib"), "b", "left")
    named = named.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b")).where("a <> b")
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def same_id(spark: SparkSession, full: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: each id that has several sets, with the ids that head their classes."""
    key = F.struct("key1", "key2")
    several = full.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id")
    own = full.select("doc_id", "key1", "key2").join(written(spark, several, "several"), "doc_id").distinct()
    met = own.join(classes.select("key1", "key2", F.col("doc_id").alias("head")), ["key1", "key2"]).where("head <> doc_id")
    return met.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Words are runs of bytes other than ASCII white space with A-Z in lower case; a document's set has its distinct
    shingles of WORDS words, or its whole sequence as one if shorter. Documents with equal sets are one class, which
    goes through the forest under the smallest id. Candidates are confirmed on full sets in two steps: first each class's
    best candidate with a smaller number, then all candidates that these links leave in different components. To the second
    step come all pairs that can be linked of documents that lie in a crowded region of any order, by an exact join of
    their rarest shingles. So a link is found if its documents share the first minima of any order: their region there
    is either small, and all its pairs are candidates, or crowded, and both documents are joined exactly.
    component_id is the smallest id reachable over links; kept says that it is the row's own. Null and empty texts and
    texts of white space alone have n_shingles 0 and are linked with nothing, as are rows without an id: those have no
    component and are kept. Rows of one id with different texts are one document: all their sets are searched, and
    all are in its component. An empty table gives no rows.
    """
    sketched = written(spark, sketches(docs), "sketches")
    full = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(spark, full.groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash", "signature")).alias("m")).select("key1", "key2", "n_shingles", "m.*"), "classes")
    nodes = numbered_classes(spark, classes)
    others = nodes.where("node <> doc_id").select("node", "doc_id")
    searched = nodes.select(F.col("node").alias("doc_id"), "n_shingles", "signature")
    found = written(spark, candidates(orders(searched)), "pairs")
    crowd = found.where("a = b").select(F.col("a").alias("node"))
    pairs = written(spark, agreeing(found.where("a < b"), searched), "agreeing")
    # merged at every size: a broadcast here would only be a smaller input's plan
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("crowded")).union(crowd.select("node", F.lit(True)))
    wanted = wanted.groupBy("node").agg(F.max("crowded").alias("crowded")).join(nodes.select("node", "doc_id", "text_hash", "key1", "key2").hint("merge"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    texts = texts.join(wanted.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"])
    sets = written(spark, full_sets(texts.drop("doc_id").withColumnRenamed("node", "doc_id")), "sets")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    linked = written(spark, confirmed(best, sets), "first")
    first = written(spark, between_ids(linked, others).union(same_id(spark, full, classes)), "first")
    early = components(spark, first)
    early = early.union(others.join(early, "doc_id", "left").select("node", F.coalesce("component", "doc_id")))
    left = pairs.join(early.toDF("a", "ca"), "a", "left").join(early.toDF("b", "cb"), "b", "left")
    left = left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").union(exact_pairs(spark, sets.where("crowded"), early)).distinct()
    second = confirmed(left.join(best, ["a", "b"], "left_anti"), sets)
    whole = components(spark, first.union(between_ids(second, others)))
    named = classes.join(whole, "doc_id", "left").select("key1", "key2", "n_shingles", F.coalesce("component", "doc_id").alias("class_component"))
    out = sketched.join(named, ["key1", "key2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
