"""Token ids in a content-addressed store: chunks cut by content, stored once, with recipes and Merkle roots."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, INVERSE, powers, written

END_ID = 1
#: Ids that the rolling hash sees, and a chunk's least, usual (as a power of two) and most ids. Cuts depend on content alone.
ROLL, LEAST, USUAL_BITS, MOST = 16, 128, 9, 4096
#: Words in plain letters without case and closing punctuation, and other parts, whose ids a worker remembers: some 200 MB.
CORES, REMEMBERED = 700_000, 100_000
#: Texts' bytes encoded in one go.
BATCH_BYTES = 1 << 21
_GEAR = np.random.default_rng(99).integers(1, 2**63, 1 << 16, dtype=np.uint64)


#: Punctuation that the tokenizer keeps apart from letters before it. The tokenizer's own classes.
_CLOSING = ".,;:!?*#&%$|"
#: Letters of which each is one letter in lower case too, whatever stands beside it. ASCII's and Latin-1's.
#: Others may become a letter and a combining mark, which the tokenizer takes together with the punctuation behind it.
_LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


#: The letters of Latin-1 as the tokenizer's model has them: a sign for each byte of UTF-8, as of ByteLevel.
_SIGNS = {c: "".join(chr(b if b >= 0xAE or 0xA1 <= b <= 0xAC else {0xAD: 0x143}.get(b, b + 0xA2)) for b in chr(c).encode()) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}


def laid(flat: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that end at ends, one after the other in this order, and their ends there."""
    sizes = np.diff(ends, prepend=0)[order]
    after = np.cumsum(sizes)
    return flat[np.repeat(ends[order] - after, sizes) + np.arange(after[-1] if len(after) else 0)], after


def _packed_ids(words: list[str], held: dict[str, bytes], most: int, encoded: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Packed ids of different words; those that are not held are encoded, and held until there are most of them."""
    out = list(map(held.get, words))
    new = [i for i, ids in enumerate(out) if ids is None]
    if new:
        fresh = [words[i] for i in new]
        found = encoded(fresh)
        for i, ids in zip(new, found, strict=True):
            out[i] = ids
        if len(held) < most:
            held.update(zip(fresh, found, strict=True))
    return out


class Encoder:
    """The tokenizers library, with the ids of words remembered.

    The tokenizer normalises characters one by one, drops white space and splits at it, so the ids of a text are those
    of its parts between spaces, tabs and line ends, one after the other. Only such ASCII white space is cut at here.
    It also splits letters from closing punctuation, and lowers the case, so that of parts in plain letters only
    the letters count. These go to the library's model as they stand there after normalising and splitting. Every other
    part goes to the library as it stands. Each different part of the texts at hand is looked at once, and each different
    word of these parts is looked up once; the parts' ids are then laid out by their numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        tokens = self.model.tokenize
        return [self._packed([t.id for t in tokens(x if x.isascii() else x.translate(_SIGNS))]) for x in words]

    def _others(self, parts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts, one part after the other, and where each part's end."""
        tails = pc.utf8_ltrim(parts, _LETTERS)
        plain = pc.and_(pc.less(pc.binary_length(tails), pc.binary_length(parts)), pc.equal(pc.utf8_rtrim(tails, _CLOSING), ""))
        words = pc.utf8_lower(pc.utf8_rtrim(parts.filter(plain), _CLOSING)).dictionary_encode()
        tails = tails.filter(plain).dictionary_encode()
        others = [*tails.dictionary.to_pylist(), *parts.filter(pc.invert(plain)).to_pylist()]
        pieces = _packed_ids(words.dictionary.to_pylist(), self.cores, CORES, self._words)
        first = len(pieces)
        pieces += _packed_ids(others, self.known, REMEMBERED, self._others)
        pieces.append(b"")
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.full((len(parts), 2), len(pieces) - 1)
        order[is_plain, 0] = words.indices
        order[is_plain, 1] = first + tails.indices.to_numpy()
        order[~is_plain, 0] = np.arange(first + len(tails.dictionary), len(pieces) - 1)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) // self.dtype.itemsize
        flat, after = laid(np.frombuffer(b"".join(pieces), self.dtype), ends, order.ravel())
        return flat, after[1::2]

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        spaced = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for blank in "\n\t\r":
            spaced = pc.replace_substring(spaced, blank, " ")
        split = pc.split_pattern(spaced, " ")
        parts = split.flatten().dictionary_encode()
        flat, ends = laid(*self._of_parts(parts.dictionary), parts.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [flat[a:b] for a, b in itertools.pairwise(bounds.tolist())]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last ROLL ids begins with USUAL_BITS zero bits, LEAST ids on at the earliest, MOST at the latest."""
    if len(ids) <= LEAST:
        return [len(ids)]
    value = np.concatenate([[np.uint64(0)], np.cumsum(_GEAR[ids & 0xFFFF] * powers(BASE, len(ids)))])
    rolled = (value[ROLL:] - value[:-ROLL]) * powers(INVERSE, len(ids) - ROLL + 1)
    fit = np.flatnonzero(rolled >> np.uint64(64 - USUAL_BITS) == 0) + ROLL
    out, last = [], 0
    while len(ids) - last > LEAST:
        k = int(np.searchsorted(fit, last + LEAST))
        end = min(int(fit[k]) if k < len(fit) else len(ids), last + MOST, len(ids))
        out.append(end)
        last = end
    if last < len(ids):
        out.append(len(ids))
    return out


def address(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()[:16]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs of hashes are hashed until one is left; an odd one goes up as it is."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"".join(leaves[i : i + 2])).digest()[:16] if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_CHUNK = "slot long, chunk binary, row long, doc_id long, seq int, n int, root binary, payload binary"


def _chunks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk of each text; a chunk that this task has lately seen goes without its payload."""
    names = [f.split()[0] for f in _CHUNK.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    own, squeeze, seen = encoder(path), zstandard.ZstdCompressor(3), {}
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        every = batch.column(1).fill_null("")
        size = np.cumsum(pc.binary_length(every).to_numpy().astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
            out = []
            for doc, ids in zip(batch.column(0).slice(at, end - at).to_pylist(), own.ids(every.slice(at, end - at)), strict=True):
                ids = np.append(ids, own.dtype.type(END_ID))
                ends = cuts(ids)
                parts = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
                names_ = [address(p) for p in parts]
                root = merkle_root(names_)
                for seq, (name, part) in enumerate(zip(names_, parts, strict=True)):
                    first = name not in seen
                    if len(seen) > 1 << 16:
                        seen.clear()
                    seen[name] = True
                    slot = int.from_bytes(name[:8], "little", signed=True) if first else hash((row, seq))
                    out.append((slot, name, row, doc, seq, len(part) // own.dtype.itemsize, root if not seq else None, squeeze.compress(part) if first else None))
                row += 1
            at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _stored_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by slot and chunk, with payloads first, only the first of each chunk keeps its payload."""
    last = None
    for batch in batches:
        names, loads = batch.column(1).to_pylist(), batch.column(7).to_pylist()
        for i, name in enumerate(names):
            if loads[i] is not None:
                if name == last:
                    loads[i] = None
                last = name
        yield pa.RecordBatch.from_arrays([*batch.columns[1:7], pa.array(loads, pa.binary())], batch.schema.names[1:])


def write_store(spark: SparkSession, docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: chunks (chunk, payload), and the manifest (row, doc_id, n_tokens, root, chunks, start); recipes (row, seq, chunk) are its unfolded chunks.

    Ids of each text, with END_ID at the end, are cut into chunks; each distinct chunk's ids are stored once under their
    hash. The manifest lists every document's chunks in ascending doc_id order (null ids first, rows of one id in any
    order), so it is the whole id stream in order, chunk by chunk.
    """
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = shaped.mapInArrow(functools.partial(_chunks, tokenizer), _CHUNK).repartition("slot").sortWithinPartitions("slot", "chunk", F.col("payload").isNull())
    table = written(spark, sent.mapInArrow(_stored_once, _CHUNK.split(", ", 1)[1]), "store")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    whole = table.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.max("root").alias("root"), parts.alias("chunks"))
    placed = written(spark, whole.repartitionByRange("doc_id", "row").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "row"), "counts")
    # one row for each partition of the range split
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = totals.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    started = placed.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("inside")).drop("part", "inside", "before")
    manifest = written(spark, started.repartitionByRange("start").sortWithinPartitions("start"), "manifest")
    return table.where("payload IS NOT NULL").select("chunk", "payload"), manifest.select("row", F.posexplode("chunks").alias("seq", "chunk")), manifest


def _rebuilt(dtype: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document of chunks sorted by row and seq: row, n_tokens, ids_crc32, root. Each chunk is held against its hash."""
    names = ["row", "n_read", "ids_crc32", "read_root"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    unpack, out = zstandard.ZstdDecompressor(), []
    row, n, crc, leaves = None, 0, 0, []
    for batch in batches:
        for r, name, load in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if r != row:
                if row is not None:
                    out.append((row, n, crc, merkle_root(leaves)))
                row, n, crc, leaves = r, 0, 0, []
            part = unpack.decompress(load)
            if address(part) != name:
                raise ValueError("a chunk's content differs from its address")
            ids = np.frombuffer(part, dtype).astype("<u4")
            n, crc = n + len(ids), zlib.crc32(ids.tobytes(), crc)
            leaves.append(name)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if row is not None:
        out.append((row, n, crc, merkle_root(leaves)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_back(chunks: DataFrame, recipes: DataFrame, manifest: DataFrame, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, merkle_root (hex), verified: from the stored files alone."""
    joined = recipes.join(chunks, "chunk").select("row", "seq", "chunk", "payload")
    built = joined.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(functools.partial(_rebuilt, dtype), "row long, n_read long, ids_crc32 long, read_root binary")
    both = manifest.join(built, "row")
    ok = (F.col("root") == F.col("read_root")) & (F.col("n_tokens") == F.col("n_read"))
    return both.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32", F.lower(F.hex("read_root")).alias("merkle_root"), ok.alias("verified"))


def tokenised(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of docs: doc_id, start, n_tokens, ids_crc32, merkle_root, verified.

    A null or empty text is END_ID alone. Rows that repeat an id or a text are stored as documents of their own, whose
    chunks are shared. A chunk whose content differs from its address stops the job. An empty table gives no rows.
    """
    dtype = encoder(tokenizer).dtype.str
    return read_back(*write_store(spark, docs, tokenizer), dtype)
