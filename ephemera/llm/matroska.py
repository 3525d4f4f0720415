"""Matroska as a column: EBML writing and parsing, and packet tables with timestamps, tracks and byte ranges."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Element ids of the Matroska and EBML specifications.
EBML, EBML_VERSION, DOC_TYPE, DOC_TYPE_VERSION = 0x1A45DFA3, 0x4286, 0x4282, 0x4287
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
DEFAULT_DURATION, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x23E383, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples a second, samples (bytes) of a frame, frames of a laced block, blocks of a cluster.
RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 32
#: Payloads are filled with zero bytes to a positive multiple of this.
UNIT = 64
#: What ends an element of unknown size: the elements that cannot lie in it.
_NEXT = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}}
#: Bytes of texts or files that are handled in one go.
BATCH_BYTES = 1 << 22


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    cluster: int


class Media(NamedTuple):
    scale_ns: int
    duration: float
    tracks: dict[int, str]
    durations: dict[int, int]  # of a frame of each track in ns, where the track states it
    packets: list[Packet]
    cues: list[tuple[int, int, int]]


def size_vint(n: int) -> bytes:
    """A data size: the shortest form whose bits are not all ones, as that means an unknown size."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and body of a block: none for one frame, fixed sizes if all are equal, else EBML sizes."""
    if len(frames) == 1:
        return 0x00, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    head = size_vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += ((b - a) + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return 0x06, bytes([len(frames) - 1]) + head + b"".join(frames)


def write_media(payload: bytes, rate: int = RATE) -> bytes:
    """One PCM track of unsigned 8-bit samples: a cluster per LACE * BLOCKS frames, and a cue for each cluster."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4))
    ms = lambda samples: samples * 1000 // rate
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array(len(payload) * 1000 / rate, ">f8").tobytes()))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(rate, ">f8").tobytes()) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_TYPE, 2) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    block, cluster = FRAME * LACE, FRAME * LACE * BLOCKS
    for c in range(0, len(payload), cluster):
        start, body = ms(c), [unsigned(CLUSTER_TIMESTAMP, ms(c))]
        for b in range(c, min(c + cluster, len(payload)), block):
            flag, data = laced([payload[f : f + FRAME] for f in range(b, min(b + block, len(payload)), FRAME)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + (ms(b) - start).to_bytes(2, "big", signed=True) + bytes([0x80 | flag]) + data))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """A variable-length integer at a position: value (with its length marker or without), position after it, all ones."""
    if at >= len(data):
        raise ValueError("element cut off")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad variable-length integer")
    n = int.from_bytes(data[at : at + width], "big")
    bits = n & (1 << 7 * width) - 1
    return (n if marker else bits), at + width, bits == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of the elements side by side in a range."""
    while at < end:
        ident, at, _ = vint(data, at, True)
        n, at, unknown = vint(data, at, False)
        stop = extent(data, ident, at, end) if unknown else at + n
        if stop > end:
            raise ValueError("element longer than its parent")
        yield ident, at, stop
        at = stop


def extent(data: bytes, ident: int, at: int, end: int) -> int:
    """Where a segment or cluster of unknown size ends: before the first element that cannot lie in it, or with its parent."""
    if ident not in _NEXT:
        raise ValueError("unknown size of an element that must have one")
    while at < end:
        child, body, _ = vint(data, at, True)
        if child in _NEXT[ident]:
            return at
        n, body, unknown = vint(data, body, False)
        at = extent(data, child, body, end) if unknown else body + n
    return at


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def real(data: bytes, start: int, end: int) -> float:
    if end - start not in (0, 4, 8):
        raise ValueError("a real number has 0, 4 or 8 bytes")
    return float(np.frombuffer(data[start:end], f">f{end - start}")[0]) if end > start else 0.0


def block_frames(data: bytes, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and (offset, length) of each frame of a block, for all four kinds of lacing."""
    track, at, _ = vint(data, start, False)
    if at + 3 > end:
        raise ValueError("block cut off")
    relative, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    kind = flags & 0x06
    if not kind:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise ValueError("block cut off")
    count, at = data[at] + 1, at + 1
    if kind == 0x04:
        sizes = [(end - at) // count] * (count - 1)
    elif kind == 0x02:
        sizes = []
        for _ in range(count - 1):
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise ValueError("lacing sizes cut off")
            sizes.append(n + data[at])
            at += 1
    else:
        n, at, _ = vint(data, at, False)
        sizes = [n]
        for _ in range(count - 2):
            before = at
            n, at, _ = vint(data, at, False)
            sizes.append(sizes[-1] + n - (1 << 7 * (at - before) - 1) + 1)
    sizes = sizes[: count - 1]
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes exceed the block")
    frames = []
    for n in sizes:
        frames.append((at, n))
        at += n
    return track, relative, flags, frames


def parse_media(data: bytes) -> Media:
    """Tracks, packets and cues of a file. Raises ValueError on a bad file.

    Packets of a laced block follow one another by the track's stated duration of a frame; without one they share the
    block's timestamp.
    """
    try:
        return _parsed(data)
    except (KeyError, IndexError, UnicodeDecodeError, RecursionError) as e:
        raise ValueError(f"bad file: {e!r}") from e


def _parsed(data: bytes) -> Media:
    scale, duration, tracks, durations, packets, cues, cluster = 1_000_000, 0.0, {}, {}, [], [], -1
    for ident, start, end in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for kind, a, b in elements(data, start, end):
            if kind == INFO:
                for k, x, y in elements(data, a, b):
                    scale = number(data, x, y) if k == TIMESTAMP_SCALE else scale
                    duration = real(data, x, y) if k == DURATION else duration
            elif kind == TRACKS:
                for kind_, x, y in elements(data, a, b):
                    if kind_ != TRACK_ENTRY:
                        continue
                    entry = {k: (p, q) for k, p, q in elements(data, x, y)}
                    track = number(data, *entry[TRACK_NUMBER])
                    tracks[track] = data[slice(*entry.get(CODEC_ID, (0, 0)))].decode()
                    if DEFAULT_DURATION in entry:
                        durations[track] = number(data, *entry[DEFAULT_DURATION])
            elif kind == CLUSTER:
                cluster, base = cluster + 1, 0
                for k, x, y in elements(data, a, b):
                    if k == CLUSTER_TIMESTAMP:
                        base = number(data, x, y)
                    blocks = [(x, y)] if k == SIMPLE_BLOCK else [(p, q) for j, p, q in elements(data, x, y) if j == BLOCK] if k == BLOCK_GROUP else []
                    for p, q in blocks:
                        track, relative, flags, frames = block_frames(data, p, q)
                        first, each = (base + relative) * scale, durations.get(track, 0)
                        packets += [Packet(track, first + i * each, o, n, bool(flags & 0x80), cluster) for i, (o, n) in enumerate(frames)]
            elif kind == CUES:
                for k, x, y in elements(data, a, b):
                    if k != CUE_POINT:
                        continue
                    point = {k: (p, q) for k, p, q in elements(data, x, y)}
                    where = {k: (p, q) for k, p, q in elements(data, *point[CUE_TRACK_POSITIONS])}
                    cues.append((number(data, *point[CUE_TIME]) * scale, number(data, *where[CUE_TRACK]), start + number(data, *where[CUE_CLUSTER_POSITION])))
    return Media(scale, duration, tracks, durations, packets, cues)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of a text (null: none), filled with zero bytes to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows that come to BATCH_BYTES together, or of one longer row."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1)
        yield at, end
        at = end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end in runs(batch.column(1)):
            raw = [t.as_py() or "" for t in batch.column(1).slice(at, end - at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(t.encode()) for t in raw], pa.int64()), pa.array([write_media(payload_of(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a Matroska file in a written table. A null text is an empty one."""
    return written(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("doc_id", *Packet._fields, "codec", "error")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        for at, end in runs(batch.column(1)):
            rows: list[tuple] = []
            for ident, data in zip(batch.column(0).slice(at, end - at).to_pylist(), batch.column(1).slice(at, end - at).to_pylist(), strict=True):
                try:
                    media = parse_media(data or b"")
                    rows += [(ident, *p, media.tracks.get(p.track), None) for p in media.packets]
                except ValueError as e:
                    rows.append((ident, *[None] * (len(fields) - 2), str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(fields))


def packets(media: DataFrame) -> DataFrame:
    """The packet table of stored files: one row per frame with track, timestamp, byte range, keyframe, cluster, codec.

    A file that cannot be read has one row with its error in place of all else. A null file has no packets.
    """
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_packets, "doc_id long, track int, timestamp_ns long, offset long, length long, keyframe boolean, cluster int, codec string, error string")


def features(media: Media, payload: bytes) -> str:
    """Counts from the container, and loudness figures of the samples around the 8-bit middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"tracks={len(media.tracks)};packets={len(media.packets)};clusters={len(media.cues)};ms={media.duration:.3f};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for at, end in runs(batch.column(2)):
            ids, sizes, files = (batch.column(i).slice(at, end - at) for i in range(3))
            rows = []
            for cell in files:
                data = cell.as_py() or b""
                stored = len(data), hashlib.sha256(data).hexdigest()
                try:
                    media = parse_media(data)
                    got = b"".join([data[p.offset : p.offset + p.length] for p in media.packets])
                    rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), *stored, features(media, got), None))
                except ValueError as e:
                    rows.append((None, None, None, *stored, None, str(e)))
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])


def digest_files(kept: DataFrame) -> DataFrame:
    """Of stored files (doc_id, n_bytes, media) what their packets hold; a file that cannot be read has its error instead."""
    return kept.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    Null and empty texts give a payload of 64 zero bytes; repeated rows give repeated rows; an empty table gives none.
    """
    return digest_files(store(spark, docs))
