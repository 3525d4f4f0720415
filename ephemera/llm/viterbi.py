"""SentencePiece encoding by a streaming Viterbi search over a vocabulary's pieces and scores, and decoding."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Stretches whose ids a worker remembers, and the longest of them, in characters; text characters encoded in one go.
REMEMBERED, SHORT, BATCH = 600_000, 32, 1 << 20


_NONE = -(1 << 200)  # below all scores


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[int, int]]  # piece -> id, score
    ends: dict  # the pieces as a tree read from their last character: character -> deeper tree, id of the piece (-1: none), score
    byte_ids: list[int]
    text: list[bytes]  # of each id
    longest: int
    unknown: int  # score of a character that has no piece; its UTF-8 bytes are emitted


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Pieces of a model file. Scores are scaled to whole numbers, so that sums are exact for any length of text.

    A ValueError says that a piece has a space mark behind another character, over which no path may go here.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, text, ends = {}, [0] * 256, [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            text.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            text.append(b"")
        else:
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {i} goes on over a space")
            text.append(piece.replace(SPACE_MARK, " ").encode())
            pieces[piece] = i, round(model.get_score(i) * 1000)
    for piece, found in pieces.items():
        kids = ends
        for c in piece[:0:-1]:
            kids = kids.setdefault(c, ({}, -1, 0))[0]
        kids[piece[0]] = kids.get(piece[0], ({},))[0], *found
    return Vocabulary(pieces, ends, byte_ids, text, max(map(len, pieces)), min(s for _, s in pieces.values()) - 10_000)


class Stream:
    """Viterbi search over characters that arrive in parts; ids go out as soon as no later character can change them.

    Scores are kept for the last `longest` positions only, as no piece reaches further back. Every so often the
    backpointers of the positions from which a piece can still start are followed to where they all meet: everything
    before that boundary is committed, and its backpointers are dropped. Of equal scores the longest last piece stays.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.tail = ""  # the last longest - 1 characters
        self.scores = [0]  # of the last positions
        self.back: list[tuple[int, int, str]] = []  # of each position not yet committed: its last piece's length and id (-1: bytes), and its character
        self.widest = 0  # most backpointers held at a time

    def feed(self, text: str) -> list[int]:
        ends, longest, unknown = self.vocab.ends, self.vocab.longest, self.vocab.unknown
        scores, back, out = self.scores, self.back, []
        chars = self.tail + text
        for first in range(len(self.tail), len(chars), longest):
            for last in range(first, min(first + longest, len(chars))):
                kids, best, size, ident = ends, _NONE, 1, -1
                # the score list ends at `last`, so that negative places in it are lengths of pieces
                for at in range(last, max(-1, last - longest), -1):
                    node = kids.get(chars[at])
                    if node is None:
                        break
                    kids, found, score = node
                    if found >= 0:
                        score += scores[at - last - 1]
                        if score >= best:
                            best, size, ident = score, last - at + 1, found
                scores.append(best if ident >= 0 else scores[-1] + unknown)
                back.append((size, ident, chars[last]))
            if len(back) >= 2 * longest:
                self.widest = max(self.widest, len(back))
                del scores[:-longest]
                out += self._commit(range(len(back) - longest + 1, len(back) + 1))
        self.tail = chars[1 - longest :]
        return out

    def _commit(self, alive: Iterable[int]) -> list[int]:
        """Follows the alive positions, counted from the last commit, back to their common boundary, and emits what lies before it."""
        back, alive = self.back, {*alive}
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - back[last - 1][0])
        at = meet = alive.pop()
        out: list[int] = []  # from the last id to the first
        while at:
            size, ident, c = back[at - 1]
            if ident >= 0:
                out.append(ident)
            else:
                out += [self.vocab.byte_ids[b] for b in reversed(c.encode("utf-8", "replace"))]
            at -= size
        del back[:meet]
        out.reverse()
        return out

    def close(self) -> list[int]:
        return self._commit([len(self.back)])


_STRETCH = re.compile(" +[^ ]*")


def stretches(text: str) -> list[str]:
    """The text in front of which a space is put, cut before each run of spaces, without each run's first space.

    No piece goes on over a space that follows another character, so there all paths meet, and the stream commits.
    """
    if text[:1] == " " or "  " in text:
        return [s[1:] for s in _STRETCH.findall(" " + text)]
    return text.split(" ")


class Encoder:
    """Streams over texts, with the ids of short stretches remembered."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}

    def _searched(self, stretch: str) -> bytes:
        ids: list[int] = []
        # marks that are characters of the text go out as bytes, so that decoding gives them back
        for k, part in enumerate((" " + stretch).split(SPACE_MARK)):
            if k:
                ids += [self.vocab.byte_ids[b] for b in SPACE_MARK.encode()]
            stream = Stream(self.vocab)
            ids += stream.feed(part.replace(" ", SPACE_MARK))
            ids += stream.close()
        return array("i", ids).tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; an empty text has none."""
        parts = [stretches(t) if t else [] for t in texts]
        known, searched = self.known, self._searched
        found = {s: searched(s) for s in set().union(*parts) if s not in known}
        out = [np.frombuffer(b"".join([known[s] if s in known else found[s] for s in p]), np.int32) for p in parts]
        room = max(0, REMEMBERED - len(known))
        known.update(islice(((s, v) for s, v in found.items() if len(s) <= SHORT), room))
        return out

    def text(self, ids: Iterable[int]) -> str:
        """The text of ids: the pieces' bytes, without the space that stands for the first mark."""
        raw = b"".join(map(self.vocab.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def _encode(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        texts, first = batch.column(at), 0
        while first < len(batch):
            size, end, part = 0, first, []
            while end < len(batch) and (size < BATCH or end == first):
                part.append(texts[end].as_py() or "")
                size, end = size + len(part[-1]), end + 1
            ids = own.ids(part)
            lossless = [own.text(i.tolist()) == t for i, t in zip(ids, part, strict=True)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)), pa.array(flat))
            crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
            more = [column, pa.array([len(i) for i in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(lossless, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), *more], [*batch.schema.names, "ids", "n_ids", "ids_crc32", "lossless"])
            first = end


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and lossless.

    ids are the pieces on the path of the greatest score sum: the search of a unigram model, with this file's scores.
    A space becomes the mark, and one more stands before the text; characters without a piece become byte pieces.
    lossless says that decoding gave the text back. Null and empty texts have no ids and are lossless. Every other
    column passes through, but own columns of these names are replaced; repeated rows stay; an empty table stays empty.
    """
    docs = docs.drop("ids", "n_ids", "ids_crc32", "lossless")
    schema = f"{docs._jdf.schema().toDDL()}, ids array<int>, n_ids long, ids_crc32 long, lossless boolean"
    return docs.mapInArrow(functools.partial(_encode, model, docs.columns.index("text")), schema)


def _decode(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        texts = [None if v is None else own.text(v) for v in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with one more column, decoded: the text of its ids (null for null)."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(functools.partial(_decode, model, encoded.columns.index("ids")), f"{encoded._jdf.schema().toDDL()}, decoded string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_crc32, lossless, ids of every row."""
    encoded = encode(docs.select("doc_id", "text"), model)
    return encoded.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_ids", "ids_crc32", "lossless", "ids")
