"""String similarity over pairs: longest common subsequences bit by bit for a whole batch, and the measures made of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of one numpy step, and the longest string (of the shorter side) that fits a machine word.
STEP, WORD = 4096, 64
#: What measures of sorted or common words count for, and those of the best window, up to EIGHT times the length and beyond.
WORDS, WINDOW, FAR, EIGHT = 0.95, 0.9, 0.6, 8.0


def _letters(strings: Sequence[str], width: int, pad: int) -> np.ndarray:
    """Code points, a row each, with pad behind each string's end."""
    out = np.array(strings, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(strings), -1).copy()
    out[np.arange(out.shape[1]) >= np.array([len(s) for s in strings])[:, None]] = pad
    return out


def _long_common(a: str, b: str) -> int:
    """The same for one pair of any length, in an integer of as many bits as letters."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def common(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair (Hyyro 2004), all pairs a letter at a time."""
    out = np.zeros(len(a), np.int64)
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if len(a) else ((), ())
    sizes = np.array([len(x) for x in short], np.int64)
    for i in np.flatnonzero(sizes > WORD).tolist():
        out[i] = _long_common(short[i], long[i])
    # pairs of like lengths together, so that little is padding
    order = np.lexsort((sizes, [len(y) for y in long])) if len(a) else np.zeros(0, np.int64)
    order = order[(sizes[order] > 0) & (sizes[order] <= WORD)]
    bit = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
    for first in range(0, len(order), STEP):
        at = order[first : first + STEP]
        n = sizes[at]
        x = _letters([short[i] for i in at], int(n.max()), 0xFFFFFFFF)
        y = _letters([long[i] for i in at], max(len(long[i]) for i in at), 0xFFFFFFFE)
        s, weights = np.full(len(at), 2**64 - 1, np.uint64), bit[: x.shape[1]]
        for j in range(y.shape[1]):
            u = s & np.where(x == y[:, j : j + 1], weights, np.uint64(0)).sum(1, dtype=np.uint64)
            s = (s + u) | (s - u)
        inside = np.where(n == WORD, np.uint64(2**64 - 1), (np.uint64(1) << n.astype(np.uint64) % np.uint64(WORD)) - np.uint64(1))
        out[at] = np.bitwise_count(~s & inside)
    return out


def ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """2 * LCS / total length, between 0 and 1; two empty strings are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(total > 0, 2 * common(a, b) / np.maximum(total, 1), 1.0)


def _best(groups: list[list[tuple[str, str]]], measure: Callable[[Sequence[str], Sequence[str]], np.ndarray] = ratio) -> np.ndarray:
    """The greatest measure of each group of pairs; 0 for a group without any. Each distinct pair is measured once."""
    flat = [p for g in groups for p in g]
    if not flat:
        return np.zeros(len(groups))
    once = {p: i for i, p in enumerate(dict.fromkeys(flat))}
    values = measure([p[0] for p in once], [p[1] for p in once])
    out, sizes = np.zeros(len(groups)), np.array([len(g) for g in groups])
    np.maximum.at(out, np.repeat(np.arange(len(groups)), sizes), values[[once[p] for p in flat]])
    return out


def _windows(a: str, b: str) -> list[tuple[str, str]]:
    """The shorter string with each window of its length in the longer one, ends included; one that equals it is enough."""
    a, b = sorted((a, b), key=len)
    if not a:
        return [] if b else [("", "")]
    if a in b:
        return [("", "")]
    pairs = {(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b))}
    if len(a) == len(b):
        pairs |= {(a[max(0, i) : i + len(b)], b) for i in range(1 - len(b), len(a))}
    return list(pairs)


def partial_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best ratio of the shorter string with a window of its length in the longer one, ends included."""
    return _best([_windows(x, y) for x, y in zip(a, b, strict=True)])


def _in_order(strings: Sequence[str]) -> dict[str, list[str]]:
    """The words of each distinct string, in order of the alphabet."""
    return {s: sorted(s.split()) for s in set(strings)}


def _split(x: list[str], y: list[str]) -> tuple[str, str, str]:
    """Words of both, of x alone and of y alone, as often as they occur, each sorted and joined."""
    one, two = Counter(x), Counter(y)
    return " ".join(sorted((one & two).elements())), " ".join(sorted((one - two).elements())), " ".join(sorted((two - one).elements()))


def _set_pairs(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """Common words with one side's others and with the other's, and both; nothing common leaves all words of each."""
    if not x or not y:
        return []
    if set(x).isdisjoint(y):
        return [(" ".join(x), " ".join(y))]
    both, own, other = _split(x, y)
    if not (own and other):
        return [("", "")]
    one, two = f"{both} {own}", f"{both} {other}"
    return [(one, two), (both, one), (both, two)]


def word_sort_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The ratio of both strings with their words in order of the alphabet."""
    words = _in_order([*a, *b])
    return ratio([" ".join(words[x]) for x in a], [" ".join(words[x]) for x in b])


def word_set_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best ratio among common words, common words with one side's others, and with the other's.

    1 if one side's words are all the other's; 0 if either has none. Words count as often as they occur.
    """
    words = _in_order([*a, *b])
    return _best([_set_pairs(words[x], words[y]) for x, y in zip(a, b, strict=True)])


def word_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The greater of word_sort_ratio and word_set_ratio."""
    words = _in_order([*a, *b])
    return _best([list({(" ".join(words[x]), " ".join(words[y])), *_set_pairs(words[x], words[y])}) for x, y in zip(a, b, strict=True)])


def partial_word_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """1 if a word is common, else the best window of the sorted words."""
    words = _in_order([*a, *b])
    groups = [[(" ".join(words[x]), " ".join(words[y]))] if set(words[x]).isdisjoint(words[y]) else [("", "")] for x, y in zip(a, b, strict=True)]
    return _best(groups, partial_ratio)


def weighted_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The greatest of the measures at their weights: whole strings and words for like lengths, windows for others; 0 for an empty side."""
    a, b = list(a), list(b)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.float64).reshape(-1, 2)
    least, most = sizes.min(1), sizes.max(1)
    out, far = ratio(a, b), most >= 1.5 * np.maximum(least, 1)
    near = np.flatnonzero(~far & (out < WORDS))
    out[near] = np.maximum(out[near], WORDS * word_ratio([a[i] for i in near], [b[i] for i in near]))
    away = np.flatnonzero(far)
    x, y = [a[i] for i in away], [b[i] for i in away]
    scale = np.where(most[away] <= EIGHT * least[away], WINDOW, FAR)
    out[away] = np.maximum(out[away], scale * np.maximum(partial_ratio(x, y), WORDS * partial_word_ratio(x, y)))
    return np.where(least > 0, out, 0.0)


def _udf(measure: Callable[[Sequence[str], Sequence[str]], np.ndarray]) -> Callable:
    """measure as a function of two string columns; a null side gives null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = measure(a[known].tolist(), b[known].tolist())
        return pd.Series(out).where(known, None).astype("float64")

    return F.pandas_udf(run, T.DoubleType())


ratio_of, partial_ratio_of, weighted_ratio_of = _udf(ratio), _udf(partial_ratio), _udf(weighted_ratio)
