"""Word and shingle hashes of whole texts, computed on Arrow's own buffers with numpy.

A word is a run of bytes outside a set of separators; A-Z are lower-cased. Its hash is a
polynomial over 64 bits of a random value per byte, read off prefix sums, then
finalised with the length. A shingle's hash combines its words' hashes and their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Separators: space and \t \n \v \f \r.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators: every ASCII byte that is no letter or digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def finalise(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_VALUES = finalise(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
#: Multipliers of a shingle's words, by place.
_PLACES = finalise(np.arange(1001, 1065, dtype=np.uint64)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        n = max(1 << 18, 1 << (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, _U(b))
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `most` bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[s:e]."""
    n = len(values)
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        return finalise((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD1B54A32D192ED03))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text (len(texts) + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(_VALUES[data], s, e), np.searchsorted(s, offsets, side="left")


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the number of them before each text; with short, a text of 1 to k - 1 words has one shingle, its whole sequence."""
    n, counts = len(words), np.diff(starts)
    with np.errstate(over="ignore"):
        total = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for i in range(k):
            total += words[i : i + len(total)] * _PLACES[i]
        total = finalise(total + _U(k))
        whole = counts >= k
        per = np.where(whole, counts - k + 1, 0)
        if short:
            per = np.where(whole, per, np.minimum(counts, 1))
        at = np.concatenate([[0], np.cumsum(per)])
        # The place in `total` of each shingle of the longer texts: its text's first word, and on.
        long_per = np.where(whole, per, 0)
        source = np.repeat(starts[:-1], long_per) + (np.arange(int(long_per.sum())) - np.repeat(np.cumsum(long_per) - long_per, long_per))
        out = np.zeros(int(at[-1]), dtype=np.uint64)
        target = np.repeat(at[:-1], long_per) + (np.arange(int(long_per.sum())) - np.repeat(np.cumsum(long_per) - long_per, long_per))
        out[target] = total[source]
        if short:
            for d in np.flatnonzero(~whole & (counts > 0)):
                w = words[starts[d] : starts[d + 1]]
                out[at[d]] = finalise((w * _PLACES[: len(w)]).sum(keepdims=True, dtype=np.uint64) + _U(len(w)))[0]
    return out, at


def shingle_sets(column: pa.Array, k: int, separators: np.ndarray = SPACES, short: bool = True, most: int = 1 << 17) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted hashes."""
    for _, _, data, offsets in chunks(column, most):
        words, starts = word_hashes(data, offsets, separators)
        hashes, at = shingle_hashes(words, starts, k, short)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])
