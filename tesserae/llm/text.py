"""Words and n-grams of Arrow string columns as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE_PUNCT = _SPACE.copy()
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _SPACE_PUNCT[_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = np.ones(1, U)
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Give memory that arrays have left back to the system: workers are used again, and stages after this one need it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        p = np.full(max(n, 64), _P, U)
        p[0] = 1
        _pow = np.cumprod(p, dtype=U)
    return _pow


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of runs of rows with about `most` bytes; a longer row is a run of its own."""
    data, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters that UTF-8 starts with C3."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = data[at]
        out[at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 32
    return out


def words(data: np.ndarray, off: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the first word of each row (one more than rows).

    Words are runs of bytes that are no ASCII white space; with fold, punctuation parts them too and case doesn't count.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~(_SPACE_PUNCT if fold else _SPACE)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[off[1:][off[:-1] < off[1:]] - 1] = inside[off[1:][off[:-1] < off[1:]] - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(s):
        return np.zeros(0, U), s, e, np.zeros(len(off), np.int64)
    size = e - s
    at = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(at, size)
    value = (folded(data) if fold else data)[inside].astype(U)
    value += U(1)
    value *= powers(int(size.max()))[rel]
    return mix(np.add.reduceat(value, at)), s, e, np.searchsorted(s, off)


def doubled(h: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each position, as far as ngrams_at() of n needs them."""
    parts, width = [h], 1
    while 2 * width <= n:
        parts.append(_join(parts[-1][: max(len(parts[-1]) - width, 0)], parts[-1][width:]))
        width *= 2
    return parts


def ngrams_at(parts: list[np.ndarray], at: np.ndarray | slice, n: int) -> np.ndarray:
    """Hash of the n words from each of the positions, from doubled(); equal words, equal hash, wherever they are."""
    out, done = None, 0
    for k in range(n.bit_length()):
        if n >> k & 1:
            where = slice(at.start + done, at.stop + done) if isinstance(at, slice) else at + done
            out = parts[k][where] if out is None else _join(out, parts[k][where])
            done += 1 << k
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position that has them. Runs over row ends: the caller picks."""
    return ngrams_at(doubled(h, n), slice(0, len(h) - n + 1), n) if len(h) >= n else np.zeros(0, U)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two stretches one after the other."""
    out = x * U(0xD6E8FEB86659FD93)
    out += y
    out ^= out >> U(32)
    out *= U(0xFF51AFD7ED558CCD)
    out ^= out >> U(29)
    return out


def within(woff: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams over all rows: positions that lie inside one row, and the count of them in each row."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    start = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(start - woff[:-1], count), count


def shingles(h: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams, row after row, and their count. A row of fewer words has one, of all its words."""
    at, count = within(woff, n, len(h))
    grams = ngrams(h, n)
    short = np.flatnonzero((np.diff(woff) > 0) & (count == 0))
    if not len(short):
        return (grams[at] if len(at) else np.zeros(0, U)), count
    count = count.copy()
    count[short] = 1
    out = np.empty(int(count.sum()), U)
    start = np.cumsum(count) - count
    is_short = np.zeros(len(out), bool)
    is_short[start[short]] = True
    out[~is_short] = grams[at] if len(at) else 0
    for r in short:
        x = U(n)
        for y in h[woff[r] : woff[r + 1]]:
            x = mix(np.array([x], U) + y)[0]
        out[start[r]] = x
    return out, count
