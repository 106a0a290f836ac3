"""Vectorised word splitting and hashing over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Every
function works on whole texts; buffers are walked in pieces of at most 128 KB, cut
at white space, so temporaries stay small however long a text is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 17
LONG_WORD = 256

_rng = np.random.Generator(np.random.PCG64(20240607))
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=_U)[LOWER]
BASE = 0x9E3779B97F4A7C15 & ~7 | 5


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, _U)
    out[0] = 1
    return np.cumprod(out)


POWER, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
FILLED = ~IS_SPACE


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _cuts(buf: np.ndarray, off: np.ndarray):
    """Pieces of the buffer that split no word: at the ends of rows, else at white space."""
    begin, end = 0, len(buf)
    while begin < end:
        stop = min(begin + PIECE, end)
        if stop < end:
            row = int(off[np.searchsorted(off, stop, "right") - 1])
            if row > begin:
                stop = row
            else:
                gaps = np.flatnonzero(IS_SPACE[buf[begin:stop]])
                if len(gaps):
                    stop = begin + int(gaps[-1]) + 1
                else:
                    limit = int(off[np.searchsorted(off, begin, "right")])
                    while stop < limit and not IS_SPACE[buf[stop]]:
                        ahead = np.flatnonzero(IS_SPACE[buf[stop : min(stop + PIECE, limit)]])
                        stop = stop + int(ahead[0]) if len(ahead) else min(stop + PIECE, limit)
        yield begin, stop
        begin = stop


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: begin, end, row and a 64-bit hash of its lower-cased bytes."""
    parts = [_words(buf, off, a, b) for a, b in _cuts(buf, off)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _NONE


def _long_hash(word: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(LOWER[word].tobytes())


def _words(buf, off, a, b):
    part = buf[a:b]
    row0 = int(np.searchsorted(off, a, "right")) - 1
    if b - a > PIECE:  # one word and nothing else
        return np.array([a]), np.array([b]), np.array([row0]), np.array([_long_hash(part)], _U)
    filled = FILLED.take(part)
    edges = np.zeros(b - a + 1, bool)
    edges[1:-1] = filled[1:] != filled[:-1]
    edges[0], edges[-1] = filled[0], filled[-1]
    lo, hi = np.searchsorted(off, a, "right"), np.searchsorted(off, b, "left")
    at = np.flatnonzero(edges)
    inner = off[lo:hi] - a
    inner = np.unique(inner[(inner > 0) & (inner < b - a)])
    inner = inner[filled[inner] & filled[inner - 1]]  # a row ends where a word of the next begins
    if len(inner):
        at = np.insert(at, np.repeat(np.searchsorted(at, inner), 2), np.repeat(inner, 2))
    begins, ends = at[::2], at[1::2]
    if not len(begins):
        return _NONE
    code = BYTE_CODE.take(part)
    code *= POWER[: b - a]
    total = np.zeros(b - a + 1, _U)
    np.cumsum(code, out=total[1:])
    size = ends - begins
    h = (total[ends] - total[begins]) * INVERSE[begins]
    h = mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = _long_hash(part[begins[k] : ends[k]])
    begins, ends = begins + a, ends + a
    return begins, ends, np.searchsorted(off, begins, "right") - 1, h


def shingles(row: np.ndarray, h: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of position, and where each row's begin.

    A row with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    n = np.bincount(row, minlength=rows)[:rows] if len(row) else np.zeros(rows, np.int64)
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    made = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), out
    place = np.arange(len(h)) - np.repeat(starts[:-1], n)
    head = np.flatnonzero(place < np.repeat(made, n))
    left = np.repeat(n, n)[head] - place[head]  # words from here to the row's end
    acc = mix(h[head] + _U(1))
    for k in range(1, width):
        if (left > k).all():
            acc = mix(acc * _U(0xA0761D6478BD642F) + h[head + k])
        else:
            ok = np.flatnonzero(left > k)
            acc[ok] = mix(acc[ok] * _U(0xA0761D6478BD642F) + h[head[ok] + k])
    return acc, out


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and where each row's begin."""
    parts, n = [], np.zeros(len(starts) - 1, np.int64)
    for i in range(len(n)):
        v = np.sort(values[starts[i] : starts[i + 1]])
        if len(v) > 1:
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        n[i] = len(v)
        parts.append(v)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def crc_of_id(ids) -> np.ndarray:
    """crc32 of each id as decimal text; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids], np.int64)
