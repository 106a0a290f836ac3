"""Periodic runs of words: every maximal stretch that repeats with a period at least four times.

Heavy/light lag counting.  For each lag q the number of words that equal the word q further on is counted
exactly: words that are frequent in a window by FFT autocorrelation of where they stand, rare ones by the
differences of all their pairs of places.  A run of period q has 3 q such matches in a row at least, so only lags
with that many are scanned for islands of matches; an island that is long enough is a run.

Windows.  A text of up to WINDOW words is one window and all its lags are counted at once.  A longer one is
counted in windows that overlap by half, lags up to an eighth of a window each, and windows double as lags do.  A run's
first four periods then lie whole in the window that begins next before it, so none is missed; chance
matches do not add up over a long text, so few lags are scanned; and the work grows as n log n, not as n squared.

Smallest period.  A stretch of four periods q that has a smaller period has one that divides q, and is
maximal for both, so of runs with the same start and length the one with the smallest period is it.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import in_small_batches, trimmed

WINDOW = 1 << 15
TIMES = 4
LEAST = 6
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def _needed(lags: np.ndarray) -> np.ndarray:
    """Matches in a row at each lag that a run of this period has at least."""
    return np.maximum(LEAST - lags, (TIMES - 1) * lags)


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most`` the number of places whose word stands again so much further on; 0 at lag 0."""
    n = len(ids)
    counts = np.zeros(most + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    word = ids[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    size = np.diff(np.append(first, n))
    heavy = 8 * size.astype(np.float64) ** 2 > n * np.log2(n + 2)  # a transform costs about n log n, pairs of places size squared
    if heavy.any():
        width = 1 << int(n + most).bit_length()  # no lag wraps around
        power = np.zeros(width // 2 + 1)
        for some in np.array_split(np.flatnonzero(heavy), int(heavy.sum()) * width // (1 << 20) + 1):
            at = np.zeros((len(some), width))
            for row, k in enumerate(some.tolist()):
                at[row, order[first[k] : first[k] + size[k]]] = 1
            f = np.fft.rfft(at)
            power += (f.real**2 + f.imag**2).sum(0)
        counts += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    light = np.repeat(~heavy & (size > 1), size)
    place, word = order[light], word[light]
    live, shift = np.arange(len(place)), 1
    while True:
        live = live[: np.searchsorted(live, len(place) - shift)]
        apart = place[live + shift] - place[live]
        near = (word[live] == word[live + shift]) & (apart <= most)
        live = live[near]  # places further on in the list are further away
        if not len(live):
            break
        counts += np.bincount(apart[near], minlength=most + 1)
        shift += 1
    counts[0] = 0
    return counts


def _reach(ids: np.ndarray, end: int, lag: int) -> int:
    """Where the matches at ``lag`` that come up to ``end`` really end."""
    step = 1024
    while end + lag < len(ids):
        a, b = ids[end : end + step], ids[end + lag : end + lag + step]
        apart = np.flatnonzero(a[: len(b)] != b)
        if len(apart):
            return end + int(apart[0])
        end, step = end + len(b), step * 2
    return end


def _islands(part: np.ndarray, lag: int, needed: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of at least ``needed`` places whose words all stand again at ``lag``."""
    step = needed // 3
    if step > 1:  # a stretch holds three of these places in a row
        there = part[: len(part) - lag : step] == part[lag::step]
        if not (there[:-2] & there[1:-1] & there[2:]).any():
            return []
    same = np.zeros(len(part) - lag + 2, bool)
    np.equal(part[:-lag], part[lag:], out=same[1:-1])
    edges = np.flatnonzero(same[1:] != same[:-1])
    a, b = edges[::2], edges[1::2]
    long = b - a >= needed
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start and then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    width, low = min(n, WINDOW), 1
    while 0 < low <= n // TIMES:
        high = n // TIMES if width >= n else width // (2 * TIMES)
        needed = _needed(np.arange(high + 1))
        done: dict[int, int] = {}  # where the last run of a lag ends
        known = np.array([(s, s + length, q) for (s, length), q in found.items()], np.int64).reshape(-1, 3)
        fresh: list[tuple[int, int, int]] = []
        for begin in range(0, max(n - width // 2, 1), max(width // 2, 1)):
            part = ids[begin : begin + width]
            end = begin + len(part)
            counts = lag_counts(part, high)
            counts[:low] = 0

            def explained(start, stop, q):
                """Matches at multiples of a period are those of its own run; no run of such a lag shares one of them."""
                inside = min(stop, end) - max(start, begin)  # noqa: B023
                if inside > 2 * q:
                    lags = np.arange(2 * q, min(inside, high + 1), q)  # noqa: B023
                    counts[lags] -= inside - lags  # noqa: B023

            fresh = [x for x in fresh if x[1] > begin]
            for x in [*known[(known[:, 0] < end) & (known[:, 1] > begin)].tolist(), *fresh]:
                explained(*x)
            for lag in np.flatnonzero(counts >= np.maximum(needed, 1)).tolist():
                if counts[lag] < needed[lag]:
                    continue
                for a, b in _islands(part, lag, int(needed[lag])):
                    if begin + a < done.get(lag, 0):
                        continue
                    stop = (begin + b if b + lag < len(part) else _reach(ids, begin + b, lag)) + lag
                    done[lag] = stop - lag
                    key = (begin + a, stop - begin - a)
                    if key not in found:
                        found[key] = lag
                        fresh.append((begin + a, stop, lag))
                        explained(begin + a, stop, lag)
        low, width = high + 1, min(2 * width, n)
    return sorted((Run(s, length, q) for (s, length), q in found.items()), key=lambda r: (r.start, r.period))


def longest(found: list[Run]) -> Run | None:
    """The run with the greatest exact quotient of length and period; of equals the one that starts first, then the one of smallest period."""
    best = None
    for r in found:  # in order of start and period
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for r in found:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of all texts, told by the id's checksum, go on from some word in a loop; a null id counts as the empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


def _digest(doc_id: int | None, text: bytes, loop: bool) -> tuple:
    words = text.split()  # at 0x20 and 0x09-0x0D
    if loop:
        words = looped(words, doc_id)
    found = runs(numbered(words))
    listed = hashlib.sha256()
    for r in found:
        listed.update(b"%d,%d,%d\n" % (r.start, r.length, r.period))
    if found:
        words = [words[k] for k in np.flatnonzero(collapsed(len(words), found)).tolist()]
    kept = hashlib.sha256(b" ".join(words)).hexdigest()
    best = longest(found)
    top = (None, None, None, None) if best is None else (best.start, best.length, best.period, 1000 * best.length // best.period)
    return doc_id, len(found), *top, listed.hexdigest(), kept


def _scan(loop: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            rows = [_digest(i.as_py(), t.as_py() or b"", loop) for i, t in zip(b.column("doc_id"), text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = False) -> DataFrame:
    """The periodic runs of each row's words: one row for each row of ``docs``, in one pass without a shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``, case counts.  A run is a maximal stretch of words with smallest period q and
    max(6, 4 q) words at least.  ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the
    greatest length/period, null without a run; ``runs_sha256`` is of all runs, ``collapsed_sha256`` of the text with
    each run cut to its first period.  ``loop`` first makes a tenth of the texts go round in a loop (``looped``).

    Null and empty texts have no words and no runs, and digests of the empty text.  Texts of any length are taken
    whole.  Repeated rows and ids each get their row, a null id is a null; an empty table gives no rows; further
    columns are not looked at.
    """
    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(_scan(loop)), SCHEMA)
