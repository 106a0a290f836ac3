"""Quality by Bradley-Terry ranking.

A document's strength is linear in measured features.  It is learned from preference pairs, a good
document over a bad one, by logistic loss on the difference of their features.  Every bad document loses
to PAIRS_PER_BAD good ones, or more where it takes more to have every good one win.  The threshold is a
quantile of the strengths of the learning sample: the one that parts its labels best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed
from .labelled import SAMPLE_ROWS, labelled_sample
from .textcore import utf8, words

PAIRS_PER_BAD = 40
PAIRS_AT_ONCE = 1 << 14
RIDGE = 1e-3

_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "bar", "mark", "other"]
_CLASS_OF = np.full(256, 0, np.int64)
for _k, _bytes in enumerate([b"", bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".!?", b",;:", b"|", b"#%&$*@^~_=+<>\\/{}[]", b"\"'()-`"]):
    _CLASS_OF[list(_bytes)] = _k
_CLASS_OF[:32] = np.where(_CLASS_OF[:32] == 0, 9, _CLASS_OF[:32])


def features(column) -> np.ndarray:
    """[row, feature] of whole texts; a text without words gets zeros but for the first."""
    buf, off = utf8(column)
    rows = len(off) - 1
    size = np.diff(off)
    count = np.zeros((rows, len(_CLASSES)))
    for a in range(0, len(buf), 1 << 20):
        part = buf[a : a + (1 << 20)]
        row = np.searchsorted(off, [a, a + len(part) - 1], "right") - 1
        ends = np.clip(off[row[0] : row[1] + 2] - a, 0, len(part))
        owner = np.repeat(np.arange(row[1] - row[0] + 1), np.diff(ends))
        kinds = np.bincount(owner * len(_CLASSES) + _CLASS_OF[part], minlength=(row[1] - row[0] + 1) * len(_CLASSES))
        count[row[0] : row[1] + 1] += kinds.reshape(-1, len(_CLASSES))
    begin, end, row, h = words(buf, off)
    n = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(n, 1)
    length = (end - begin).astype(float)
    mean = np.bincount(row, length, rows) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / some - mean**2, 0))
    same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    repeat = np.bincount(row[1:][same], minlength=rows) / some
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    fresh, top = np.zeros(rows), np.zeros(rows)
    for i in np.flatnonzero(n > 0):
        v = np.sort(h[starts[i] : starts[i + 1]])
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        fresh[i], top[i] = len(edge) - 1, np.diff(edge).max()
    share = count / np.maximum(size, 1)[:, None]
    raw = np.column_stack([
        np.log1p(n), share, np.sqrt(share[:, [2, 5, 6, 7, 8, 9]]), mean, spread, repeat, np.sqrt(repeat),
        fresh / some, np.log1p(fresh) / np.log(some + 2), top / some, count[:, 4] / some, count[:, 5] / some,
    ])
    raw[n == 0, 1:] = 0
    return raw


@dataclass
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def design(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.centre) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6])

    def score(self, raw: np.ndarray) -> np.ndarray:
        """0..1; 0.5 at the threshold."""
        s = (self.design(raw) @ self.weight - self.threshold) * self.slope
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def preferences(label: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the winners and losers of all pairs; every good and every bad row is in some."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    n = max(PAIRS_PER_BAD * len(bad), len(good))
    win = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    return win, np.resize(bad, n)


def bradley_terry(x: np.ndarray, win: np.ndarray, lose: np.ndarray) -> np.ndarray:
    """The weights that maximise the mean log odds of the winners, less a ridge, by Newton steps; pairs are taken a few at a time."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        grad, curve = -RIDGE * w, RIDGE * np.eye(len(w))
        for a in range(0, len(win), PAIRS_AT_ONCE):
            d = x[win[a : a + PAIRS_AT_ONCE]] - x[lose[a : a + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = grad + d.T @ p / len(win)
            curve = curve + (d * (p * (1 - p))[:, None]).T @ d / len(win)
        step = np.linalg.solve(curve, grad)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(raw: np.ndarray, label: np.ndarray) -> Ranking:
    """The ranking of a sample; one with a single label scores everything as that label, an empty one as good."""
    wide = raw.shape[1] if raw.ndim == 2 else len(features(pa.array([""]))[0])
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        flat = np.zeros(wide)
        return Ranking(flat, flat + 1, np.zeros(2 * wide), 1.0 if len(bad) else -1.0, 4.0)
    centre, scale = raw.mean(0), raw.std(0) + 1e-6
    model = Ranking(centre, scale, np.zeros(2 * wide), 0.0, 1.0)
    x = model.design(raw)
    w = bradley_terry(x, *preferences(label))
    s = x @ w
    order = np.argsort(s, kind="stable")
    right = np.concatenate([[len(good)], len(good) + np.cumsum(np.where(label[order] == 0, 1, -1))])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])  # the quantile k / n of the strengths
    cut = (s[order[max(k - 1, 0)]] + s[order[min(k, len(s) - 1)]]) / 2
    spread = np.median(np.abs(s - cut)) + 1e-9
    return Ranking(centre, scale, w, float(cut), float(4 / spread))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ranking:
    """A ranking from at most ``rows`` labelled rows; ``labels`` are the rows to learn from.

    Null texts count as empty; ids that repeat give a pair's row each.  The sample's measures, not its texts,
    come to the driver.
    """

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                f = features(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(list(f), pa.list_(pa.float64()))], ["label", "f"])

    got = labelled_sample(in_small_batches(docs), labels, label, rows).mapInArrow(trimmed(run), "label int, f array<double>").toArrow()
    raw = np.array(got["f"].to_pylist())
    order = np.lexsort(raw.T) if len(raw) else []
    label_of = got["label"].to_numpy()
    return fit(raw[order] if len(raw) else raw, label_of[order] if len(raw) else label_of)


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each whole text.

    Null texts count as empty and are scored like any other; repeated rows and null ids keep their
    rows, equal texts score alike; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                s = model.score(features(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def flag(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with columns score and predicted added, without a join.

    Null texts count as empty; repeated rows and null ids keep their rows; an empty table gives none.  All
    columns are passed on, but for ones named score or predicted, which are replaced.
    """
    kept = in_small_batches(docs).drop(*{"score", "predicted"}.difference([text_col]))

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, text_col):
                s = model.score(features(b.column(text_col)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(trimmed(run), f"{fields}, score double, predicted int")
