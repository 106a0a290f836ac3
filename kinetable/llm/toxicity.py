"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, full-width forms, digits that stand for letters; anything else
becomes a space) and matched by one Aho-Corasick automaton of whole words, word beginnings and
exception phrases.  A match inside an exception phrase does not count.  The weights are log odds of a
term in labelled toxic and clean documents, near copies counted once; a term needs more evidence than chance gives among all
candidates, and must stand between different words from document to document, as those of a quoted passage don't; their sum, normalised by length, goes
through a logistic curve that parts labels of rows which the terms were not chosen from: a lexicon of each half measures the other.

Exception phrases are learned, too: two words of which one is a term that toxic documents have more often,
while together they stand in clean documents almost only.  A term that clean documents have too often is
counted again without its occurrences in such phrases, and kept if it tells toxic documents then.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed
from .graph import ensure_checkpoint_dir
from .labelled import SAMPLE_ROWS, labelled_sample
from .near_dedup import AGREE, COORDS, signatures
from .textcore import distinct, shingles, utf8, words

BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS = 4
LEAST_ODDS = 3.0
EVIDENCE = 12.0
CUT = 0.7
#: How much more often one label has a term, for it to tell that label.
TELLING = 20
#: Least share of a term's documents in which it stands between words of its own.
PLACES = 0.5

# Letters that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _folds() -> np.ndarray:
    """The folded code point of each code point; a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    for i in range(0xFF01, 0xFF5F):
        out[i] = out[i - 0xFEE0]
    for c, to in (HOMOGLYPHS | DIGITS).items():
        out[ord(c)] = ord(to)
        if c.upper() != c and len(c.upper()) == 1:
            out[ord(c.upper())] = ord(to)
    return out


_fold_table: list[np.ndarray] = []


def fold(text: str) -> tuple[str, int]:
    """The folded text between spaces, and its words."""
    if not _fold_table:
        _fold_table.append(_folds())
    points = _fold_table[0][np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    return points.tobytes().decode("utf-32-le", "surrogatepass"), int(np.count_nonzero(blank[:-1] & ~blank[1:]))


@dataclass
class Lexicon:
    """Weights by pattern: ``" word "`` or ``" beginning"``; exception phrases; the fitted curve."""

    weight: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    shift: float = -1.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for pattern, w in self.weight.items():
            a.add_word(pattern, (len(pattern), w))
        for phrase in self.exceptions:
            p = f" {fold(phrase)[0].strip()} "
            if p.strip():
                a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def curve(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * density + self.shift, -30, 30)))


def matches(automaton: ahocorasick.Automaton, folded: str) -> dict[int, float]:
    """The heaviest term that begins at each place, but for those that begin inside an exception phrase."""
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(folded):
        begin = end - size + 1
        if w is None:
            excused.append((begin, end))
        elif w > hits.get(begin, 0.0):
            hits[begin] = w
    if not excused:
        return hits
    begins, ends = [], []  # overlapping phrases are one stretch
    for x, y in sorted(excused):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    return {at: w for at, w in hits.items() if (k := bisect_right(begins, at) - 1) < 0 or at >= ends[k]}


def density(automaton: ahocorasick.Automaton, text: str | None) -> float:
    """The weight of all matched words, each counted once by its heaviest term, by log length."""
    if not text or not len(automaton):
        return 0.0
    folded, n = fold(text)
    hits = matches(automaton, folded)
    return sum(hits.values()) / (1 + np.log1p(n / 200)) if hits else 0.0


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(fold(text)[0].split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if len(w) >= k)
    return out


def evidence(t, c, share: float, log):
    """How far counts in toxic and clean documents are from what chance gives; of numbers or columns."""
    n = t + c
    return t * log(t / n / share) + c * log((c + 1e-9) / n / (1 - share))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the terms that tell toxic documents; of overlapping terms the most telling stay."""
    odds: dict[str, tuple[float, int]] = {}
    spare: set[str] = set()
    share = (toxic + 1) / (toxic + clean + 2)
    for term, t, c in counts:
        if t < LEAST_DOCS or evidence(t, c, share, np.log) < EVIDENCE:  # what chance gives among a million terms
            continue
        o = np.log((t + 0.1) / (toxic + 1)) - np.log((c + 0.1) / (clean + 1))
        if o >= LEAST_ODDS and t >= TELLING * c:
            odds[term] = (min(float(o), 8.0), t)
    for term in list(odds):  # of a beginning and what it begins, the longer is kept if it occurs as often
        t = odds[term][1]
        for k in range(2, len(term)):
            short = odds.get(term[:k])
            if short and t >= 0.98 * short[1]:
                spare.add(term[:k])
    odds = {term: x for term, x in odds.items() if term not in spare}
    out: dict[str, float] = {}
    for term in sorted(odds, key=lambda x: (len(x), x)):
        shorter = [term[:k] for k in range(2, len(term)) if term[:k] in out]
        if not any(odds[s][1] >= odds[term][1] and odds[s][0] >= odds[term][0] - 1 for s in shorter):
            out[term] = odds[term][0]
    return out


def contexts(folded: str, terms: set[str]) -> set[str]:
    """The pairs of neighbouring words of which one is among ``terms``."""
    w = folded.split()
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in terms or b in terms}


def near_copies(sig: np.ndarray) -> np.ndarray:
    """The group of each signature: the least row number that pairs of equal tokens, and AGREE equal tokens in all, tie it to."""
    root = np.arange(len(sig))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k in range(0, COORDS, 2):
        _, first, band = np.unique(sig[:, k : k + 2].copy().view(np.uint32).ravel(), return_index=True, return_inverse=True)
        i = np.flatnonzero(first[band] != np.arange(len(sig)))
        j = first[band[i]]
        near = (sig[i] == sig[j]).sum(1) >= AGREE
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sig))], np.int64)


def surroundings(folded: str, hits: dict[int, float]) -> list[tuple[int, int]]:
    """(term, hash of the words before and after) of the first hit of each term whose number ``hits`` gives as weight."""
    out: dict[int, int] = {}
    for at in sorted(hits):
        before = folded[:at].rsplit(None, 1)[-1:]
        after = folded[at:].split(None, 2)[1:2]
        out.setdefault(int(hits[at]) - 1, xxhash.xxh64_intdigest(" ".join((*before, "|", *after))) >> 1)
    return list(out.items())


def well_placed(places: list[tuple[int, int, int]], n: int) -> list[int]:
    """Terms that stand between other words from document to document; ``places`` are (term, documents, different surroundings).

    All words of a passage that several toxic documents quote look telling, but stand between the same words each time.
    """
    return sorted(i for i, docs, apart in places if i < n and apart >= max(PLACES * docs, LEAST_DOCS))


def fit_curve(d: np.ndarray, y: np.ndarray, cut: float = CUT) -> tuple[float, float]:
    """Slope and shift of the logistic curve that is ``cut`` at the density which parts the labels best.

    Of equally good cuts the widest gap's is taken, a quarter of the way up, as one match of a telling
    term should count in a long text as well; the curve is 0.02 at the gap's lower end.
    """
    order = np.argsort(d, kind="stable")
    d, y = d[order], y[order]
    step = np.diff(d) > 0
    right = np.cumsum(1 - y)[:-1] + (y.sum() - np.cumsum(y)[:-1])  # rows 0..k below the cut
    if not step.any():
        return 1.0, -1.0
    gap = np.where(step & (right == right[step].max()), np.diff(d), -1.0)
    k = int(gap.argmax())
    logit = lambda p: np.log(p / (1 - p))
    slope = (logit(cut) - logit(0.02)) / (gap[k] / 4)
    return float(slope), float(logit(cut) - slope * (d[k] + gap[k] / 4))


def _signed(batches):
    """th, label and signature of each row; a text without words has a signature of zeros."""
    for whole in batches:
        for b in byte_slices(whole, "text"):
            buf, off = utf8(b.column("text"))
            _, _, row, h = words(buf, off)
            sig = signatures(*distinct(*shingles(row, h, b.num_rows, 2)))
            yield pa.RecordBatch.from_arrays([b.column("th"), b.column("label"), pa.array([x.tobytes() for x in sig], pa.binary())], ["th", "label", "sig"])


def _counted(sample: DataFrame, found) -> DataFrame:
    """term, toxic, clean: in how many documents of each label ``found(text)`` has a term."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        for whole in batches:
            for b in byte_slices(whole, "text"):
                for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    for t in found(text or ""):
                        seen.setdefault(t, [0, 0])[y == 1] += 1
                if len(seen) > 300_000:
                    yield table(seen)
                    seen = {}
        yield table(seen)

    def table(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], ["term", "toxic", "clean"]
        )

    return sample.mapInArrow(trimmed(run), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(single: DataFrame, exceptions: tuple[str, ...]) -> Lexicon:
    """Terms, weights and exception phrases from ``single(th, text, label)``; the curve is not fitted yet."""
    sizes = {r["label"]: r["n"] for r in single.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = (toxic + 1) / (toxic + clean + 2)
    told = evidence(F.col("toxic"), F.col("clean"), share, F.log)
    often = (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > share * (F.col("toxic") + F.col("clean")))
    often_there = _counted(single, _terms).where(often).withColumn("told", told).checkpoint()
    least = max(EVIDENCE, float(np.log(max(often_there.count(), 1))) + 2)  # of all candidates chance gives 0.14 so much evidence
    counts = [(r["term"], r["toxic"], r["clean"]) for r in often_there.where(F.col("told") >= least).orderBy("term").collect()]
    mixed = {t.strip() for t, n, c in counts if c and n < TELLING * c and t.endswith(" ")}
    excused: tuple[str, ...] = ()
    if mixed:
        pairs = _counted(single, lambda text: contexts(fold(text)[0], mixed))
        excused = tuple(r["term"] for r in pairs.where(f"clean >= {LEAST_DOCS} and clean >= {TELLING} * toxic").orderBy("term").collect())
    if excused:
        names = sorted(mixed)
        trial = Lexicon({f" {t} ": float(k + 1) for k, t in enumerate(names)}, excused)

        def outside(text):
            if not made:
                made.append(trial.automaton())
            return {f" {names[int(w) - 1]} " for w in matches(made[0], fold(text)[0]).values()}

        made: list = []
        again = {r["term"]: (r["term"], r["toxic"], r["clean"]) for r in _counted(single, outside).collect()}
        counts = [again.get(x[0], (x[0], 0, 0)) if x[0].strip() in mixed and x[0].endswith(" ") else x for x in counts]
    weight = choose(counts, toxic, clean)
    kept = {t.strip() for t in weight}
    excused = tuple(x for x in excused if any(w in kept for w in x.split()))
    terms = sorted(weight)

    def found(batches):
        a = Lexicon({t: float(i + 1) for i, t in enumerate(terms)}, ()).automaton()
        for whole in batches:
            for b in byte_slices(whole, "text"):
                folded = [fold(x or "")[0] for x in b.column("text").to_pylist()]
                hits = [x for f in folded if len(a) for x in surroundings(f, matches(a, f))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hits], pa.int32()), pa.array([x[1] for x in hits], pa.int64())], ["term", "place"])

    places = single.where("label = 1").mapInArrow(trimmed(found), "term int, place long").groupBy("term").agg(F.count("*").alias("docs"), F.countDistinct("place").alias("apart")).collect()
    return Lexicon({terms[i]: weight[terms[i]] for i in well_placed([tuple(r) for r in places], len(terms))}, (*exceptions, *excused))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows; ``labels`` are the rows to learn from.

    Texts and near copies of one label count once; null texts as empty.  ``exceptions`` are phrases added to
    those learned.  Without labelled rows the lexicon is empty; with one label only, all score as it.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sample = labelled_sample(in_small_batches(docs), labels, label, rows).withColumn("th", F.xxhash64("text")).checkpoint()  # so the documents are read once
    signed = sample.mapInArrow(trimmed(_signed), "th long, label int, sig binary").dropDuplicates(["th", "label"]).orderBy("th", "label").toArrow()
    if not signed.num_rows:
        return Lexicon(exceptions=exceptions)
    th, y = signed["th"].to_numpy(), signed["label"].to_numpy()
    group = near_copies(np.frombuffer(b"".join(signed["sig"].to_pylist()), np.uint16).reshape(-1, COORDS))
    _, first = np.unique(np.stack([group, y], 1), axis=0, return_index=True)
    one = spark.createDataFrame([(int(th[i]), int(y[i])) for i in first], "th long, label int")
    single = sample.join(F.broadcast(one), ["th", "label"]).dropDuplicates(["th", "label"]).checkpoint()
    model = _lexicon(single, exceptions)
    halves = [_lexicon(single.where(F.pmod("th", F.lit(2)) == k), exceptions) for k in (0, 1)]
    if all(h.weight for h in halves):  # the curve is fitted on rows that a lexicon hasn't seen
        got = [_densities(single.where(F.pmod("th", F.lit(2)) != k), h) for k, h in enumerate(halves)]
        y, d = (np.concatenate(x) for x in zip(*got, strict=True))
    else:
        y, d = _densities(single, model)
    if 0 < y.sum() < len(y):
        model.slope, model.shift = fit_curve(d, y)
    elif len(y):
        model.slope, model.shift = 0.0, 5.0 if y.all() else -5.0
    return model


def _densities(rows: DataFrame, model: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Label (1 or 0) and density of each of ``rows(label, text)``."""

    def measure(batches):
        a = model.automaton()
        for whole in batches:
            for b in byte_slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([density(a, x) for x in b.column("text").to_pylist()], pa.float64())], ["label", "density"])

    got = rows.select("label", "text").mapInArrow(trimmed(measure), "label int, density double").toArrow()
    return got["label"].to_numpy().astype(float), got["density"].to_numpy()


_automata: dict[str, ahocorasick.Automaton] = {}


def score(docs: DataFrame, model: Lexicon, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each whole text.

    Null texts count as empty: no match, the curve's value at zero.  Texts are matched whole, however long.
    Repeated rows and null ids keep their rows; an empty table gives none; other columns are not looked at.
    """
    name = hashlib.sha256(repr(model).encode()).hexdigest()

    def run(batches):
        if name not in _automata:
            _automata.clear()
            _automata[name] = model.automaton()
        a = _automata[name]
        for whole in batches:
            for b in byte_slices(whole, "text"):
                s = model.curve(np.array([density(a, x) for x in b.column("text").to_pylist()], float))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, score double, predicted int")
