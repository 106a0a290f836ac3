"""A hidden Markov language model.

Words fall into classes: each of the most frequent words is its own class, any other goes by its last
three bytes.  Latent states emit classes; within a class a word has its share of the class's training
count.  So p(text) = p_HMM(classes) * product of p(word | class): the emission table is bounded, the
word counts are as large as the corpus.

Training: word counts are one shuffle of pre-aggregated partial counts, and so are the counts of neighbouring classes
over all training texts, of which the start model is learned; then every training text takes part in each Baum-Welch
round, whose expected counts are summed across partitions.  Scoring: scaled forward recursion per text; counts of frequent words
come from a broadcast table of bounded size, those of the others by a join on the word's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed
from .graph import ensure_checkpoint_dir
from .hmm import Counts, Hmm, baum_welch, forward, pair_counts
from .textcore import LOWER, mix, utf8, words

STATES = 8
OWN_CLASS = 2_000
ENDINGS = 1_024
FREQUENT = 1 << 18
ROUNDS = 2
START_DOCS = 800
START_CHARS = 20_000
PAIR_ROUNDS = 20
TASK_PAIRS = 1 << 20
END = np.uint64(0x456E644F66546578)
COUNT_TOKENS = 1 << 21
SLICE = 4 << 20


def _endings(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word by its last three bytes, lower-cased."""
    code = np.zeros(len(begin), np.uint64)
    for k in (1, 2, 3):
        at = end - k
        code = code * np.uint64(257) + np.where(at >= begin, LOWER[buf[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(ENDINGS)).astype(np.int32)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of each token, an end after each text, and where each text begins."""
    buf, off = utf8(column)
    rows = len(off) - 1
    begin, end, row, h = words(buf, off)
    n = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)
    hashes, ending = np.full(starts[-1], END), np.full(starts[-1], -1, np.int32)
    at = np.arange(len(h)) + row
    hashes[at], ending[at] = h, _endings(buf, begin, end)
    return hashes, ending, starts


class Table:
    """Row numbers of sorted 64-bit keys, found by bucket and a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.size = len(keys)
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        bounds = np.searchsorted(keys, np.arange((2**64 - 1 >> int(self.shift)) + 1, dtype=np.uint64) << self.shift)
        self.first = bounds.astype(np.int64)
        self.steps = int(np.diff(np.append(bounds, len(keys))).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        at = self.first.take((h >> self.shift).astype(np.int64))
        for _ in range(self.steps):
            at += self.keys.take(at) < h
            np.minimum(at, self.size, out=at)
        return np.where((at < self.size) & (self.keys.take(at) == h), at, -1)


@dataclass
class Vocabulary:
    """The frequent words (sorted hashes, counts, class), and each class's word count and number of words."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_tokens: int
    n_words: int
    own: int = OWN_CLASS

    def frequency(self) -> np.ndarray:
        return self.class_tokens / max(self.n_tokens, 1)


class Reader:
    """Class sequences of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.table = Table(vocabulary.hashes)

    def classes(self, column):
        h, ending, starts = tokens(column)
        at = self.table.find(h)
        known = at >= 0
        cls = np.where(known, self.v.classes.take(np.maximum(at, 0)) if len(self.v.classes) else 0, self.v.own + ending)
        return h, at, np.where(cls < 0, 0, cls), starts


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, c): hash, ending class and count of each distinct token of ``docs(text)``."""

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE):
                h, ending, _ = tokens(b.column("text"))
                held.append((h, ending))
                size += len(h)
                if size >= COUNT_TOKENS:
                    yield fold(held)
                    held, size = [], 0
        if held:
            yield fold(held)

    def fold(held):
        h = np.concatenate([x[0] for x in held])
        values, first, n = np.unique(h, return_index=True, return_counts=True)
        ending = np.concatenate([x[1] for x in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ending), pa.array(n.astype(np.int64))], ["h", "ending", "c"])

    return docs.select("text").mapInArrow(trimmed(run), "h long, ending int, c long").groupBy("h").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, own_classes: int = OWN_CLASS) -> Vocabulary:
    """Totals, the most frequent words and the classes' totals; all of bounded size.

    The frequent words are those from a count on at which there are at most ``frequent`` of them, found by a
    histogram of counts, so no task ranks the vocabulary.  The end is always among them.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    bucket = F.floor(F.log2(F.col("c").cast("double")) * 64)
    histogram = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
    cut, size = float("inf"), 0
    for r in histogram:  # a few thousand at most: counts by 64ths of a power of two
        size += r["n"]
        if size > frequent:
            break
        cut = r["b"]
    top = counts.where((bucket >= F.lit(float(cut))) | (F.col("ending") < 0)).toArrow()
    h, c, ending = (top[x].to_numpy() for x in ("h", "c", "ending"))
    rank = np.lexsort((h, -c))
    h, c, ending = h[rank].view(np.uint64), c[rank], ending[rank]
    own = (np.arange(len(h)) < own_classes) | (ending < 0)
    cls = np.where(own, np.minimum(np.arange(len(h)), own_classes - 1), own_classes + ending)
    end = np.flatnonzero(ending < 0)
    if len(end) and end[0] >= own_classes - 1:  # the end's class is its own
        cls[own_classes - 1] = own_classes + ending[own_classes - 1]
        own[own_classes - 1] = end[0] == own_classes - 1
        cls[end[0]] = own_classes - 1
    by_ending = counts.where("ending >= 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    class_tokens, class_words = np.zeros(own_classes + ENDINGS), np.zeros(own_classes + ENDINGS)
    class_tokens[own_classes + by_ending["ending"].to_numpy()] = by_ending["c"].to_numpy()
    class_words[own_classes + by_ending["ending"].to_numpy()] = by_ending["n"].to_numpy()
    for k in np.flatnonzero(own):
        class_tokens[cls[k]], class_words[cls[k]] = c[k], 1
        if ending[k] >= 0:
            class_tokens[own_classes + ending[k]] -= c[k]
            class_words[own_classes + ending[k]] -= 1
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], cls[order].astype(np.int32), class_tokens, class_words, int(total["n"] or 0), int(total["v"]), own_classes)


def start_runs(docs: DataFrame, texts: int = START_DOCS, chars: int = START_CHARS) -> DataFrame:
    """(text): a run of ``chars`` characters at most of each of the ``texts`` texts with words that are least by hash; rows that repeat id and text count once.

    A glance at a corpus: nothing is learned from it.
    """
    rank, size = F.xxhash64("doc_id", "text"), F.length("text")
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(size - chars, F.lit(0)) + 1).cast("int")
    run = F.substring("text", begin + 1, F.lit(chars))
    run = F.when(begin > 0, F.regexp_replace(run, r"^[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])", "")).otherwise(run)
    run = F.when(begin + chars < size, F.regexp_replace(run, r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+$", "")).otherwise(run)
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(run.alias("text"), rank.alias("rank"))
    n = worded.agg(F.approx_count_distinct("rank", 0.02)).first()[0]
    bound = min(int(2.0**64 * (3 * texts + 50) / max(n, 1)) - 2**63, 2**63 - 1)  # so a few thousand runs are ranked, whatever the number of partitions
    return worded.where(F.col("rank") <= bound).groupBy("rank").agg(F.min("text").alias("text")).orderBy("rank").limit(texts).select("text")


def class_pairs(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(pair, c): how often each class comes after another in ``docs(text)``, pair being (class before + 1) * classes + class.

    The class before a text's first is -1, so each token of each text is the later one of one pair.  There are no more rows
    than pairs of classes, however many texts.
    """
    shared, size = docs.sparkSession.sparkContext.broadcast(v), len(v.class_tokens)

    def run(batches):
        reader, held, n = Reader(shared.value), [], 0
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE):
                _, _, cls, starts = reader.classes(b.column("text"))
                pair = cls.astype(np.int64)
                pair[1:] += (cls[:-1].astype(np.int64) + 1) * size
                pair[starts[:-1]] = cls[starts[:-1]]
                held.append(pair)
                n += len(pair)
                if n >= COUNT_TOKENS:
                    yield fold(held)
                    held, n = [], 0
        if held:
            yield fold(held)

    def fold(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["pair", "c"])

    return docs.select("text").mapInArrow(trimmed(run), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def _expected(rows: DataFrame, add, states: int, symbols: int, few: bool = False) -> Counts:
    """The expected counts that ``add(batches, into)`` finds in each partition, summed; ``few`` partitions' without a shuffle."""

    def run(batches):
        found = Counts.zero(states, symbols)
        add(batches, found)
        flat = np.concatenate([found.start, found.move.ravel(), found.emit.ravel(), [found.log_likelihood]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "x"])

    sums = rows.mapInArrow(trimmed(run), "at long, x double")
    got = (sums if few else sums.groupBy("at").agg(F.sum("x").alias("x"))).toArrow()
    flat = np.bincount(got["at"].to_numpy(), got["x"].to_numpy(), states + states * states + symbols * states + 1)
    cut = states + states * states
    return Counts(flat[:states], flat[states:cut].reshape(states, states), flat[cut:-1].reshape(-1, states), flat[-1])


def start_model(docs: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = PAIR_ROUNDS) -> Hmm:
    """A model of the neighbouring classes of all of ``docs(text)``, which are counted once; each round is over these counts.

    Without a token the random model stands, whose states differ.
    """
    frequency = v.frequency()
    model = Hmm.random(states, frequency)
    if not v.n_tokens:
        return model
    joint, size = model.move / states, len(frequency)

    def pack(batches):  # a block of pairs as one row, which a round reads at no cost
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(x).to_numpy().astype(np.int64).tobytes()]) for x in ("pair", "c")], ["pairs", "times"])

    def expect(model: Hmm, joint: np.ndarray):
        def add(batches, into):
            for b in batches:
                for pairs, times in zip(b.column("pairs"), b.column("times"), strict=True):
                    before, after = np.divmod(np.frombuffer(pairs.as_buffer(), np.int64), size)
                    pair_counts(model, joint, before - 1, after, np.frombuffer(times.as_buffer(), np.int64), into)

        return add

    blocks = class_pairs(docs, v).mapInArrow(trimmed(pack), "pairs binary, times binary").checkpoint()
    n = (blocks.agg(F.sum(F.length("pairs"))).first()[0] or 0) // 8
    blocks = blocks.coalesce(-(-n // TASK_PAIRS) or 1)  # a few tasks at most: there are no more pairs than classes squared
    for _ in range(rounds):
        found = _expected(blocks, expect(model, joint), states, size, few=True)
        model, joint = found.model(frequency), (found.move + 0.01) / (found.move + 0.01).sum()
    return model


def train(docs: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """A model of ``docs(doc_id, text)``: a start from the neighbouring classes of all of them, then ``rounds`` over all whole texts."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.broadcast(v)
    frequency = v.frequency()
    model = start_model(docs, v, states)

    def expect(model: Hmm):
        def add(batches, into):
            reader = Reader(shared.value)
            for whole in batches:
                for b in byte_slices(whole, "text", SLICE):
                    _, _, cls, starts = reader.classes(b.column("text"))
                    baum_welch(model, cls, starts, into)

        return add

    for _ in range(rounds):
        model = _expected(docs.select("text"), expect(model), states, len(frequency)).model(frequency)
    return model


def score(docs: DataFrame, training: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, own_classes: int = OWN_CLASS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs(doc_id, text)``.

    base_score is the smoothed unigram's log10 probability, score the model's.  Null texts count as
    empty: one end token.  Repeated rows and null ids keep their rows; an empty table gives no rows.  Without training rows every
    token is unknown and has log10 probability 0 in the base; the model is then the start model.  Texts are
    read whole; columns besides id and text are not looked at.  Expected counts are sums of doubles over
    partitions, so scores of two runs may differ in their last bits; all other columns are the same.
    """
    spark = docs.sparkSession
    docs, training = (x.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) for x in (in_small_batches(docs), training))
    ensure_checkpoint_dir(spark)
    counts = count_words(training).checkpoint()
    v = vocabulary(counts, frequent, own_classes)
    model = train(training, v, states, rounds)
    shared = spark.sparkContext.broadcast((v, model))
    share = float(np.log10(v.n_tokens + 0.1 * (v.n_words + 1)))

    def run(batches):
        v, model = shared.value
        reader = Reader(v)
        within = np.log10(v.class_tokens + 0.1 * (v.class_words + 1))
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE):
                h, at, cls, starts = reader.classes(b.column("text"))
                rows, n = b.num_rows, np.diff(starts)
                row = np.repeat(np.arange(rows), n)
                known = at >= 0
                c = np.where(known, v.counts.take(np.maximum(at, 0)) if len(v.counts) else 0, 0)
                base = np.where(known, np.log10(c + 0.1), 0.0)
                inside = np.where(cls >= v.own, base - within[cls], 0.0)
                hmm = forward(model, cls, starts) / np.log(10)
                rare = np.flatnonzero(~known)
                pairs, times = np.unique(np.stack([row[rare].astype(np.uint64), h[rare]], 1), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), np.uint64), rare)
                cuts = np.searchsorted(pairs[:, 0], np.arange(rows + 1, dtype=np.uint64))
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (pairs[:, 1].astype(np.uint64).view(np.int64) if len(pairs) else np.zeros(0, np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid"), b.column("doc_id"), pa.array(n),
                        pa.array(np.bincount(row, known, rows).astype(np.int64)),
                        pa.array(np.bincount(row, base, rows)), pa.array(np.bincount(row, inside, rows) + hmm), *lists,
                    ],
                    ["rid", "doc_id", "n_tokens", "n_known", "base", "model", "rare", "times"],
                )

    own = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    got = own.mapInArrow(trimmed(run), "rid long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<long>, times array<long>").checkpoint()  # numbers of rows, written down
    rare = got.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts.select("h", "c"), "h", "left").select("rid", "times", F.coalesce("c", F.lit(0)).alias("c"))
    rest = met.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(0.1))).alias("rest"))
    more, left = F.coalesce("more", F.lit(0)), F.coalesce("rest", F.lit(0.0))
    return got.drop("rare", "times").join(rest, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + more).cast("long").alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + left - F.col("n_tokens") * share).alias("base_score"), (F.col("model") + left).alias("score"),
    )
