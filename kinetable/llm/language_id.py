"""Language identification by cross-parsing entropy.

A suffix automaton is built of a bounded sample of labelled text per language.  A text is parsed
against each automaton into longest matches; the language that needs the fewest phrases, times the
logarithm of its sample's length, wins.  Whole texts are parsed.  So that a very long text takes no more
steps than a short one, pieces of 2,048 characters are parsed side by side, one character of every piece
and language a step, each as if a phrase began with it; then each piece is parsed again from the state in
which the piece before leaves off, until both parses are in one state, from where on they are the same.
The phrases found are those of one parse from the text's begin to its end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed

TRAIN_CHARS = 40_000
TRAIN_ROWS = 200
TOTAL_CHARS = 4_000_000
LANGUAGES = 512
CUT = 4
PIECE = 2048
UNKNOWN = 1 << 30
SLICE = 2 << 20


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for i in (*range(0xD800), *range(0xE000, 0x110000)):
        if chr(i).isalpha():
            out[i] = True
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def packed(edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions as one row of slots: those of state s with symbol c stand at base[s] + c, where owner is s.

    States of several edges are fitted in where all their slots are free, the largest first; those of one
    edge take what is free then.
    """
    width = 1 + max((c for e in edges for c in e), default=0)
    base = np.zeros(len(edges), np.int32)
    used = bytearray(width + 1)
    begin = width
    for s in sorted((i for i, e in enumerate(edges) if len(e) > 1), key=lambda i: -len(edges[i])):
        symbols = sorted(edges[s])
        least, at, tries = symbols[0], begin, 0
        while True:
            if len(used) < at + width + 1:
                used.extend(bytes(len(used) + width + 1))
            if not used[at] and not any(used[at - least + c] for c in symbols):
                break
            at, tries = at + 1, tries + 1
        if tries > 64:  # what is free before here is too scattered to look through again
            begin = at - 32
        for c in symbols:
            used[at - least + c] = 1
        base[s] = at - least
    single = [(s, *next(iter(e.items()))) for s, e in enumerate(edges) if len(e) == 1]
    free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0) + width
    free = np.concatenate([free, np.arange(len(used), len(used) + max(len(single) - len(free), 0))])
    for (s, c, _), at in zip(single, free.tolist(), strict=False):
        base[s] = at - c
    owner = np.full(max(len(used), int(free.max(initial=0)) + 1) + width + 1, -1, np.int32)
    to = np.zeros(len(owner), np.int32)
    for s, e in enumerate(edges):
        for c, x in e.items():
            owner[base[s] + c], to[base[s] + c] = s, x
    return base, owner, to


class Parser:
    """The automata of all languages, their transitions packed into slots.

    Symbol 0 stands for anything but the letters that the samples hold, and separates words.  Where a
    state has no transition a phrase ends, and the next begins with the symbol at hand; a symbol that the
    language's sample lacks is a phrase of its own.
    """

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [lang for lang, _ in samples]
        self.letters = _letters()
        lowered = [text.lower() for _, text in samples]
        alphabet = sorted({c for text in lowered for c in set(text) if c.isalpha()})
        self.code = np.zeros(0x110000, np.int32)
        for i, c in enumerate(alphabet, 1):
            self.code[ord(c)] = i
            if len(c.upper()) == 1:
                self.code[ord(c.upper())] = i
        self.width = len(alphabet) + 1
        self.weight = np.array([math.log2(max(len(text), 2)) for text in lowered])
        bases, owners, tos, roots, states, slots = [], [], [], [], 0, 0
        self.begin = np.zeros((len(samples), self.width), np.int32)  # where a phrase that begins with a symbol leads
        for k, text in enumerate(lowered):
            edges = suffix_automaton(self.codes(text).tolist())
            base, owner, to = packed(edges)
            self.begin[k] = states + UNKNOWN
            for c, x in edges[0].items():
                self.begin[k, c] = states + x
            bases.append(base + slots)
            owners.append(np.where(owner >= 0, owner + states, -1))
            tos.append(to + states)
            roots.append(states)
            states, slots = states + len(edges), slots + len(owner)
        none = np.zeros(0, np.int32)
        self.base = np.concatenate(bases, dtype=np.int32) if bases else none
        self.owner = np.concatenate([*owners, np.full(self.width, -1)], dtype=np.int32) if owners else none
        self.to = np.concatenate([*tos, np.zeros(self.width, np.int32)], dtype=np.int32) if tos else none
        self.roots = np.array(roots, np.int32)

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The next state of each lane; phrases that end are added to ``count``."""
        at = self.base.take(state)
        at += symbol
        found = self.to.take(at)
        miss = np.flatnonzero(self.owner.take(at) != state)
        if len(miss):
            tongue = lang.take(miss)
            fresh = self.begin.ravel().take(tongue * self.width + symbol.take(miss))
            count[miss] += (fresh >= UNKNOWN).astype(np.int32) + (state.take(miss) != self.roots.take(tongue))
            found[miss] = fresh & (UNKNOWN - 1)
        return found

    def _pieces(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[piece, language] state after each piece, begun at the root, and phrases ended in it; longest pieces first."""
        many = len(self.languages)
        size = np.array([len(x) for x in pieces])
        grid = np.zeros((len(pieces), size[0]), np.int32)
        for row, x in enumerate(pieces):
            grid[row, : len(x)] = x
        grid = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-size, -np.arange(size[0]), "left") * many
        lang = np.tile(np.arange(many, dtype=np.int32), len(pieces))
        state = np.tile(self.roots, len(pieces))
        count = np.zeros(len(state), np.int32)
        for t in range(size[0]):
            n = live[t]
            state[:n] = self.step(state[:n], lang[:n], np.repeat(grid[t, : n // many], many), count[:n])
        return state.reshape(-1, many), count.reshape(-1, many)

    def _entered(self, pieces: list[np.ndarray], row: np.ndarray, lang: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after each lane's piece when entered in a state, and phrases more than when begun at the root, where it leaves in ``leave``."""
        a, b = entry.copy(), self.roots.take(lang)
        more, less = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        size = np.array([len(pieces[r]) for r in row])
        out = leave.copy()
        live = np.flatnonzero(a != b)
        t = 0
        while len(live):
            ended = size[live] == t
            if ended.any():  # never met: the lane leaves in a state of its own
                out[live[ended]] = a[live[ended]]
                live = live[~ended]
                continue
            symbol = np.array([pieces[r][t] for r in row[live]], np.int32)
            for state, sums in ((a, more), (b, less)):
                got = sums[live]
                state[live] = self.step(state[live], lang[live], symbol, got)
                sums[live] = got
            live = live[a[live] != b[live]]
            t += 1
        return out, more - less

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] phrases of each sequence of symbols."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), PIECE):
                owner.append(i)
                pieces.append(t[a : a + PIECE])
        if not pieces or not self.languages:
            return out
        order = np.array(sorted(range(len(pieces)), key=lambda k: -len(pieces[k])))
        leave, count = np.empty((len(order), len(self.languages)), np.int32), np.empty((len(order), len(self.languages)), np.int32)
        leave[order], count[order] = self._pieces([pieces[k] for k in order])
        owner = np.array(owner)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # pieces that another precedes
        plain, plain_count = leave.copy(), count.copy()
        row, lang = np.repeat(inner, len(self.languages)), np.tile(np.arange(len(self.languages)), len(inner))
        while len(row):
            state, more = self._entered(pieces, row, lang, leave[row - 1, lang], plain[row, lang])
            changed = state != leave[row, lang]
            leave[row, lang], count[row, lang] = state, plain_count[row, lang] + more
            row, lang = row[changed] + 1, lang[changed]  # what follows a piece that leaves otherwise is entered anew
            ok = row < len(pieces)
            row, lang = row[ok], lang[ok]
            ok = owner[row] == owner[row - 1]
            row, lang = row[ok], lang[ok]
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        count[last] += leave[last] != self.roots
        np.add.at(out, owner, count)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score in 0..1; ``und`` and 0 without a letter."""
        points = [np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
        worded = np.array([bool(self.letters[p].any()) for p in points]) & bool(self.languages)
        cost = self.phrases([self.code[p] for p in points]) * self.weight
        if not len(cost) or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = cost.argmin(1)
        odds = np.exp(-(cost - cost.min(1, keepdims=True)) / 8)
        score = np.where(worded, 1 / odds.sum(1), 0.0)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, worded, strict=True)], score


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """(language, sample) of each label, by name; ``docs`` are the labelled rows to learn from.

    A sample is a bounded number of whole texts: of a language's TRAIN_ROWS distinct rows least by hash, as
    many as it takes to reach ``chars`` characters (TOTAL_CHARS over the number of languages, if that is
    less).  Texts beyond ``chars`` come last, the shortest first, so they are taken only where a language
    has nothing else; of one beyond CUT times that only a run of so many characters is, from a place that the hash tells: a language
    has (CUT + 1) ``chars`` characters at most.  Of more than LANGUAGES labels the most frequent are learned, ties by name.  Rows that repeat id and text count once; null and empty texts and null labels teach
    nothing; an empty table gives no samples.  A threshold on the hash, from the number of a label's distinct
    rows, keeps all but some three times as many of them away from the ranking.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(key_col), F.col(text_col)).alias("rank"))
    rows = rows.where("lang is not null and text is not null and text <> ''")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("rank", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    chars = min(chars, max(TOTAL_CHARS // len(counts), 1))
    bound = docs.sparkSession.createDataFrame(
        [(r["lang"], min(int(2.0**64 * (3 * TRAIN_ROWS + 50) / max(r["n"], 1)) - 2**63, 2**63 - 1)) for r in counts], "lang string, bound long"
    )
    begin = F.pmod("rank", F.greatest(F.length("text") - CUT * chars, F.lit(0)) + 1).cast("int")
    near = rows.join(F.broadcast(bound), "lang").where("rank <= bound").select("lang", "rank", F.length("text").alias("size"), F.substring("text", begin + 1, F.lit(CUT * chars)).alias("text"))
    sizes = near.groupBy("lang", "rank").agg(F.max("size").cast("long").alias("size"))
    first = F.when(F.col("size") <= chars, 0).otherwise(F.col("size"))
    order = Window.partitionBy("lang").orderBy(first, "rank")
    before = F.coalesce(F.sum(F.least("size", F.lit(CUT * chars))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = sizes.withColumns({"n": F.row_number().over(order), "before": before}).where((F.col("n") <= TRAIN_ROWS) & (F.col("before") < chars)).select("lang", "rank", "n")
    texts: dict[str, list[str]] = {}
    for r in near.join(F.broadcast(picked), ["lang", "rank"]).groupBy("lang", "n").agg(F.min("text").alias("text")).orderBy("lang", "n").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return [(lang, " ".join(x)) for lang, x in sorted(texts.items())]


def identify(docs: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each whole text; ``und`` with score 0 for null texts and texts without a letter.

    Ties go to the language that is first by name.  Repeated rows and null ids keep their rows; an empty table gives
    no rows; texts of any length are taken whole; other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return flag(own, samples).select("doc_id", "lang_pred", "score")


def flag(docs: DataFrame, samples: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with columns lang_pred and score added, without a join.

    As ``identify``; all columns are passed on, but for ones named lang_pred or score, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Parser(samples))
    kept = in_small_batches(docs).drop(*{"lang_pred", "score"}.difference([text_col]))

    def run(batches):
        model = shared.value
        for whole in batches:
            for b in byte_slices(whole, text_col, SLICE):
                lang, score = model.predict(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double")
