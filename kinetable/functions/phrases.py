"""Noun phrases of instructions: a hidden Markov tagger decoded by Viterbi, and a finite-state grammar over its tags.

Words of closed classes have their tags, other words likely ones by their ending; moves between tags say what follows what.  Sentences
are decoded together, a word of each a step.  A phrase is determiners, adjectives and numbers before one noun or several; what a
preposition before it says makes it a place, and ``of`` ties it to the phrase before.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLACE_WORDS

PHRASES = "array<struct<phrase:string,head:string,role:string>>"
# The tags, by letter, and words of closed classes.
TAGS = "DANVPCRO"  # determiner, adjective, noun, verb, preposition, conjunction, pronoun, other
WORDS = {
    "D": "the a an this that these those some any each every another both its his her their your my our no all",
    "A": "red green blue yellow black white grey gray orange purple pink brown big small large little tall short long round square open closed empty full first second third last left right top bottom upper lower front back middle other same wooden plastic metal one two three four five six seven eight nine ten",
    "V": "pick put place move push pull grasp grab lift open close turn slide rotate drop take bring insert press wipe pour stack fold unfold is are was were be been do does did has have had can could should must will would go make let get hold keep align release",
    "P": "of up down off out over by with without for through across between above below against around after before " + " ".join(PLACE_WORDS),
    "C": "and or but then while so because if when until as than",
    "R": "it he she they them him you i we me us what which who there here",
    "O": "not please slowly carefully now again very just only also too yes",
}
# Odds by ending and of moves; the model's own choice, larger means likelier.
ENDINGS = (("ly", "O", 6.0), ("ing", "V", 3.0), ("ed", "V", 2.0), ("ful", "A", 4.0), ("ous", "A", 4.0), ("able", "A", 4.0), ("ive", "A", 3.0), ("est", "A", 2.0), ("tion", "N", 4.0), ("ness", "N", 4.0), ("ment", "N", 4.0))
OPEN_CLASS = {"N": 6.0, "A": 1.5, "V": 1.2, "O": 0.3}
MOVES = {
    "^": {"V": 5, "D": 4, "R": 2, "N": 3, "A": 2, "P": 1, "O": 1, "C": 0.5}, "D": {"N": 6, "A": 4, "D": 0.2, "V": 0.1},
    "A": {"N": 8, "A": 2, "C": 0.5, "P": 0.5, "V": 0.1}, "N": {"P": 5, "C": 2, "V": 2, "N": 1.5, "R": 0.5, "D": 0.5, "O": 1, "A": 0.3},
    "V": {"D": 6, "P": 3, "R": 2, "N": 2, "A": 2, "V": 0.5, "O": 1, "C": 0.3}, "P": {"D": 6, "N": 3, "A": 2, "R": 1, "P": 0.7, "V": 0.3},
    "C": {"V": 4, "D": 4, "N": 2, "A": 2, "R": 1, "O": 1, "P": 0.5}, "R": {"P": 3, "V": 4, "C": 1, "O": 1, "D": 0.5, "N": 0.3}, "O": {"V": 3, "D": 2, "N": 1, "A": 2, "P": 2, "O": 1, "C": 1, "R": 1},
}
LEAST = 0.01
# Words that are decoded together and characters that are split together; sizes of memory, no result depends on them.
WORDS_AT_ONCE = 1 << 15
CHARS_AT_ONCE = 1 << 18
SENTENCE, WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
PHRASE = re.compile("D*A*N+")
_KNOWN = {w: tag for tag, words in WORDS.items() for w in words.split()}
_TWO = {"open": "VA", "close": "VA", "left": "AN", "right": "AN", "top": "AN", "bottom": "AN", "front": "AN", "back": "AN", "middle": "AN", "place": "VN", "turn": "VN", "that": "DR", "one": "AN", "square": "AN", "press": "VN"}


@lru_cache(1 << 16)
def emissions(word: str) -> np.ndarray:
    """Log odds of the tags for a word."""
    odds = dict.fromkeys(TAGS, LEAST)
    if word in _TWO:
        odds |= dict.fromkeys(_TWO[word], 4.0)
    elif word in _KNOWN:
        odds[_KNOWN[word]] = 8.0
    elif word[0].isdigit():
        odds |= {"A": 4.0, "N": 2.0}
    else:
        odds |= OPEN_CLASS
        for ending, tag, more in ENDINGS:
            if len(word) > len(ending) + 2 and word.endswith(ending):
                odds[tag] *= more
    return np.log([odds[t] for t in TAGS])


def _moves() -> tuple[np.ndarray, np.ndarray]:
    row = lambda t: np.log([MOVES[t].get(x, LEAST) for x in TAGS]) - np.log(sum(MOVES[t].get(x, LEAST) for x in TAGS))
    return row("^"), np.stack([row(t) for t in TAGS])


def tags(sentences: list[list[str]]) -> list[str]:
    """The likeliest tags of each sentence, a letter a word; of equals the first in the order of TAGS."""
    start, move = _moves()
    order = sorted((k for k, s in enumerate(sentences) if s), key=lambda k: -len(sentences[k]))
    size = np.array([len(sentences[k]) for k in order])
    best, back = np.zeros((len(order), len(TAGS))), []
    for t in range(int(size.max(initial=0))):
        n = int((size > t).sum())
        emit = np.stack([emissions(sentences[k][t]) for k in order[:n]])
        if t:
            ways = best[:n, :, None] + move
            back.append(ways.argmax(1).astype(np.int8))
            best[:n] = ways.max(1) + emit
        else:
            best[:n] = start + emit
    out = [""] * len(sentences)
    for j, k in enumerate(order):
        at = int(best[j].argmax())
        path = [at]
        for t in range(size[j] - 2, -1, -1):
            at = int(back[t][j, at])
            path.append(at)
        out[k] = "".join(TAGS[a] for a in reversed(path))
    return out


def phrases_of(words: list[str], tagged: str) -> list[tuple[str, str, str]]:
    """(phrase without determiners, its last word, object or place or part) in order: a part is what ``of`` ties to the phrase before."""
    out = []
    for m in PHRASE.finditer(tagged):
        inner = [w for w, t in zip(words[m.start() : m.end()], m.group(), strict=True) if t != "D"]
        before = words[m.start() - 1] if m.start() else ""
        role = "part" if before == "of" and out else "place" if before in PLACE_WORDS else "object"
        out.append((" ".join(inner), words[m.end() - 1], role))
    return out


def _tagged(sentences: list[list[str]]):
    """``tags``, of WORDS_AT_ONCE words or so at a time."""
    begin = size = 0
    for k, s in enumerate(sentences):
        size += len(s)
        if size >= WORDS_AT_ONCE or k + 1 == len(sentences):
            yield from tags(sentences[begin : k + 1])
            begin, size = k + 1, 0


def _phrases(texts: list[str | None]) -> pa.Array:
    split = [[WORD.findall(s) for s in SENTENCE.split((t or "").lower())] for t in texts]
    tagged = _tagged([s for sentences in split for s in sentences])
    found, ends = [], [0]
    for sentences in split:
        found += [p for s in sentences for p in phrases_of(s, next(tagged))]
        ends.append(len(found))
    columns = [pa.array([p[k] for p in found], pa.string()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["phrase", "head", "role"]))


def _pieces(texts: pa.Array):
    """Runs of texts of CHARS_AT_ONCE characters or so; a longer one stands alone."""
    begin = size = 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if size and size + n > CHARS_AT_ONCE:
            yield texts.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    yield texts.slice(begin)


def noun_phrases(instruction: Column) -> Column:
    """All noun phrases of a text, in order; empty for null and wordless texts.

    Texts of a batch are taken a few at a time and what they hold goes to Arrow at once, so memory is that of the batch and its result.
    """

    @F.arrow_udf(PHRASES)
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_phrases(part.to_pylist()) for part in _pieces(texts)])

    return run(instruction)
