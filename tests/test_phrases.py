"""The tagger against every sequence of tags, and phrases of instructions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinetable.functions import phrases


def test_viterbi_is_the_best_of_all_sequences():
    rng = random.Random(2)
    start, move = phrases._moves()
    vocabulary = ["the", "red", "cup", "pick", "on", "and", "it", "open", "running", "widget", "slowly", "7", "square", "that"]
    sentences = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 5))] for _ in range(40)]

    def weight(words, path):
        w = start[path[0]] + phrases.emissions(words[0])[path[0]]
        return w + sum(move[a, b] + phrases.emissions(x)[b] for a, b, x in zip(path, path[1:], words[1:], strict=False))

    for words, got in zip(sentences, phrases.tags(sentences), strict=True):
        assert len(got) == len(words)
        if words:
            best = max(weight(words, p) for p in itertools.product(range(len(phrases.TAGS)), repeat=len(words)))
            assert weight(words, [phrases.TAGS.index(t) for t in got]) == pytest.approx(best)


CASES = {
    "Pick up the red cup from the wooden table": [("red cup", "cup", "object"), ("wooden table", "table", "place")],
    "put carrots and two green apples into a metal bowl": [("carrots", "carrots", "object"), ("two green apples", "apples", "object"), ("metal bowl", "bowl", "place")],
    "grab the handle of the big drawer": [("handle", "handle", "object"), ("big drawer", "drawer", "part")],
    "open the drawer. Close it!": [("drawer", "drawer", "object")],
    "move the coffee machine behind the toaster": [("coffee machine", "machine", "object"), ("toaster", "toaster", "place")],
    "push it to the left": [("left", "left", "place")],
    "go": [], "": [], None: [], "...": [],
}


def test_phrases(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", phrases.noun_phrases(F.col("t")).alias("p"))
    assert {r["t"]: [tuple(x) for x in r["p"]] for r in rows.collect()} == CASES


def test_texts_are_decoded_a_few_at_a_time(monkeypatch):
    """However many texts a batch has, few words are held decoded; phrases are the same."""
    pa = pytest.importorskip("pyarrow")
    texts = [*CASES, "put the red cup on the table. " * 300, *CASES]
    whole, sizes, tags = phrases._phrases(texts).to_pylist(), [], phrases.tags
    monkeypatch.setattr(phrases, "tags", lambda s: sizes.append(sum(map(len, s))) or tags(s))
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(phrases, "CHARS_AT_ONCE", 200)
    parts = [x for part in phrases._pieces(pa.array(texts)) for x in phrases._phrases(part.to_pylist()).to_pylist()]
    assert parts == whole and max(sizes) < 60 and len(sizes) > 40
    assert [tuple(p.values()) for p in whole[len(CASES)][:2]] == [("red cup", "cup", "object"), ("table", "table", "place")]
