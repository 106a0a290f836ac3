"""Registered queries at the smallest scale: accuracy on held-out rows, the SQL oracle, and the pipeline."""

import re

import duckdb
import pytest

from kinetable.llm.queries import ORACLE_SQL, QUERIES

P = pytest.importorskip("public_tokenizers")
MEDIUM = "/root/testdata/sf0.01"


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    q = c.sql(ORACLE_SQL[name])
    at = [q.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([tuple(r[i] for i in at) for r in q.fetchall()], key=repr)


def test_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for name, truth, column, least in (("op6_quality", labels, "quality", 0.9), ("op9_toxicity", labels, "toxic", 0.9)):
        got = QUERIES[name](spark, MEDIUM).where("held_out").join(truth, "doc_id").selectExpr(f"avg(cast(predicted = {column} as int)) as a").first()["a"]
        assert got > least, name
    lang = QUERIES["op10_language_id"](spark, MEDIUM).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.selectExpr("avg(cast(lang = lang_pred as int)) as a").first()["a"] > 0.97
    lm = QUERIES["op5_language_model"](spark, MEDIUM).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert lm["s"] > lm["b"]


def test_pipeline(spark, small):
    import corpus_pipeline
    from kinetable.llm.near_dedup import near_duplicates

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small)
        assert kept.columns == corpus_pipeline.COLUMNS
        docs = kept.checkpoint()
    assert near_duplicates(docs, width=5).where("not kept").count() == 0
    benchmark = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in docs.collect() for b in benchmark)
    got = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
    assert got.where("length(ids) <> 4 * n_tokens").count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_recall_at_size(spark, width):
    """All links of a larger table, found by comparing every pair of sets of like size: not a component differs."""
    from kinetable.llm.near_dedup import near_duplicates

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
        sets[r["doc_id"]] = {hash(tuple(w[k : k + width])) for k in range(len(w) - width + 1)} if len(w) >= width else {hash(tuple(w))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = 0
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert links > 50
    got = near_duplicates(docs, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), find(i)) for i in sets}


def folder_of(spark, path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, None), (2, ""), (3, " \n"), (4, "12 34"), (5, LONG), (5, LONG), (None, LONG), (None, "a text of its own, with six words"), (7, "y " * 40_000), (8, "before " + LONG + " after"), (9, "one two three four five six")]


@pytest.mark.parametrize("filled", [True, False])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, filled):
    """Nulls, empty and very long texts, repeated ids and rows, missing labels and items, further columns of names in use, empty tables."""
    import corpus_pipeline

    schema = "text string, doc_id long, lang string, source string, n_chars long, score double, predicted int, rep long, _id long, item_id long"
    docs = spark.createDataFrame([(t, i, None, None, None, None, None, None, None, None) for i, t in ROWS], schema).where("true" if filled else "false")
    at = folder_of(spark, tmp_path, [(5, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)] if filled else [], [(1, LONG), (None, "x"), (2, None), (3, "")] if filled else [])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert name == "byte-level BPE" or out.columns == corpus_pipeline.COLUMNS
        seen[name] = out.collect()
    if not filled:
        assert not any(seen.values())
        return
    ids = lambda name: sorted((r["doc_id"] or 0) for r in seen[name])
    assert ids("language ID") == [0, 0, 5, 5, 7, 8, 9]
    assert ids("MinHash near-dedup") == [0, 1, 2, 3, 4, 5, 7, 9]
    assert ids("benchmark decontamination") == [0, 1, 2, 3, 4, 7, 9]
    assert ids("byte-level BPE") == sorted((i or 0) for i, _ in ROWS)
    assert {r["doc_id"]: r["n_tokens"] for r in seen["byte-level BPE"]}[1] == 0


def test_pipeline_against_brute_force(spark, small):
    """Near-dedup, decontamination and language ID of the pipeline, each on its own input, by the plainest means."""
    import corpus_pipeline

    from .test_operators import brute_hits, components

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.near_dedup_filter(spark, docs, small).collect()
    groups = components(rows, corpus_pipeline.SHINGLE_WORDS, 80)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {i for i, found in brute_hits(rows, [x for x in items if x[1]]).items() if found}
    clean = corpus_pipeline.decontaminate_filter(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in clean) == sorted(i for i, _ in rows if i not in held)
    worded = corpus_pipeline.language_filter(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in worded) == sorted(i for i, t in rows if any(c.isalpha() for c in t or ""))
