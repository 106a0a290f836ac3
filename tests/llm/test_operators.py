"""The operators on small frames: brute force, nulls, empty tables, repeats and clashing columns."""

import functools
import itertools
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetable.llm import arrowtools, byte_bpe, chat_format, decontaminate, graph, html_extract, jpeg, language_id, language_model, media, near_dedup, quality, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, rep long, _id long, _th string, th long, doc string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (None, "one two three"), (7, "one two three"), (7, "one two three"), (8, "w " * 30_000)]


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, monkeypatch, width):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rnd = random.Random(width)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 90))]
        for _ in range(rnd.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(1000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a"), (n + 3, "A"), (n + 4, "a b c d e"), (n + 5, "a b c d")]
    got = near_dedup.near_duplicates(docs(spark, rows), width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_edges(spark):
    got = near_dedup.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert (by[1], by[2], by[3], by[4], by[5], by[7], by[None]) == (1, 2, 3, 4, 4, 7, 7)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_trees_do_not_depend_on_where_they_grow(spark, monkeypatch):
    """Nodes that branch across the cluster give the links they give inside a task; pairs that agree on 51 of 64 tokens are found."""
    rng = np.random.default_rng(4)
    sig = np.repeat(rng.integers(0, 1 << 16, (600, near_dedup.COORDS)), 2, axis=0)
    for k in range(1, len(sig), 2):
        other = rng.choice(near_dedup.COORDS, 13, replace=False)
        sig[k, other] = rng.integers(0, 1 << 16, 13)
    sig[:, near_dedup._ROOTS[: near_dedup.TREES]] %= 2
    sig = np.concatenate([sig, np.repeat(sig[:1], 60, axis=0)]).astype(np.uint16)  # and a node that no token splits
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "rep long, sig binary").checkpoint()
    want = {(min(r), max(r)) for r in near_dedup.candidate_links(reps).collect()}
    brute = {(i, j) for i in range(1200) for j in (i + 1 + np.flatnonzero((sig[i + 1 : 1200] == sig[i]).sum(1) >= near_dedup.AGREE)).tolist()}
    assert len(brute) == 600 and want >= brute
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 40)
    assert {(min(r), max(r)) for r in near_dedup.candidate_links(reps).collect()} == want


def test_near_dedup_of_a_group_of_many_blocks(spark, monkeypatch):
    """A chain of texts, each near only to its neighbours, and a large group with strays: exact, however the blocks fall."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rnd = random.Random(9)
    chain = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(chain[5 * k : 5 * k + 90])) for k in range(60)]
    base = [f"b{k}" for k in range(60)]
    for k in range(60, 130):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3])):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(50)}"
        rows.append((k, " ".join(copy)))
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, 2, 80)


def test_deduplicated_keeps_one_row_of_a_group(spark):
    long = " ".join(f"w{k}" for k in range(40))
    near = long.replace("w3 ", "v ")
    rows = [(7, long), (7, long), (None, long), (None, near), (9, "other text of six words here"), (None, "null id only, five words"), (None, "null id only, five words"), (1, None), (1, None), (2, ""), (7, "another text of the same id")]
    got = near_dedup.deduplicated(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(
        [(7, long), (9, "other text of six words here"), (None, "null id only, five words"), (1, None), (1, None), (2, ""), (7, "another text of the same id")]
    )
    assert near_dedup.deduplicated(docs(spark, [])).count() == 0


@pytest.mark.parametrize("here", [0, 1_000_000])
def test_components(spark, monkeypatch, here):
    """By star rounds alone, and by one task."""
    monkeypatch.setattr(graph, "TASK_EDGES", here)
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (100, 1), (5, 5)]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(1, 1), (2, 1), (3, 1), (100, 1), (7, 7), (8, 7), (9, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}
    assert graph.connected_components(chain.where("false")).count() == 0
    rnd = random.Random(here)
    some = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    root = {i: i for e in some for i in e}
    for _ in range(300):
        for a, b in some:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.connected_components(spark.createDataFrame(some, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: c for i, c in root.items() if any(i in e and e[0] != e[1] for e in some)}


def brute_hits(rows, items):
    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = {}
    for i, t in rows:
        w = split(t)
        found = set()
        for k, x in items:
            v = split(x)
            if not v or k is None:
                continue
            width = min(5, len(v))
            runs = lambda u: Counter(tuple(u[p : p + width]) for p in range(len(u) - width + 1))  # noqa: B023, E731
            want = runs(v)
            if not want.keys() & runs(w).keys():  # no window shares anything
                continue
            for a in range(max(len(w) - len(v), 0) + 1):
                have = runs(w[a : a + len(v)])
                same = sum((want & have).values())
                if same and 100 * same >= 80 * (sum(want.values()) + sum(have.values()) - same):
                    found.add(k)
        out[i] = sorted(found | set(out.get(i, [])))
    return out


def passages():
    """Items and documents that hold them whole, edited, shifted, interrupted, at either end and cut."""
    rnd = random.Random(1)
    text = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    items = [(1, text(30)), (2, text(50)), (3, "just three words"), (4, None), (5, ""), (6, "a b a b a b a b a b a b"), (None, text(20)), (1, text(33)), (7, text(300))]
    rows = [(i, text(120)) for i in range(20)]
    rows += [(30, text(9) + " " + items[0][1].upper() + ", " + text(40)), (31, items[1][1]), (32, "x just, three words y"), (33, None), (34, items[5][1] + " tail")]
    edited = items[1][1].split()
    edited[25] = "changed"
    rows += [(35, text(3) + " " + " ".join(edited) + " " + text(3)), (36, " ".join(items[0][1].split()[:15]))]
    part = " ".join(items[1][1].split()[:44])
    rows += [(37, text(30) + " " + part), (38, text(30) + " " + part + " " + text(30)), (39, part), (40, items[1][1] + " " + text(30)), (41, text(30) + " " + items[1][1])]
    words = items[1][1].split()
    rows += [(42, text(9) + " " + " ".join(words[:27] + ["new"] + words[27:]) + " " + text(9)), (43, " ".join(words[3:] + words[:3])), (44, (items[0][1] + " ") * 3), (45, items[7][1])]
    rows += [(46, text(50) + " " + items[8][1] + " " + text(50)), (None, items[0][1]), (None, "something else"), (None, items[0][1]), (30, "another text of this id")]
    return items, rows


def test_decontaminate(spark):
    items, rows = passages()
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), b).collect()
    assert {r["doc_id"]: list(r["item_ids"]) for r in got} == brute_hits(rows, items)
    assert all(r["contaminated"] == bool(r["item_ids"]) for r in got)
    assert decontaminate.contaminated(docs(spark, []), b).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contaminated(docs(spark, rows), b.where("false")).collect())
    edge = decontaminate.contaminated(docs(spark, EDGE), b).collect()
    assert len(edge) == len({i for i, _ in EDGE})


def test_decontaminate_keeps_clean_rows(spark):
    """Each row goes by its own text: a null or repeated id takes no other row with it."""
    items, rows = passages()
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.clean(docs(spark, rows), b)
    assert got.columns == docs(spark, []).columns
    hit = {t: bool(brute_hits([(0, t)], items)[0]) for _, t in rows}
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(x for x in rows if not hit[x[1]])
    assert decontaminate.clean(docs(spark, EDGE), b.where("false")).count() == len(EDGE)
    assert decontaminate.clean(docs(spark, []), b).count() == 0


@pytest.mark.parametrize("bound", ["BROADCAST_WORDS", "BROADCAST_PROBES"])
def test_decontaminate_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, bound, 0)
    items, rows = passages()
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: list(r["item_ids"]) for r in got} == brute_hits(rows, items)


@pytest.mark.parametrize("lane,size", [(9, 255), (21, 300), (31, 40)])
def test_simhash_is_the_majority_of_each_bit(spark, lane, size):
    rnd = random.Random(lane)
    h = [rnd.getrandbits(64) - 2**63 for _ in range(size)]
    got = spark.createDataFrame([(h,), ([],)], "h array<long>").select(decontaminate.simhash("h", lane).alias("f")).collect()
    assert got[0]["f"] == sum(1 << k for k in range(63 // lane * lane) if 2 * sum(x >> k & 1 for x in h) > size)
    assert got[1]["f"] == 0


def cheapest(roles):
    """Least cost by trying everything: each message's role, merge or not, insertion or not."""
    best = {chat_format.START: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for given in chat_format.ROLES:
                change = 0 if given == role else 1 if role == chat_format.UNKNOWN else 2
                to = chat_format.STATE_OF[given]
                ways = []
                if given in chat_format.FOLLOWS[s]:
                    ways.append(c + change)
                if s == to:
                    ways.append(c + change + 1)
                ways += [c + change + 3 for b in chat_format.FOLLOWS[s] if given in chat_format.FOLLOWS[chat_format.STATE_OF[b]]]
                for w in ways:
                    new[to] = min(new.get(to, w), w)
        best = new
    return min(best.get(s, 10**9) for s in chat_format.MAY_END)


CHAT = "conv_id long, turn long, role string, text string, pid string, part string"


def chats():
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "Tool", None]), f"m{t}") for c in (1, 2, 3, None, 5) for t in range(rnd.choice([1, 2, 5, 90]))]
    rows += [(9, t, rnd.choice(["user", "assistant"]), "same") for t in range(250)] + [(9, None, "user", None)]
    rows += [(11, 0, "user", "long " * 300_000), (11, 1, "user", ""), (12, 3, "user", "tie"), (12, 3, "user", "tie"), (12, 3, "assistant", "tie")]
    return rows


def test_chat_format(spark):
    rows = chats()
    made = spark.createDataFrame([(*r, "x", "y") for r in rows], CHAT)
    got = chat_format.format_chats(made, parts=1).collect()
    for c in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        (found,) = [g for g in got if g["conv_id"] == c]
        assert (found["part"], found["n_messages"]) == (0, len(mine))
        assert found["cost"] == cheapest([chat_format.role_of(r[2]) for r in mine])
        state = chat_format.START
        for role in found["roles"].split(","):
            assert role in chat_format.FOLLOWS[state]
            state = chat_format.STATE_OF[role]
        assert state in chat_format.MAY_END and found["rendered"].count(chat_format.CLOSE) == found["n_turns"]
    for parts in (2, 5, 13):
        assert Counter(chat_format.format_chats(made, parts=parts).collect()) == Counter(got), parts
    assert chat_format.format_chats(made.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_long_chats_have_parts(spark, monkeypatch, parts):
    """Parts are cut by number of messages alone, and read in order give the whole conversation."""
    rows = spark.createDataFrame([(*r, "x", "y") for r in chats()], CHAT)
    whole = {r["conv_id"]: r for r in chat_format.format_chats(rows, parts=1).collect()}
    monkeypatch.setattr(chat_format, "PART", 16)
    got = sorted(chat_format.format_chats(rows, parts=parts).collect(), key=lambda r: r["part"])
    for c, r in whole.items():
        mine = [g for g in got if g["conv_id"] == c]
        assert [g["part"] for g in mine] == list(range(len(mine))) and all(g["n_messages"] == 16 for g in mine[:-1])
        assert "".join(g["rendered"] for g in mine) == r["rendered"] and ",".join(g["roles"] for g in mine if g["roles"]) == r["roles"]
        for k in ("n_messages", "n_turns", "cost", "merges", "relabels", "inserts"):
            assert sum(g[k] for g in mine) == r[k]


def test_a_cut_changes_no_choice():
    """Every sequence of up to five messages, cut at every place: the stretches repair as the whole does, ties and all."""
    kinds = (*chat_format.ROLES, chat_format.UNKNOWN)
    for n in range(2, 6):
        for roles in itertools.product(kinds, repeat=n):
            want = chat_format.repair(roles)
            for at in range(1, n):
                stretches = [roles[:at], roles[at:]]
                edges = [(k, 7, len(x), functools.reduce(chat_format.join, map(chat_format.matrix, x))) for k, x in enumerate(stretches)]
                (chain,) = chat_format.cut_costs(edges).values()
                state = min(chat_format.MAY_END, key=lambda s: chain[-1][3][s])
                second = chat_format.repair(stretches[1], chain[1][2], state)
                assert chat_format.entries(stretches[1], chain[1][2])[state] == second[1]
                first = chat_format.repair(stretches[0], chat_format.FRESH, second[1])
                assert (first[0] + second[0], first[2] + second[2]) == (want[0], want[2])


def test_bpe_and_media(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = {(r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.round_trip(docs(spark, EDGE), path, P.PATTERN).collect()}
    assert rows == {(i, (t or "").encode()) for i, t in EDGE}
    back = byte_bpe.decode(byte_bpe.round_trip(docs(spark, EDGE), path, P.PATTERN), path).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, t or "") for i, t in EDGE}
    packed = media.pack(docs(spark, EDGE))
    got = packed.collect()
    assert {(r["doc_id"], bytes(r["payload"])) for r in got} == {(i, media.pad((t or "").encode())) for i, t in EDGE}
    thumbs = media.thumbnail_columns(packed).collect()
    assert {(r["doc_id"], r["thumbnail_hash"]) for r in thumbs} == {(r["doc_id"], r["thumbnail_hash"]) for r in got}
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert all(r["width"] is None for r in media.thumbnail_columns(broken).collect())
    assert media.pack(docs(spark, [])).count() == 0 and byte_bpe.round_trip(docs(spark, []), path, P.PATTERN).count() == 0


def test_media_of_several_pictures(spark):
    """Texts that share their first picture and differ after it differ in height or hash."""
    first = "m" * (jpeg.ROW * jpeg.MOST_BLOCKS)
    ramp = "".join(chr(48 + k // 3) for k in range(jpeg.ROW))
    rows = [(1, first + ramp * 4000), (2, first + ramp[::-1] * 4000), (3, first + ramp * 2)]
    packed = media.pack(docs(spark, rows)).cache()
    got = {r["doc_id"]: r for r in packed.collect()}
    for i, t in rows:
        assert (bytes(got[i]["payload"]), got[i]["width"], got[i]["height"]) == (t.encode(), 8 * jpeg.ROW, 8 * len(t) // jpeg.ROW)
        assert got[i]["thumbnail_hash"] == jpeg.difference_hash(np.frombuffer(t.encode(), np.uint8).reshape(-1, jpeg.ROW))
    assert len({r["thumbnail_hash"] for r in got.values()}) == 3
    for r in media.thumbnail_columns(packed).collect():
        assert (bytes(r["thumbnail"]), r["height"], r["thumbnail_hash"]) == tuple(got[r["doc_id"]][c] for c in ("payload", "height", "thumbnail_hash"))


def test_language_model(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.choice('abc')}{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, "Never Seen é")]
    d = docs(spark, rows).select("doc_id", "text")
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10 and i < 80]
    got = language_model.score(d, d.where("doc_id < 80 and crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"), states=3, frequent=40, own_classes=8).collect()
    toks = lambda t: (t or "").lower().split() + [None]
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        t = toks(dict(rows)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] < 0
    none = language_model.score(d, d.where("false"), states=2).collect()
    assert len(none) == len(rows) and all(r["train_tokens"] == 0 for r in none)
    assert language_model.score(d.where("false"), d.where("false"), states=2).count() == 0


def test_language_model_against_plain_sums(spark, monkeypatch):
    """The score is the sum over all paths of states of the classes' probability, times each word's share of its class."""
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{int(rnd.random() ** 2 * 30)}" for _ in range(rnd.randrange(1, 5)))) for i in range(60)] + [(70, "new w1"), (71, None), (71, None)]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("x"))
    made = []
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: made.append((a[1], train(*a))) or made[-1][1])
    got = language_model.score(d, d.where("doc_id < 60"), states=2, frequent=12, own_classes=5).collect()
    v, m = made[0]
    counts = Counter(h for _, t in rows[:60] for h in language_model.tokens(pa.array([t]))[0].tolist())
    class_of = {}
    for _, t in rows:
        h, _, cls, _ = language_model.Reader(v).classes(pa.array([t or ""]))
        class_of.update(zip(h.tolist(), cls.tolist(), strict=True))
    for k in set(class_of.values()):  # a class has the tokens of its words
        mine = [counts[h] for h in counts if class_of[h] == k]
        assert (v.class_tokens[k], v.class_words[k]) == (sum(mine), len(mine))
    for r in got:
        text = dict(rows)[r["doc_id"]]
        h = language_model.tokens(pa.array([text or ""]))[0].tolist()
        cls = [class_of[x] for x in h]
        total = 0.0
        for path in itertools.product(range(2), repeat=len(h)):
            p = m.start[path[0]] * m.emit[cls[0], path[0]]
            for k in range(1, len(h)):
                p *= m.move[path[k - 1], path[k]] * m.emit[cls[k], path[k]]
            total += p
        share = sum(log10((counts[x] + 0.1) / (v.class_tokens[k] + 0.1 * (v.class_words[k] + 1))) for x, k in zip(h, cls, strict=True) if k >= v.own)
        assert r["score"] == pytest.approx(log10(total) + share)


def test_batches_are_bounded_by_bytes(spark):
    """The session's bound is lowered, never raised."""
    rows = spark.range(1)
    before = spark.conf.get(arrowtools.BATCH_SETTING)
    try:
        for own, want in (("64m", arrowtools.BATCH_BYTES), ("1048576", 1 << 20), (str(64 << 20), arrowtools.BATCH_BYTES)):
            spark.conf.set(arrowtools.BATCH_SETTING, own)
            assert arrowtools.in_small_batches(rows) is rows
            assert int(spark.conf.get(arrowtools.BATCH_SETTING).rstrip("b")) == want
    finally:
        spark.conf.set(arrowtools.BATCH_SETTING, before)


def test_flag_replaces_columns_in_use(spark):
    d = docs(spark, EDGE).withColumn("predicted", F.lit("old")).withColumn("lang_pred", F.lit(1))
    model = quality.learn(d, spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, quality int"))
    got = quality.flag(d, model)
    assert got.columns == [c for c in d.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(EDGE) and got.where("predicted not in (0, 1)").count() == 0


def test_classifiers_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, EDGE)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for some in (labels, labels.where("false")):
            got = module.score(d, module.learn(d, some, label)).collect()
            assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs(spark, []), quality.learn(d, labels)).count() == 0
    labelled = spark.createDataFrame([(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "xx"), (4, "no label", None)], "doc_id long, text string, lang string")
    samples = language_id.learn(labelled)
    assert [s[0] for s in samples] == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, samples).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("de", "en")
    assert language_id.learn(labelled.where("false")) == []


def test_toxicity_learns_exceptions(spark):
    """A term that clean documents use in one phrase only is told apart by it; near copies and repeated rows count once."""
    rnd = random.Random(2)
    filler = lambda n: " ".join(rnd.choice(["you", "pure", "people", "utter"]) if rnd.random() < 0.2 else f"w{rnd.randrange(3000)}" for _ in range(n))
    toxic = [f"{filler(30)} {rnd.choice(['you trash', 'pure trash', 'utter scum', 'trash people'])} {filler(9)}" for _ in range(60)]
    clean = [f"{filler(30)} trash can {filler(9)}" for _ in range(40)] + [filler(40) for _ in range(200)]
    odd = "strange words that were copied often " + filler(40)
    copies = [odd + f" c{k}" for k in range(30)] + [odd] * 10
    rows = [(k, t, y) for k, (t, y) in enumerate([(t, 1) for t in toxic + copies] + [(t, 0) for t in clean] + [(None, 0), ("", 0), ("long " * 200_000, 0)])]
    d = docs(spark, [r[:2] for r in rows])
    model = toxicity.learn(d, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    assert "trash can" in model.exceptions and {w[0] for w in map(str.split, model.weight)} <= {"trash", "tras", "scum"}
    again = [(1, "w1 w2 trash w3"), (2, "w1 w2 trash can w3"), (3, "the TR4SH can and 5cum"), (4, "strange words"), (None, None), (1, "w1 w2 trash w3")]
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score(docs(spark, again), model).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 0), (3, 1), (4, 0), (None, 0), (1, 1)], key=str)
    added = toxicity.learn(d, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"), exceptions=("utter scum",))
    assert added.exceptions[0] == "utter scum"


def test_language_samples(spark, monkeypatch):
    """Repeated rows count once, texts are taken whole, long ones only where there is nothing else, any number of languages."""
    schema = "doc_id long, text string, lang string"
    many = spark.createDataFrame([(1, "the dog and the cat", "en")], schema).crossJoin(spark.range(5000)).drop("id").unionByName(spark.createDataFrame([(2, "der hund", "de")], schema))
    assert language_id.learn(many) == [("de", "der hund"), ("en", "the dog and the cat")]
    rows = [(i, "wort " * 20 + str(i), "de") for i in range(40)] + [(100 + i, "langer text " * (50 - i), "xx") for i in range(3)]
    got = dict(language_id.learn(spark.createDataFrame(rows, schema), chars=300))
    assert got["xx"] == "langer text " * 48 and {len(got["de"])} <= {3 * len(rows[0][1]) + k for k in range(6)}
    several = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(501)], schema)
    assert len(language_id.learn(several)) == 501
    found = language_id.flag(several.withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(1)), [("a", "text"), ("b", "other")])
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r["lang_pred"] for r in found.collect()} == {"a"}


def test_language_filter_without_languages(spark):
    """No lang to learn from: documents with letters stay, their lang null."""
    import corpus_pipeline

    got = corpus_pipeline.language_filter(spark, docs(spark, [*EDGE, (9, "12 34"), (10, "é 1")]), "").collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in got) == [(i, None) for i in (0, 4, 5, 7, 7, 8, 10)]
    some = docs(spark, [(1, "the dog"), (2, "a cat"), (3, "1")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    assert {(r["doc_id"], r["lang"]) for r in corpus_pipeline.language_filter(spark, some, "").collect()} == {(1, "en"), (2, "en")}


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (None, "u", "", "old"), (1, None, "<article><h1>A b c</h1><p>One two three. Four five six.</p></article>", "old")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 35] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert html_extract.extract(pages.where("false")).count() == 0


def test_equal_messages_are_spread(spark, tmp_path):
    """100,000 equal messages without an id, dealt over 8 partitions: none gets more than a third of them."""
    spark.range(100_000).selectExpr("cast(null as long) as conv_id", "1L as turn", "'user' as role", "'again' as text").write.parquet(f"{tmp_path}/t")
    turns = spark.read.parquet(f"{tmp_path}/t")
    got = chat_format.format_chats(turns, parts=8)
    rows = got.select("part", "n_messages", "n_turns", "merges", F.length("rendered").alias("size")).orderBy("part").collect()
    assert [r["part"] for r in rows] == list(range(10)) and all(r["n_messages"] == 10_000 for r in rows)
    assert sum(r["merges"] for r in rows) == 99_999 and sum(r["n_turns"] for r in rows) == 1
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "tie")]
    sizes = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 34_000


def test_language_model_of_long_texts_only(spark):
    """Texts far beyond the start's bound: the states differ, and the model beats the unigram of its classes."""
    lm = language_model

    rng, kinds = random.Random(6), [[f"{k}{j:02d}" for j in range(40)] for k in "abc"]
    texts = [" ".join(rng.choice(kinds[i // 25 % 3]) for i in range(8_500)) for _ in range(24)]
    assert min(map(len, texts)) > lm.START_CHARS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = lm.vocabulary(lm.count_words(docs))
    model = lm.train(docs, v)
    assert np.ptp(model.move, 0).max() > 0.3 and np.ptp(model.emit, 1).max() > 1e-3
    got = lm.score(docs, docs).selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert (got["s"] - got["b"]) / got["n"] > 0.3  # in stretches of 25 words a third of them is likely: log10(3) = 0.48
    runs = [r["text"] for r in lm.start_runs(docs, 10, 500).collect()]
    assert len(runs) == 10 and all(400 < len(r) <= 500 and set(r.split()) <= {w for k in kinds for w in k} for r in runs)
    assert lm.start_runs(docs.where("false")).count() == 0


def test_language_model_start_is_learned_from_all_texts(spark):
    """The start's counts are those of every token of every text, so it moves with each of them, however many there are."""
    lm, rng = language_model, random.Random(7)
    rows = [(i, f"t{i} " + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 12)))) for i in range(900)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a"), (903, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v = lm.vocabulary(lm.count_words(docs), 40, 12)
    size, told = len(v.class_tokens), Counter()
    for _, t in rows:
        cls = lm.Reader(v).classes(pa.array([t]))[2].tolist()
        told.update((x + 1) * size + y for x, y in zip([-1, *cls], cls, strict=False))
    assert {r["pair"]: r["c"] for r in lm.class_pairs(docs, v).collect()} == told and sum(told.values()) == v.n_tokens
    start = lm.train(docs, v, 2, 0)
    picked = {r["text"].split()[0] for r in lm.start_runs(docs, 800).collect()}
    out = next(i for i, t in rows[:900] if t.split()[0] not in picked)
    assert np.abs(lm.train(docs.where(F.col("doc_id") != out), v, 2, 0).emit / start.emit - 1).max() > 1e-4


def test_language_sample_is_bounded(spark):
    """A label whose only text has millions of characters, and more labels than are learned."""
    rows = [(1, "xx", "foo bar " * 400_000), (2, "en", "the cat sat on the mat"), (3, "en", "the dog sat"), (4, "en", "a third text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = dict(language_id.learn(docs))
    assert set(got) == {"en", "xx"} and len(got["xx"]) <= (language_id.CUT + 1) * language_id.TRAIN_CHARS and "foo bar" in got["xx"]
    assert "the cat sat on the mat" in got["en"]
    labels = spark.range(language_id.LANGUAGES + 40).selectExpr("id as doc_id", "concat('l', lpad(id, 5, '0')) as lang", "concat('word ', id) as text").unionByName(docs)
    many = dict(language_id.learn(labels))
    assert len(many) == language_id.LANGUAGES and "en" in many


def family(spark, n, shared, own, seed=1):
    """``exact_links``'s input: one coarse component of ``n`` sets that share ``shared`` shingles and have ``own`` of their own."""
    rng = np.random.default_rng(seed)
    common, rows = rng.integers(0, 2**63, shared).astype(np.uint64), []
    for i in range(n):
        s = np.sort(np.concatenate([common, rng.integers(0, 2**63, own).astype(np.uint64)]))
        rows.append((i, 7, n, bytearray(s.tobytes()), bytearray(near_dedup.signatures(s, np.array([0, len(s)])).tobytes())))
    return spark.createDataFrame(rows, "rep long, coarse long, size long, tokens binary, sig binary")


def test_near_dedup_deals_in_proportion(spark):
    """Sets that share a passage and aren't linked: the rows dealt to cells grow as the sets do, and no pair is left to verify."""
    dealt = {}
    for n in (1_000, 4_000, 16_000):
        labels = spark.range(n).selectExpr("id as rep", "7L as coarse", "id as label")
        wide = spark.range(n).selectExpr("id as rep", "1 as n", "cast('' as binary) as wide")
        dealt[n] = near_dedup.dealt_to_cells(wide, labels).count()
    assert all(n <= rows <= 2 * n for n, rows in dealt.items())
    assert near_dedup.exact_links(family(spark, 600, 40, 20), 80).count() == 0  # similarity 0.5


def test_near_dedup_large_nodes(spark, monkeypatch):
    """Nodes beyond a task that stay large, cells of a few sets, families at every similarity: the components of all pairs."""
    for name, value in (("NODE_ROWS", 30), ("LEAF", 4), ("LEVELS", 2), ("DEEPEST", 5), ("LAST_PAIRS", 8), ("SPREAD", 16), ("BLOCK", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    rng, rows = random.Random(4), []
    for f, (n, own) in enumerate(((60, 40), (60, 14), (60, 8), (60, 5), (40, 200))):
        base = [f"f{f}x{k}" for k in range(60)]
        for _ in range(n):
            rows.append((len(rows), " ".join(base + [f"o{rng.getrandbits(40)}" for _ in range(own)])))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rng.sample(rows, 30))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == components(rows, 2, 80)
    assert len({c for _, c in got.values()}) > 100
