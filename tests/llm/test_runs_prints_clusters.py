"""Periodic runs, SimHash groups and centroid clusters against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetable.llm import kd_cluster, periodic, simhash_dedup

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(ids):
    """(start, length, period) of every run, by looking at every lag and every stretch."""
    out, n = [], len(ids)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            size = j - i + q
            part = list(ids[i : i + size])
            if size >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("window", [16, 32, 1 << 15])
def test_runs(monkeypatch, window):
    """Short and long windows give what every lag and stretch gives, for loops, nested loops and chance."""
    monkeypatch.setattr(periodic, "WINDOW", window)
    rng = random.Random(window)
    seen = 0
    for _ in range(600):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 6])
        ids = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 14)
            ids = ids[:a] + [(ids[a : a + p])[(i - a) % min(p, n - a)] for i in range(a, n)]
        got = [(r.start, r.length, r.period) for r in periodic.runs(np.array(ids, np.int64))]
        assert got == brute_runs(ids)
        seen += len(got)
    assert seen > 300


def test_lag_counts():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (50, 1), (300, 3), (700, 200)):
        ids = np.minimum(rng.zipf(1.5, n), k)
        most = n // 4
        assert periodic.lag_counts(ids, most).tolist() == [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, most + 1)]


def brute_row(doc_id, text):
    w = SPLIT.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), listed, kept


def test_periodic_query(spark, small):
    from kinetable.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 8000").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in docs:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A a A a A a A a"), (5, "A a A a A a A a"), (None, "x " * 40), (12, "é é ü " * 9), (7, "one two three " * 30_000 + "end"), (8, "a b c d\x0be\x0cf")]
WIDE = "text string, doc_id long, fp long, key long, label string, th long"


def odd_docs(spark, filled=True):
    return spark.createDataFrame([(t, i, None, None, None, None) for i, t in ODD], WIDE).where("true" if filled else "false")


def test_periodic_odd_rows(spark):
    got = periodic.periodic_runs(odd_docs(spark), loop=True).collect()
    short = [x for x in ODD if x[0] != 7]
    assert sorted((tuple(r) for r in got if r["doc_id"] != 7), key=repr) == sorted((brute_row(*x) for x in short), key=repr)
    (long,) = [r for r in periodic.periodic_runs(odd_docs(spark)).collect() if r["doc_id"] == 7]
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 90_000, 3, 30_000_000)
    assert long["collapsed_sha256"] == hashlib.sha256(b"one two three end").hexdigest()
    assert periodic.periodic_runs(odd_docs(spark, False)).count() == 0


def brute_print(text):
    w = SPLIT.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    made = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in made]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(prints):
    """The least fingerprint that links reach, for each, by comparing all pairs."""
    names = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(names[:i] ^ names[i]) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {int(names[i]): int(names[find(i)]) for i in range(len(names))}


def brute_rows(rows):
    prints = [brute_print(t) for _, t in rows]
    group, least = brute_groups(prints), {}
    for (i, _), f in zip(rows, prints, strict=True):
        least.setdefault(group[f], []).append(math.inf if i is None else i)
    return sorted(((i, f"{f:016x}", None if (m := min(least[group[f]])) == math.inf else m) for (i, _), f in zip(rows, prints, strict=True)), key=repr)


def test_simhash_query(spark, small):
    from kinetable.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_simhash_dedup"](spark, small).collect()), key=repr) == brute_rows(rows)


def test_simhash_odd_rows(spark):
    assert sorted(map(tuple, simhash_dedup.simhash_groups(odd_docs(spark)).collect()), key=repr) == brute_rows(ODD)
    assert simhash_dedup.simhash_groups(odd_docs(spark, False)).count() == 0


def test_shingle_hash_is_the_native_one(spark):
    text = "one Two three four five"
    native = [r[0] % (1 << 64) for r in spark.createDataFrame([("one two three four",), ("two three four five",)], "s string").select(F.xxhash64("s")).collect()]
    assert simhash_dedup.fingerprint(text.encode()) == sum(1 << k for k in range(64) if all(h >> k & 1 for h in native))


def test_wildcard_masks_leave_no_pair_out():
    """Any four bits leave one of three segments with one of them at most, at every level."""
    by_free = {}
    for free, segment, mask, rest in simhash_dedup.wildcard_masks():
        by_free.setdefault(free % 2**64, {}).setdefault(segment % 2**64, []).append(mask % 2**64)
        assert (segment ^ mask).bit_count() == 1 or (segment % 2**64 ^ mask % 2**64).bit_count() == 1
        assert rest % 2**64 == free % 2**64 & ~(segment % 2**64)
    rng = random.Random(8)
    for free, segments in by_free.items():
        bits = [k for k in range(64) if free >> k & 1]
        assert sum(segments) == free and len(segments) == 3
        for _ in range(20):
            apart = sum(1 << k for k in rng.sample(bits, 4))
            assert any(apart & m == 0 for masks in segments.values() for m in masks)


@pytest.mark.parametrize("bucket", [2048, 32])
def test_simhash_crowded(spark, bucket):
    """Dense balls, a shared segment and few free bits: the components of all pairs, for roomy and for crowded keys."""
    rng = random.Random(3)
    prints = {0}
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(80):
            prints.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 9))))
    same = rng.getrandbits(22)
    prints |= {rng.getrandbits(42) << 22 | same for _ in range(150)} | {rng.getrandbits(7) << 40 | 7 for _ in range(60)}
    rows = spark.createDataFrame([(simhash_dedup._signed(f),) for f in prints], "fp long")
    root = {f: f for f in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash_dedup.links(rows, bucket).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert (a ^ b).bit_count() <= 4
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in prints} == brute_groups(prints)


def test_spanning_links_are_few():
    """A dense group of n gets n - 1 links, not all pairs."""
    rng = random.Random(1)
    prints = np.array(sorted({7 ^ sum(1 << k for k in rng.sample(range(64), 2)) for _ in range(900)}), np.uint64)
    assert len(simhash_dedup.spanning(prints)[0]) == len(prints) - 1


def brute_clusters(rows, k=16):
    keep = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not keep:
        return []
    order = sorted(keep, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [list(v) for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(4):
        own = [min((gap(v, c), j) for j, c in enumerate(centre)) for _, v in keep]
        for j in range(len(centre) if turn < 3 else 0):
            mine = [v for (_, v), (_, o) in zip(keep, own, strict=True) if o == j]
            if mine:
                centre[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = {j: sum(d for d, o in own if o == j) for j in range(len(centre))}
    return sorted(((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(keep, own, strict=True)), key=repr)


def test_clusters_odd_rows(spark, monkeypatch):
    """Wrong lengths, nulls, NaN, infinities, ties, repeated vectors and ids, null ids, small trees; then fewer vectors than clusters, and none."""
    rng = random.Random(2)
    spots = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(20)]
    rows = [(i, [x + rng.choice([0, 0, 0.02]) for x in rng.choice(spots)]) for i in range(300)]
    rows += [(i % 5, spots[0]) for i in range(40)] + [(None, spots[1]), (None, spots[2]), (900, [0.0] * 64), (901, [1e6] + [-1e6] * 63)]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [math.nan] * 64), (7, [math.inf] + [0.0] * 63), (8, [-math.inf] * 64)]
    schema = "label int, embedding array<double>, vec_id long, cluster string, distance string, ids long, v int"
    frame = lambda some: spark.createDataFrame([(None, v, i, None, None, None, None) for i, v in some], schema)
    got = kd_cluster.clusters(frame(rows + odd))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows)
    assert sorted(map(tuple, kd_cluster.clusters(frame(rows[:9] + rows[:2] + odd)).collect()), key=repr) == brute_clusters(rows[:9] + rows[:2])
    assert kd_cluster.clusters(frame(odd)).collect() == []
    assert kd_cluster.clusters(frame(rows).where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        kd_cluster.clusters(frame([(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("spread", [1, 1000, 1 << 20])
def test_filtering_assigns_like_all_distances(spread):
    """Well parted, touching and equal centroids: whole nodes and resolved leaves give each point its nearest centroid."""
    rng = np.random.default_rng(spread)
    for parted in (0.1, 1, 20):
        heart = rng.integers(-3, 4, (8, 6)) * int(max(spread * parted, 1))
        points = np.concatenate([heart[rng.integers(0, 8, 900)] + rng.integers(-spread, spread + 1, (900, 6)), np.repeat(heart[:1], 200, 0)])
        centroids = np.concatenate([heart, heart[:2]])
        tree, order = kd_cluster.build(points)
        assert (tree.points == points[order]).all() and sorted(order.tolist()) == list(range(len(points)))
        whole, where, which = kd_cluster.assign(tree, centroids)
        got = np.full(len(points), -1)
        got[where] = which
        for nodes, c in whole:
            for k in nodes.tolist():
                assert (got[tree.begin[k] : tree.end[k]] == -1).all()
                got[tree.begin[k] : tree.end[k]] = c
                assert (tree.total[k] == tree.points[tree.begin[k] : tree.end[k]].sum(0)).all()
        assert (got == ((tree.points[:, None] - centroids) ** 2).sum(2).argmin(1)).all()
        if parted == 20:
            assert sum(len(n) for n, _ in whole) > 0


def test_simhash_crowded_by_a_small_join(spark):
    """Few crowded keys among many: a join with them that turns out small as the job runs leaves no key's members apart."""
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(20_000)}
    ball = {5 ^ sum(1 << k for k in rng.sample(range(64), 3)) for _ in range(100)}
    prints |= ball | {p ^ 1 << rng.randrange(64) for p in sorted(prints)[::40]}
    rows = spark.createDataFrame([(simhash_dedup._signed(f),) for f in sorted(prints)], "fp long").checkpoint()
    found = simhash_dedup.links(rows, 32).collect()
    root = {f: f for f in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in prints} == brute_groups(prints)
