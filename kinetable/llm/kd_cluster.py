"""Centroid clustering of integer vectors by kd-tree filtering.

Vectors become integers, so sums, distances and centroids are exact and don't depend on the order of rows.  Each
partition builds kd-trees of up to TREE vectors once; a node has its count, integer sums and box.  In a round a tree is
walked level by level with the centroids that may still be nearest somewhere in each node's box: of these the one nearest the
box's middle is found, and any other is pruned if it is strictly further than that one from the corner of the box that
favours it most (so from every point of the box).  A node left with one centroid is assigned whole, by its count and sums;
leaves are resolved by exact distances, ties by the smaller number.  Rounds move one row a centroid and partition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import trimmed
from .graph import ensure_checkpoint_dir

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Vectors of one tree, and of a leaf at most.
TREE = 16_384
LEAF = 64
#: Components beyond this have squared distances beyond 64 bits.
LIMIT = 1 << 27
#: Up to this magnitude sums of products are exact in double precision.
EXACT = 1 << 21


@dataclass
class Tree:
    """Nodes in order of depth; children of node k are ``child[k]`` and the one after, none if it is -1."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of ``points``, cut at the middle of the widest side of a box, and the order it puts them in."""
    n, d = points.shape
    order = np.arange(n)
    begin, end, child, depth, low, high = [0], [n], [], [0], [], []
    k = 0
    while k < len(begin):
        a, b = begin[k], end[k]
        own = points[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        side = high[-1] - low[-1]
        axis = int(side.argmax())
        if b - a <= LEAF or not side[axis]:
            child.append(-1)
        else:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], half, kind="introselect")]
            child.append(len(begin))
            begin += [a, a + half]
            end += [a + half, b]
            depth += [depth[k] + 1] * 2
        k += 1
    points, begin, end = points[order], np.array(begin), np.array(end)
    sums = np.zeros((n + 1, d), np.int64)
    np.cumsum(points, axis=0, out=sums[1:])
    return Tree(points, begin, end, np.array(child), np.array(depth), np.array(low), np.array(high), sums[end] - sums[begin]), order


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly: integers wrap around on the way, if at all, but not in the end."""
    return (points * points).sum(1)[:, None] - 2 * _product(points, centroids) + (centroids * centroids).sum(1)


def _survivors(low: np.ndarray, high: np.ndarray, able: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of each box's centroids ``able`` aren't strictly further than another one from all of its points."""
    middle = distances(low + high, 2 * centroids)  # of everything doubled
    best = np.where(able, middle, np.iinfo(np.int64).max).argmin(1)
    square = (centroids * centroids).sum(1)
    left = able.copy()
    for z in np.unique(best).tolist():
        at = np.flatnonzero(best == z)
        toward = centroids - centroids[z]
        # distance to c less distance to z, at the corner that lies furthest toward c
        least = square - square[z] - 2 * (_product(high[at], np.maximum(toward, 0)) + _product(low[at], np.minimum(toward, 0)))
        left[at] &= least <= 0
    return left


def assign(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
    """Nodes assigned whole, as (node numbers, centroid) lists; then points of resolved leaves and their centroids."""
    whole: list[tuple[np.ndarray, int]] = []
    where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    node, able = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(node):
        able = _survivors(tree.low[node], tree.high[node], able, centroids)
        one = able.sum(1) == 1
        owner = able.argmax(1)
        for c in np.unique(owner[one]).tolist():
            whole.append((node[one & (owner == c)], c))
        leaf = ~one & (tree.child[node] < 0)
        for k in np.flatnonzero(leaf).tolist():
            a, b = tree.begin[node[k]], tree.end[node[k]]
            those = np.flatnonzero(able[k])
            where.append(np.arange(a, b))
            which.append(those[distances(tree.points[a:b], centroids[those]).argmin(1)])  # of equals the first
        on = ~one & ~leaf
        first = tree.child[node[on]]
        node, able = np.concatenate([first, first + 1]), np.concatenate([able[on], able[on]])
    return whole, np.concatenate(where), np.concatenate(which)


def _packed(trees: list[Tree], ids: list[pa.Array]) -> pa.RecordBatch:
    raw = [pa.array([np.ascontiguousarray(getattr(t, f)).astype(kind).tobytes() for t in trees], pa.binary()) for f, kind in _FIELDS]
    sizes = pa.array([len(t.begin) for t in trees], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x.to_pylist() for x in ids], pa.list_(pa.int64())), sizes, *raw], ["ids", "nodes", *(f for f, _ in _FIELDS)])


_FIELDS = [("points", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("child", "<i4"), ("depth", "<i2"), ("low", "<i4"), ("high", "<i4"), ("total", "<i8")]
_SCHEMA = "ids array<long>, nodes long, " + ", ".join(f"{f} binary" for f, _ in _FIELDS)


def _grow(batches):
    """One row for each tree of up to TREE vectors."""
    held, rows = [], 0

    def tree(table):
        points = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        made, order = build(points)
        return _packed([made], [table.column("vec_id").combine_chunks().take(pa.array(order))])

    for b in batches:
        while b.num_rows:
            part = b.slice(0, TREE - rows)
            held.append(part)
            rows += part.num_rows
            b = b.slice(part.num_rows)
            if rows == TREE:
                yield tree(pa.Table.from_batches(held))
                held, rows = [], 0
    if held:
        yield tree(pa.Table.from_batches(held))


def _trees(batches, dimensions: int):
    for b in batches:
        for k in range(b.num_rows):
            raw = {f: np.frombuffer(b.column(f)[k].as_buffer(), kind).astype(np.int64) for f, kind in _FIELDS}
            yield b.column("ids")[k].values, Tree(**{f: x.reshape(-1, dimensions) if f in ("points", "low", "high", "total") else x for f, x in raw.items()})


def _sums(centroids: np.ndarray):
    """(cluster, n, s): count and sums of what goes to each centroid, one row each for a partition."""

    def run(batches):
        k, d = centroids.shape
        n, s = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, t in _trees(batches, d):
            whole, where, which = assign(t, centroids)
            for nodes, c in whole:
                n[c] += (t.end[nodes] - t.begin[nodes]).sum()
                s[c] += t.total[nodes].sum(0)
            np.add.at(s, which, t.points[where])
            n += np.bincount(which, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def _labels(centroids: np.ndarray):
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        for ids, t in _trees(batches, centroids.shape[1]):
            whole, where, which = assign(t, centroids)
            cluster = np.zeros(len(t.points), np.int32)
            cluster[where] = which
            for nodes, c in whole:
                for a, b in zip(t.begin[nodes].tolist(), t.end[nodes].tolist(), strict=True):
                    cluster[a:b] = c
            gap = t.points - centroids[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that counts.

    Vectors without exactly ``dimensions`` components, or with a null or non-finite one, or null, are left out.  A component x
    becomes floor(64 x).  The first centroids are the ``k`` vectors whose id has the smallest SHA-256 (of "1:" and the id; a null id
    counts as the empty text), rows with the same id by their components; fewer vectors make fewer clusters.  A centroid
    becomes the floor of its vectors' mean, and stays if it has none; ties go to the smaller number.

    Repeated rows and ids are vectors each.  An empty table gives no rows.  Components whose square distances don't fit 64 bits
    (floor(64 x) beyond 2^27) are an error.  Columns besides id and vector are not looked at.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    x = F.col("x").cast("array<double>")
    usable = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.when(F.abs(c) < LIMIT // SCALE, F.floor(c * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits"))))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where(F.coalesce(usable, F.lit(False))).select("vec_id", scaled.alias("v"))
    grown = own.mapInArrow(trimmed(_grow), _SCHEMA).checkpoint()
    named = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    start = own.orderBy(F.sha2(named, 256), "v").limit(k).collect()
    if not start:
        return own.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        parts = grown.mapInArrow(trimmed(_sums(centroids)), "cluster int, n long, s array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dimensions)))
        for r in total.collect():  # one row a centroid
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dimensions)]
    found = grown.mapInArrow(trimmed(_labels(centroids)), "vec_id long, cluster int, distance long").checkpoint()
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()
    of, whole = {r["cluster"]: r["i"] for r in inertia}, sum(r["i"] for r in inertia)
    digests = [(c, of.get(c, 0), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """``clusters`` of ``embeddings`` by plain SQL: every vector against every centroid in each round."""
    ctes = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS z FROM v QUALIFY c < {k})",
    ]
    near = "list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, min({{'d': {near}, 'c': c}}) AS m FROM (SELECT row_number() OVER () AS rid, * FROM v) CROSS JOIN c{r} GROUP BY rid, vec_id, v) t, LATERAL (SELECT m.d AS d, m.c AS c))")
        if r < rounds:
            sums = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {dimensions + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i"
            ctes.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS z FROM ({sums}) GROUP BY c)")
            ctes.append(f"c{r + 1} AS (SELECT c, coalesce(m{r}.z, c{r}.z) AS z FROM c{r} LEFT JOIN m{r} USING (c))")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )
