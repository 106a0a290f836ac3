"""Connected components of an edge table, and the shared checkpoint folder they need."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges, of 16 bytes, that one task joins by itself.
TASK_EDGES = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component's id is its smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014): each is two shuffles of the edges, hot
    nodes are pre-aggregated by the partial minimum, and the number of rounds is logarithmic in
    practice.  A node's edges are joined with its minimum as 16 bytes each; a node with so many that they
    outgrow a task is a skewed join, which adaptive execution splits, as nothing after it needs its layout.
    Each round is cut off by a checkpoint in the shared folder.  Once no more than TASK_EDGES edges are left,
    counted, one task follows them to the end.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark[0] <= TASK_EDGES:
            return e.repartition(1).mapInArrow(_followed, "node long, component long")
        if mark == seen:
            break
        seen = mark
        e = _small_star(_large_star(e)).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _followed(batches):
    """(node, component) of edges (u, v) that all come to one task: roots are tied to lesser roots until no edge joins two."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not pairs:
        return
    u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
