"""Sampling, splitting and capping by hash, and position-based cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folders import ensure_checkpoint_dir
from ..functions.hashing import draw, draw01

DEFAULT_TRAIN = 0.9


def threshold(train: Column, test: Column) -> Column:
    """The share of training rows of two targets; 0.8 of none."""
    return F.when(train + test > 0, train / (train + test)).otherwise(F.lit(0.8))


def split_label(key: Column, share: Column, seed: str = "split") -> Column:
    return F.when(draw01(seed, key) < share, "train").otherwise("test")


def _parted(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds the draw _h and its upper 16 bits _b."""
    drawn = rows.withColumn("_h", draw(seed, F.col(key)))
    return drawn.withColumn("_b", F.shiftright("_h", 16))


def _cut(parted: DataFrame, wanted: Column | int) -> tuple[int, int, int]:
    """The bucket of draws in which the ``wanted``-th least lies, how many of its rows are among them, and all rows.

    Counts by bucket, 65,536 at most, are all that leaves the cluster.
    """
    counts = {r["_b"]: r["n"] for r in parted.groupBy("_b").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    left = wanted(total) if callable(wanted) else wanted
    for b in sorted(counts):
        if counts[b] >= left:
            return b, left, total
        left -= counts[b]
    return 1 << 16, 0, total


def size_cap(rows: DataFrame, n: int, key: str, seed: str = "cap") -> DataFrame:
    """The ``n`` rows least by hash, exactly: whole buckets of draws, and a top-k inside the one where they end."""
    parted = _parted(rows, key, seed)
    bucket, left, _ = _cut(parted, n)
    return parted.where(F.col("_b") < bucket).unionByName(parted.where(F.col("_b") == bucket).orderBy("_h", key).limit(left)).drop("_h", "_b")


def tail_share(rows: DataFrame, order: str, percent: int = 20, buckets: int = 256) -> DataFrame:
    """The last ``percent`` of rows by ``order``, a distinct key."""
    dealt = numbered(rows, order, buckets)
    return dealt.where(F.col("_position") > F.col("_total") - F.floor(F.col("_total") * percent / 100)).drop("_position", "_total")


def numbered(rows: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Adds _position, from 1, by ``order``, and _total without gathering rows.

    Rows are dealt by range and written to the checkpoint folder, so that counts and ranks are of the same
    deal; a partition's first position is the count before it, and no task sees all rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(buckets, order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    every = Window.partitionBy()  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(before), "_part").withColumn("_position", F.col("_before") + rank).drop("_part", "_before")


def head(rows: DataFrame, order: str, n: int, buckets: int = 256) -> DataFrame:
    """The first ``n`` rows by ``order``, a distinct key."""
    return numbered(rows, order, buckets).where(F.col("_position") <= n).drop("_position", "_total")


def validation_split(rows: DataFrame, key: str, share: float = 0.05, seed: str = "3407") -> DataFrame:
    """Labels the share least by hash as val, rounded up, the rest as train.

    The cut is the row at that rank, found in the bucket of draws where it lies.
    """
    parted = _parted(rows, key, seed)
    bucket, left, _ = _cut(parted, lambda total: -(-total * round(share * 10_000) // 10_000))
    cut = parted.where(F.col("_b") == bucket).select("_h", F.col(key).alias("_k")).orderBy("_h", "_k").limit(left).agg(F.max(F.struct("_h", "_k")).alias("x")).first()["x"]
    low = F.col("_b") < bucket
    if cut is not None:
        low = low | ((F.col("_b") == bucket) & ((F.col("_h") < cut["_h"]) | ((F.col("_h") == cut["_h"]) & (F.col(key) <= cut["_k"]))))
    return parted.withColumn("split", F.when(low, "val").otherwise("train")).drop("_h", "_b")


def latest(rows: DataFrame, suffix: Column, name: str) -> DataFrame:
    """The row with the greatest number at its name's end, as of checkpoints."""
    return rows.agg(F.max_by(name, suffix).alias(name))
