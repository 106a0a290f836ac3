"""Readings joined with the intervals that hold them, by equality of buckets and an exact test.

An interval belongs to the level whose buckets are as long as it is or longer, but less than twice as long, so it
touches two of them at most; a reading is looked up once at each level that occurs, some tens at most.  So neither a long interval
nor a short one makes more than two rows, and the join is an equi-join on key, level and bucket that Spark shuffles or
broadcasts as it sees fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_intervals(readings: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Each reading with each interval of the same ``keys`` with ``begin <= at <= end``; all columns of both, keys once.

    ``at``, ``begin`` and ``end`` are whole numbers (steps, microseconds).  Nulls in keys or bounds, and intervals that end before
    they begin, match nothing.  Columns of both sides must have different names.
    """
    lo, hi, x = (F.col(c).cast("long") for c in (begin, end, at))
    sized = intervals.where(lo <= hi).withColumn("_size", F.greatest(hi - lo, F.lit(1))).withColumn("_level", F.ceil(F.log2(F.col("_size").cast("double"))).cast("int"))
    sized = sized.withColumn("_level", F.expr("if(shiftleft(1L, _level) < _size, _level + 1, _level)")).drop("_size")  # the logarithm is rounded
    first, last = (F.expr(f"shiftright(cast(`{c}` as bigint), _level)") for c in (begin, end))
    cut = sized.withColumn("_bucket", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    levels = sized.agg(F.sort_array(F.collect_set("_level")).alias("l")).first()["l"]
    spread = readings.where(x.isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spread = spread.withColumn("_bucket", F.expr(f"shiftright(cast(`{at}` as bigint), _level)"))
    return spread.join(cut, [*keys, "_level", "_bucket"]).where((lo <= x) & (x <= hi)).drop("_level", "_bucket")
