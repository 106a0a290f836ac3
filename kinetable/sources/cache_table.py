"""The result cache as a keyed table: a folder for each model, bucketed and sorted by (model, question_id).

Cases that lie in buckets the same way are held against it without an exchange, others move alone.  A later answer replaces an earlier one: a
run rewrites the folders of its own models, the answers that it doesn't repeat included, in one overwrite that shows when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import model_slug

KEY = ["model", "question_id"]
COLUMNS = ["model", "question_id", "predicted", "predicted_letter", "response_time", "correct"]
BUCKETS = 64


def bucketed(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS, by_model: bool = False) -> None:
    """A new table of ``rows`` in ``buckets`` sorted buckets of the key, dealt so that each has one file."""
    dealt = rows.repartition(buckets, *KEY)
    writer = dealt.write.format("parquet").option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY)
    (writer.partitionBy("slug") if by_model else writer).saveAsTable(name)


def create(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """An empty cache."""
    schema = "model string, question_id string, predicted string, predicted_letter string, response_time double, correct boolean, slug string"
    bucketed(spark.createDataFrame([], schema), name, path, buckets, by_model=True)


def latest(rows: DataFrame, order: str) -> DataFrame:
    """Of several answers to a question the one that is last by ``order``; ties by the answer."""
    last = Window.partitionBy(*KEY).orderBy(F.col(order).desc_nulls_last(), F.desc_nulls_last("predicted"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def store(rows: DataFrame, name: str, buckets: int = BUCKETS, order: str = "response_time") -> None:
    """Adds answers; of a key that is there the new one stays.  Other models' folders aren't touched."""
    spark = rows.sparkSession
    new = latest(rows, order).select(*COLUMNS, model_slug(F.col("model")).alias("slug"))
    mine = new.select("slug").distinct()
    kept = spark.table(name).join(F.broadcast(mine), "slug", "left_semi").join(new.select(*KEY), KEY, "left_anti")
    whole = new.unionByName(kept.select(*new.columns)).repartition(buckets, *KEY).sortWithinPartitions("slug", *KEY)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        whole.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def misses(cases: DataFrame, name: str) -> DataFrame:
    """The cases that have no answer yet."""
    return cases.join(cases.sparkSession.table(name).select(*KEY), KEY, "left_anti")
