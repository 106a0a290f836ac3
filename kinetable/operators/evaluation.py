"""Scoring of answers: accuracy, tags, models, disagreement, caches and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(hits: Column, total: Column) -> Column:
    """Percent, 0 of nothing."""
    return F.when(total > 0, hits / total * 100).otherwise(F.lit(0.0))


def _hits(column: str = "correct") -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(False)).cast("long"))


def accuracy(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count("*").alias("total"), F.coalesce(_hits(), F.lit(0)).alias("hits")).select("total", "hits", share(F.col("hits"), F.col("total")).alias("accuracy"))


def accuracy_by_tag(responses: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """A row for each tag; with ``tags``, those without responses count zero."""
    got = responses.groupBy("tag").agg(F.count("*").alias("total"), _hits().alias("hits"), F.avg("response_time").alias("mean_time"))
    if tags is not None:
        got = tags.select("tag").distinct().join(got, "tag", "left").fillna({"total": 0, "hits": 0})
    return got.select("tag", "total", "hits", share(F.col("hits"), F.col("total")).alias("accuracy"), "mean_time")


def model_summary(responses: DataFrame) -> DataFrame:
    return responses.groupBy("model").agg(F.count("*").alias("total"), _hits().alias("hits"), F.avg("response_time").alias("mean_time")).withColumn("accuracy", share(F.col("hits"), F.col("total")))


def tag_model_pivot(responses: DataFrame, models: list[str]) -> DataFrame:
    """Accuracy of each tag by model, 0 where a model has no response; the models are named, so no extra pass finds them."""
    return responses.groupBy("tag").pivot("model", models).agg(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")) * 100).fillna(0.0, models)


def disagreement(responses: DataFrame) -> DataFrame:
    """For each pair of models, over the questions both answered: how often letters differ (null-safely) and who is right then.

    Equal answers are counted first, so a question has a few rows; these are joined with themselves on the
    question, both sides of one exchange.  Of several responses of a model to a question each counts.
    """
    base = responses.groupBy("question_id", "model", "predicted_letter", F.coalesce("correct", F.lit(False)).alias("correct")).agg(F.count("*").alias("n"))
    a, b = (base.select("question_id", *[F.col(c).alias(f"{c}_{side}") for c in ("model", "predicted_letter", "correct", "n")]) for side in "ab")
    both = a.join(b, "question_id").where("model_a < model_b")
    differ, hit_a, hit_b = ~F.col("predicted_letter_a").eqNullSafe(F.col("predicted_letter_b")), F.col("correct_a"), F.col("correct_b")
    of = lambda when: F.coalesce(F.sum(F.when(when, F.col("n_a") * F.col("n_b"))), F.lit(0)).cast("long")
    return (
        both.groupBy("model_a", "model_b")
        .agg(
            of(F.lit(True)).alias("total"), of(differ).alias("disagreements"), of(differ & hit_a & ~hit_b).alias("a_better"),
            of(differ & hit_b & ~hit_a).alias("b_better"), of(differ & ~hit_a & ~hit_b).alias("both_wrong"),
        )
        .withColumn("percent", share(F.col("disagreements"), F.col("total")))
    )


def disagreement_by_position(responses: DataFrame, order: str = "position") -> DataFrame:
    """As ``disagreement``, but answers are paired by their place in each model's list and the longer list is cut, whatever the questions are.

    For comparison with results that were made so; ``disagreement`` is the one to use.  The percentage is of the first model's whole list.
    Places are told within a model, so ``order`` should tell them apart; ties go by question.
    """
    place = F.row_number().over(Window.partitionBy("model").orderBy(order, "question_id"))
    base = responses.select("model", "predicted_letter", F.coalesce("correct", F.lit(False)).alias("correct"), place.alias("place"))
    a, b = (base.select("place", *[F.col(c).alias(f"{c}_{side}") for c in ("model", "predicted_letter", "correct")]) for side in "ab")
    differ, hit_a, hit_b = ~F.col("predicted_letter_a").eqNullSafe(F.col("predicted_letter_b")), F.col("correct_a"), F.col("correct_b")
    of = lambda when: F.count_if(when)
    pairs = (
        a.join(b, "place").where("model_a < model_b").groupBy("model_a", "model_b")
        .agg(F.count("*").alias("total"), of(differ).alias("disagreements"), of(differ & hit_a & ~hit_b).alias("a_better"), of(differ & hit_b & ~hit_a).alias("b_better"), of(differ & ~hit_a & ~hit_b).alias("both_wrong"))
    )
    sizes = responses.groupBy(F.col("model").alias("model_a")).agg(F.count("*").alias("size"))
    return pairs.join(F.broadcast(sizes), "model_a").select("model_a", "model_b", "total", "disagreements", "a_better", "b_better", "both_wrong", share(F.col("disagreements"), F.col("size")).alias("percent"))


def cache_misses(cases: DataFrame, cache: DataFrame) -> DataFrame:
    """(model, question) cases that still have to be answered."""
    return cases.join(cache.select("model", "question_id").distinct(), ["model", "question_id"], "left_anti")


def merge_cache(cases: DataFrame, cache: DataFrame, answered: DataFrame) -> DataFrame:
    """Cached and new responses together, marked by where they came from."""
    held = cases.join(cache, ["model", "question_id"]).withColumn("from_cache", F.lit(True))
    return held.unionByName(answered.withColumn("from_cache", F.lit(False)), allowMissingColumns=True)


def success_summary(status: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Episodes, successes and rate of each dataset, and of all under a null name."""
    won = F.coalesce(F.col("success"), F.lit(False))
    return status.rollup(dataset).agg(F.count("*").alias("total"), F.count_if(won).alias("succeeded"), F.count_if(~won).alias("failed")).withColumn("rate", share(F.col("succeeded"), F.col("total")))


def failures(status: DataFrame) -> DataFrame:
    """The episodes that did not succeed, as rows: their number has no bound that a summary could hold."""
    return status.where(~F.coalesce(F.col("success"), F.lit(False)))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Each value's percent of all rows, in one lazy plan."""
    total = rows.select(F.count("*")).scalar()
    return rows.groupBy(column).agg(F.count("*").alias("n")).withColumn("percent", F.col("n") / total * 100)


def results_json(responses: DataFrame) -> DataFrame:
    """One JSON object a model: accuracy, and accuracy by tag, in percent to six places; responses are rows of their own."""
    tags = responses.groupBy("model", "tag").agg(F.count("*").alias("total"), _hits().alias("hits"))
    entry = F.struct("tag", F.struct("total", "hits", F.round(share(F.col("hits"), F.col("total")), 6).alias("accuracy")).alias("result"))
    by = tags.groupBy("model").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tags"))
    return by.select("model", F.to_json(F.struct("model", "total", "hits", F.round(share(F.col("hits"), F.col("total")), 6).alias("accuracy"), "tags")).alias("result"))
