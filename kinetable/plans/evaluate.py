"""End to end: cases to answers to scores, with a result cache and a pluggable model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import BENCHMARK_PROMPT, extraction_prompt, is_correct, letter_bounded, letter_last, mcq_benchmark, tag_of
from ..operators.evaluation import cache_misses, merge_cache
from ..operators.splits import size_cap, tail_share
from .config import Evaluation

RESPONSE = "response string, response_time double"


def eval_cases(rows: DataFrame, tag: str | None = "tag") -> DataFrame:
    """question_id, prompt, expected (a letter), tag of published rows."""
    own = F.col(tag) if tag and tag in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("id").alias("question_id"), F.concat(F.lit(BENCHMARK_PROMPT), mcq_benchmark(F.col("question"), F.col("choices"))).alias("prompt"),
        F.chr(F.col("correct_answer") + 65).alias("expected"), tag_of(own, F.col("id")).alias("tag"),
    )


def answers(ask: Callable[[list[str]], list[str | None]], prompts: list[str]) -> list[str | None]:
    """A batch's answers; one that fails is asked by halves, so only the prompts that fail alone get none."""
    try:
        got = list(ask(prompts))
        if len(got) == len(prompts):
            return got
    except Exception:  # whatever the model raises
        pass
    if len(prompts) < 2:
        return [None] * len(prompts)
    half = len(prompts) // 2
    return answers(ask, prompts[:half]) + answers(ask, prompts[half:])


def predict(cases: DataFrame, model: str, answer: Callable[[list[str]], list[str | None]], settings: Evaluation | None = None) -> DataFrame:
    """Answers by an injected batch function, ``batch_size`` prompts at a time; a case that fails gives null and stops nothing."""
    size = max((settings or Evaluation()).batch_size, 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                began = time.time()
                got = answers(answer, part["prompt"].tolist())
                yield part.assign(response=got, response_time=(time.time() - began) / len(part))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema)
    return cases.mapInPandas(run, f"{fields}, {RESPONSE}").withColumn("model", F.lit(model))


def predict_loaded(cases: DataFrame, model: str, load: Callable[[], Callable[[list[str]], list[str | None]]], settings: Evaluation | None = None, prompt: str = "prompt") -> DataFrame:
    """As ``predict``, by a model that each Python worker loads once: ``load`` makes the batch function where it runs and is all that is shipped."""
    size = max((settings or Evaluation()).batch_size, 1)

    def made():
        answer = load()

        def run(prompts: np.ndarray) -> dict[str, np.ndarray]:
            began = time.time()
            got = answers(answer, [str(p) for p in prompts])
            return {"response": np.array(got, object), "response_time": np.full(len(got), (time.time() - began) / max(len(got), 1))}

        return run

    asked = predict_batch_udf(made, return_type=StructType.fromDDL(RESPONSE), batch_size=size)
    told = cases.withColumn("_r", asked(prompt))
    return told.select(*cases.columns, "_r.response", "_r.response_time", F.lit(model).alias("model"))


def settled(answered: DataFrame, load: Callable[[], Callable[[list[str]], list[str | None]]], settings: Evaluation | None = None, question: str = "prompt") -> DataFrame:
    """``answered`` with the letter of each response and the stage that found it, ``first`` or ``second``.

    A response with a letter that stands alone is settled by it.  The others, and they alone, go to a second model with the
    question and the response in one prompt; its answer's letter counts, or what it says if there is none.  A null response has no letter and asks nobody.
    """
    found = answered.withColumn("predicted_letter", letter_bounded(F.col("response")))
    first = found.where("predicted_letter is not null or response is null").withColumn("stage", F.lit("first"))
    asked = found.where("predicted_letter is null and response is not null").withColumn("_extraction", extraction_prompt(F.col(question), F.col("response")))
    keep = answered.columns
    told = predict_loaded(asked.select(*[F.col(c).alias(f"_own_{c}") for c in keep], "_extraction"), "extractor", load, settings, "_extraction")
    second = told.select(*[F.col(f"_own_{c}").alias(c) for c in keep], letter_last(F.col("response")).alias("predicted_letter"), F.lit("second").alias("stage"))
    return first.select(*keep, "predicted_letter", "stage").unionByName(second)


def score(answered: DataFrame) -> DataFrame:
    found = letter_last(F.col("response"))
    return answered.select("question_id", "model", "expected", "tag", F.col("response").alias("predicted"), found.alias("predicted_letter"), is_correct(found, F.col("expected")).alias("correct"), "response_time")


def evaluation_rows(rows: DataFrame, settings: Evaluation | None = None) -> DataFrame:
    """The rows to evaluate on: those of the test split, else the last share by id, and at most max_test_samples by hash."""
    own = settings or Evaluation()
    mine = rows.where("split = 'test'") if "split" in rows.columns else tail_share(rows, "id", own.fallback_percent)
    return size_cap(mine, own.max_test_samples, "id")


def evaluate(cases: DataFrame, model: str, answer, cache: DataFrame | None = None, settings: Evaluation | None = None) -> DataFrame:
    """Scored responses of a model; cached questions are not asked again, unless the settings say so."""
    own = settings or Evaluation()
    mine = cases.withColumn("model", F.lit(model))
    if cache is None or not own.use_cache:
        return score(predict(cases, model, answer, own))
    todo = cache_misses(mine, cache).drop("model")
    return merge_cache(mine.drop("prompt"), cache, score(predict(todo, model, answer, own)))
