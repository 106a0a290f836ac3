"""Models loaded by workers, the second stage, and the keyed cache."""

import os

import pytest

from kinetable.plans import evaluate
from kinetable.plans.config import Evaluation
from kinetable.sources import cache_table


def loader(folder):
    """A model that notes each load and each prompt in files."""

    def load():
        with open(f"{folder}/loads-{os.getpid()}", "a") as f:
            f.write("x")

        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("a prompt that the model can't take")
            with open(f"{folder}/prompts-{os.getpid()}", "a") as f:
                f.writelines(p.replace("\n", "|") + "\n" for p in prompts)
            return ["  C." if "unclear" in p else "none here" if "hopeless" in p else f"said {len(p)}" for p in prompts]

        return answer

    return load


def noted(folder, kind):
    return {f: open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith(kind)}


def test_a_worker_loads_its_model_once(spark, tmp_path):
    cases = spark.range(0, 60, 1, 6).selectExpr("id as question_id", "if(id = 7, 'bad one', concat('prompt ', id)) as prompt")
    got = evaluate.predict_loaded(cases, "m", loader(tmp_path), Evaluation(batch_size=4)).collect()
    assert len(got) == 60 and {r["model"] for r in got} == {"m"}
    assert all((r["response"] is None) == (r["question_id"] == 7) and (r["response_time"] >= 0) for r in got)
    assert all(r["response"] == f"said {len(r['prompt'])}" for r in got if r["question_id"] != 7)
    loads = noted(tmp_path, "loads")
    assert 1 <= len(loads) <= 6 and set(loads.values()) == {"x"}


def test_only_open_answers_reach_the_second_stage(spark, tmp_path):
    rows = [(1, "q1", "The answer is B."), (2, "q2", "unclear words"), (3, "q3", None), (4, "q4", "hopeless"), (5, "q5", "A or maybe D"), (6, "q6", "")]
    got = {r["question_id"]: r for r in evaluate.settled(spark.createDataFrame(rows, "question_id int, prompt string, response string"), loader(tmp_path)).collect()}
    assert {k: (r["predicted_letter"], r["stage"]) for k, r in got.items()} == {1: ("B", "first"), 5: ("D", "first"), 3: (None, "first"), 2: ("C", "second"), 4: ("none here", "second"), 6: (got[6]["predicted_letter"], "second")}
    assert got[2]["response"] == "unclear words" and got[2]["prompt"] == "q2"
    asked = "".join(noted(tmp_path, "prompts").values()).splitlines()
    assert sorted(a.split("||")[-3] for a in asked) == ["q2", "q4", "q6"]


@pytest.fixture
def cache(spark, tmp_path):
    cache_table.create(spark, "answers", f"file://{tmp_path}/answers", 4)
    yield "answers"
    spark.sql("DROP TABLE answers")
    spark.sql("DROP TABLE IF EXISTS asked")


def test_last_write_wins(spark, cache):
    rows = lambda *x: spark.createDataFrame([(m, q, p, p, t, True) for m, q, p, t in x], "model string, question_id string, predicted string, predicted_letter string, response_time double, correct boolean")
    cache_table.store(rows(("a/1", "q1", "A", 1.0), ("a/1", "q2", "B", 1.0), ("b", "q1", "C", 1.0)), cache, 4)
    cache_table.store(rows(("a/1", "q1", "D", 1.0), ("a/1", "q3", "E", 1.0), ("a/1", "q3", "A", 2.0), ("a/1", "q3", "A", 2.0)), cache, 4)
    held = lambda: sorted((r["model"], r["question_id"], r["predicted"]) for r in spark.table(cache).collect())
    assert held() == [("a/1", "q1", "D"), ("a/1", "q2", "B"), ("a/1", "q3", "A"), ("b", "q1", "C")]
    cache_table.store(rows(), cache, 4)
    assert len(held()) == 4 and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    cases = spark.createDataFrame([("a/1", "q1"), ("a/1", "q9"), ("b", "q2"), ("c", "q1"), (None, "q1")], "model string, question_id string")
    assert sorted(map(tuple, cache_table.misses(cases, cache).collect()), key=repr) == sorted([("a/1", "q9"), ("b", "q2"), ("c", "q1"), (None, "q1")], key=repr)


def test_misses_of_bucketed_cases_move_nothing(spark, cache, tmp_path):
    """Cases in the same buckets are held against the cache without an exchange, larger than any broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = spark.range(500).selectExpr("concat('m', id % 2) as model", "cast(id as string) as question_id", "'x' as predicted", "'A' as predicted_letter", "1.0 as response_time", "true as correct")
        cache_table.store(filled, cache, 4)
        cache_table.bucketed(spark.range(700).selectExpr("concat('m', id % 2) as model", "cast(id as string) as question_id"), "asked", f"file://{tmp_path}/asked", 4)
        open_ = cache_table.misses(spark.table("asked"), cache)
        assert open_.count() == 200
        plan = open_._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
