"""Operators on small frames: the state machine's edge cases, properties and readers."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetable.__main__ import main
from kinetable.functions import geometry, text, vectors
from kinetable.functions.hashing import draw
from kinetable.operators import evaluation, items, phases, raster, sequences, splits
from kinetable.operators import standardize as standards
from kinetable.operators.standardize import BATCHED, PER_STEP, REGISTRY, standardize
from kinetable.plans import catalogue_run, config, dataset_build, evaluate
from kinetable.sources import catalogue, episodes, sinks
from kinetable.streaming.phases import advance, stream_phases

NAN = float("nan")
CASES = {
    "full": ([0, 0.5, 0.95, 0.6, 0.1, 0.1], "pre_grasp immobilization contact detach post_grasp post_grasp"),
    "abort": ([0, 0.5, 0.1], "pre_grasp immobilization pre_grasp"),
    "jump": ([0, 1, 1], "pre_grasp immobilization contact"),
    "again": ([0, 0.5, 0.95, 0.6, 0.95], "pre_grasp immobilization contact detach contact"),
    "closed": ([1, 1, 1], "pre_grasp pre_grasp pre_grasp"),
    "constant": ([0.5, 0.5], "pre_grasp pre_grasp"),
    "cycle": ([0, 0.5, 1, 0.1, 0.1, 0.5], "pre_grasp immobilization contact detach post_grasp immobilization"),
    "single": ([0.3], "pre_grasp"),
    "missing": ([0, 0.5, 0.95, NAN, 0.5, 0.6], "pre_grasp immobilization contact contact contact transition"),
}


def frame(spark, runs):
    """Readings that are normalised already: the range is held to 0..1 by the clamps' neighbours."""
    return spark.createDataFrame([(e, i, float(g)) for e, gs in runs.items() for i, g in enumerate(gs)], "episode_id string, step int, gripper double")


def fold(spark, readings):
    rows = frame(spark, readings).withColumn("g", F.when(~F.isnan("gripper"), F.col("gripper")))
    got = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("step", "g"))).alias("rows"))
    folded = phases._fold(F.col("rows"), F.lit("pre_grasp"), F.col("rows")[0]["g"], phases.GRASP, phases.CONTACT)
    runs = got.select("episode_id", folded["runs"].alias("runs"), F.element_at("rows", -1)["step"].alias("last"))
    return phases.phase_steps(runs.select("episode_id", F.explode(phases._spread(F.col("runs"), F.col("last"))).alias("r")).select("episode_id", "r.*"))


def test_state_machine(spark):
    got = {}
    for r in fold(spark, {k: v[0] for k, v in CASES.items()}).orderBy("step").collect():
        got.setdefault(r["episode_id"], []).append(r["phase"])
    assert {k: " ".join(v) for k, v in got.items()} == {k: v[1] for k, v in CASES.items()}


def test_empty_steps(spark):
    none = spark.createDataFrame([], "episode_id string, step int, gripper double")
    assert phases.phase_runs(none).count() == 0 and phases.phase_runs_blocked(none).count() == 0
    assert sequences.keyframes(phases.phase_runs(none)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.lists(st.floats(0, 1), min_size=1, max_size=40), min_size=1, max_size=4))
def test_blocked_equals_plain(spark, runs):
    s = frame(spark, {str(k): v for k, v in runs.items()})
    a, b = phases.phase_runs(s).collect(), phases.phase_runs_blocked(s, block=5).collect()
    assert sorted(a) == sorted(b)
    by = {}
    for r in sorted(a, key=lambda r: (r["episode_id"], r["start"])):
        assert r["start"] == by.get(r["episode_id"], 0)
        by[r["episode_id"]] = r["end"] + 1
    assert by == {str(k): len(v) for k, v in runs.items()}


def test_advance_agrees(spark):
    for readings, want in CASES.values():
        phase, before, out = "pre_grasp", readings[0], []
        for g in readings:
            phase, before = advance(phase, g, before), g
            out.append(phase)
        assert " ".join(out).replace("transition", "contact") == want.replace("transition", "contact")


def test_streaming(spark, tmp_path):
    frame(spark, {"1": CASES["full"][0]}).select(F.col("episode_id").cast("long").alias("episode_id"), "step", "gripper").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("episode_id long, step int, gripper double").parquet(str(tmp_path / "in"))
    q = stream_phases(source).writeStream.format("memory").queryName("phases").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert " ".join(r["phase"] for r in spark.table("phases").orderBy("step").collect()) == CASES["full"][1]


def test_streaming_over_batches_and_a_restart(spark, tmp_path):
    """State lasts over micro-batches and a new start from the checkpoint; episodes do not mix."""
    runs = {"1": CASES["full"][0], "2": CASES["again"][0]}
    rows = frame(spark, runs).select(F.col("episode_id").cast("long").alias("episode_id"), "step", "gripper")
    schema, got = "episode_id long, step int, gripper double", []

    def start():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_phases(source).writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()

    for k in range(3):
        rows.where(f"step div 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start()
    for e, name in (("1", "full"), ("2", "again")):
        mine = sorted((r["step"], r["phase"]) for r in got if r["episode_id"] == int(e))
        assert " ".join(p for _, p in mine) == CASES[name][1]


def test_key_steps_with_gaps(spark):
    """Keyframes in one pass are those of the separate operators, where steps are missing, too; the next step's columns come along."""
    rows = [("a", s, 0.2 * (s % 7), s * 10) for s in range(40) if s not in (0, 11, 12, 25)] + [("b", 0, 0.5, 1)]
    steps = spark.createDataFrame(rows, "episode_id string, step int, gripper double, mark int")
    runs = phases.phase_runs(steps)
    there = {(r[0], r[1]): r for r in rows}
    want = {(r["episode_id"], r["step"]) for r in sequences.keyframes(runs).collect()} & set(there)
    got = phases.key_steps(steps, also=("mark",)).collect()
    assert {(r["episode_id"], r["step"]) for r in got} == want and len(got) == len(want)
    phase = {(r["episode_id"], r["step"]): r["phase"] for r in phases.phase_steps(runs).collect()}
    for r in got:
        at = (r["episode_id"], r["step"])
        assert (r["phase"], r["mark"], r["next_mark"]) == (phase[at], there[at][3], there.get((at[0], at[1] + 1), [None] * 4)[3])
        assert (r["frames"] is None) == (r["step"] != r["last"])


def test_lengths(spark):
    steps = frame(spark, {"1": [0, 1, 2], "2": [0]})
    told = spark.createDataFrame([("1", 9, "ext1"), ("1", 9, "wrist"), ("2", None, "ext1")], "episode_id string, trajectory_length int, camera string")
    assert {r["episode_id"]: r["length"] for r in sequences.lengths(steps, told).collect()} == {"1": 9, "2": 1}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_letters(spark):
    values = ["The answer is B.", "b", "none", "(C) maybe D", "", None, "x: E/"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = df.select(text.letter_first(F.col("t")).alias("first"), text.letter_last(F.col("t")).alias("last"), text.letter_bounded(F.col("t")).alias("safe")).collect()
    assert [r["first"] for r in got] == ["E", "B", "E", "C", None, None, "E"]
    assert [r["last"] for r in got] == ["B", "B", "none", "D", "", None, "E"]
    assert [r["safe"] for r in got] == ["B", "B", None, "D", None, None, "E"]


def test_text_helpers(spark):
    r = one(
        spark, text.clean_instruction(F.lit("Foo. ")).alias("a"), text.clean_instruction(F.lit(" .Pick, ")).alias("b"), text.raw_folder(F.lit("a/b/c/d/e/f.h5")).alias("c"), text.raw_folder(F.lit("a/f.h5")).alias("d"),
        text.episode_id_of_path(F.lit("x/y/trajectory.h5")).alias("e"), text.episode_id_of_path(F.lit("only")).alias("f"), text.reason_dataset(F.lit("failed (viola): no")).alias("g"), text.model_slug(F.lit("a/b:c")).alias("h"),
        text.model_family(F.lit("Qwen/Qwen2.5-VL")).alias("i"), text.tag_of(F.lit(None).cast("string"), F.lit("droid_1")).alias("j"), text.json_in_text(F.lit('so {"a": 1} ok')).alias("k"),
        text.path_success(F.lit(None).cast("string")).alias("l"),
    )
    assert list(r) == ["foo.", ".pick,", "b/c/d/e", None, "y", "unknown", "viola", "a_b_c", "qwen2_5_vl", "droid", '{"a": 1}', False]


def test_vectors(spark):
    v = F.array(*[F.lit(float(i)) for i in range(8)])
    r = one(spark, vectors.take(v, -3, -2).alias("a"), vectors.take(v, 2, 4).alias("b"), vectors.take(v, -4).alias("c"), vectors.item(v, -1).alias("d"), vectors.item(v, 9).alias("e"), vectors.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("f"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ([5.0], [2.0, 3.0], [4.0, 5.0, 6.0, 7.0], 7.0, None, 5.0)
    s = math.sqrt(0.5)
    e = one(spark, vectors.euler_of_quaternion(F.array(F.lit(0.0), F.lit(0.0), F.lit(s), F.lit(s))).alias("e"))["e"]
    assert e == pytest.approx([0, 0, math.pi / 2])


def test_projection(spark):
    k = F.array(*[F.lit(x) for x in (100.0, 0.0, 50.0, 0.0, 100.0, 40.0, 0.0, 0.0, 1.0)])
    here = F.array(*[F.lit(0.0)] * 6)
    p = lambda *x: geometry.project(F.array(*[F.lit(float(y)) for y in x]), here, k)
    r = one(spark, p(1, 0.5, 2).alias("a"), p(0, 0, -1).alias("b"), geometry.grid(F.lit(5)).alias("c"), geometry.angle_gap(F.lit(0.1), F.lit(6.2)).alias("d"))
    assert tuple(r["a"]) == (100, 65) and tuple(r["b"]) == (-1, -1) and tuple(r["c"]) == (3, 2)
    assert r["d"] == pytest.approx(2 * math.pi - 6.1)


def test_registry(spark):
    assert len(PER_STEP) == 12 and len(REGISTRY) == 58 and len(BATCHED) == 46
    assert set(REGISTRY) == {r["dataset"] for r in catalogue.dataset_config(spark).select("dataset").collect()}
    v = [float(i) / 10 for i in range(16)]
    fields = "action state robot_state gripper_closed robot_obs gripper_states state_gripper world_vector rotation_delta gripper_closedness_action end_effector_cartesian_pos effector_translation tcp_pose xyz_residual axis_angle_residual target_close xyz axis_angle sensed_close end_effector_pose joint_pos eef_pose state_gripper_pose tcp_base position".split()
    df = spark.createDataFrame(
        [("e", i, *[v] * len(fields), 0.5, 1.0, 0.1, 0.2, "do it", [104, 105, 0]) for i in range(7)],
        "episode_id string, step int, " + ", ".join(f"{x} array<double>" for x in fields) + ", gripper double, open_gripper double, gripper_width double, yaw double, natural_language_instruction string, instruction_codes array<int>",
    )
    seen = {name: standardize(df, name).count() for name in REGISTRY}
    assert seen["bridge_dataset"] == 6 and seen["aloha_static_dataset"] == 2 and seen["berkeley_rpt_converted_externally_to_rlds"] == 2 and seen["gnm_dataset"] == 2
    assert all(n == 7 for k, n in seen.items() if k not in ("bridge_dataset", "aloha_static_dataset", "aloha_dagger_dataset", "aloha_mobile_dataset", "berkeley_rpt_converted_externally_to_rlds", "gnm_dataset"))
    hydra = standardize(df, "stanford_hydra_dataset_converted_externally_to_rlds").first()
    assert hydra["action"] == pytest.approx([*v[:6], 1 - v[-1]]) and hydra["proprio"] == pytest.approx([*v[:3], *v[7:10], v[-3]]) and hydra["instruction"] == ""
    assert standardize(df, "language_table").first()["instruction"] == "hi"
    with pytest.raises(KeyError):
        standardize(df, "nothing")


def test_items(spark):
    c = F.array(*[F.lit(x) for x in "abcde"])
    df = spark.range(200).withColumn("s", items.shuffled(c, F.col("id")))
    rows = df.select("id", "s.*").collect()
    assert all(sorted(r["choices"]) == list("abcde") and r["choices"][r["correct"]] == "a" for r in rows)
    assert len({r["correct"] for r in rows}) == 5
    nota = df.select(items.none_of_above(F.col("s.choices"), F.col("s.correct"), F.col("id"), compat=True).alias("n")).select("n.*").collect()
    used = [r for r in nota if items.NONE in r["choices"]]
    assert 15 < len(used) < 70 and all(r["choices"][r["correct"]] == items.NONE for r in used)
    fair = df.select(items.none_of_above(F.col("s.choices"), F.col("s.correct"), F.col("id")).alias("n")).select("n.*").collect()
    assert any(items.NONE in r["choices"] and r["choices"][r["correct"]] != items.NONE for r in fair)
    valid = lambda *x: one(spark, items.is_valid(F.array(*[F.lit(y) for y in x]), F.lit(0)).alias("v"))["v"]
    assert valid("Yes", "No", "x", "y") and valid(*"abcde") and not valid("Yes", "Yes", "x", "y") and not valid("a", "b")


def test_depths(spark):
    pts = [(0.5, 0, 0), (0.51, 1, 0), (0.6, 2, 0), (0.7, 3, 0), (0.8, 4, 0), (0.9, 5, 0), (1.0, 6, 0)]
    df = spark.createDataFrame([(pts,)], "p array<struct<depth:double,x:int,y:int>>")
    assert [p["x"] for p in df.select(items.spaced_depths(F.col("p")).alias("f")).first()["f"]] == [0, 2, 3, 4, 5]


def test_splits(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    labels = splits.validation_split(rows, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in labels} == {"val": 50, "train": 950}
    assert sorted(r["k"] for r in splits.tail_share(rows, "k", 20, 7).collect()) == list(range(800, 1000))
    assert splits.size_cap(rows, 10, "k").count() == 10 and splits.size_cap(rows, 5000, "k").count() == 1000
    none = rows.where("k < 0")
    assert splits.tail_share(none, "k").count() == 0 and splits.validation_split(none, "k").count() == 0


def test_caps(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 1500, "hot").otherwise("viola").alias("dataset"))
    got = catalogue.cap_episodes(rows, F.lit(300), "dataset", ["id"]).groupBy("dataset").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    assert {r["dataset"]: (r["n"], r["m"]) for r in got} == {"hot": (300, 299), "viola": (300, 1799)}


def test_scores(spark):
    rows = [("q1", "a", "A", True), ("q1", "b", None, False), ("q2", "a", None, False), ("q2", "b", None, None)]
    df = spark.createDataFrame(rows, "question_id string, model string, predicted_letter string, correct boolean").withColumns({"tag": F.lit("t"), "response_time": F.lit(1.0)})
    r = evaluation.disagreement(df).first()
    assert (r["total"], r["disagreements"], r["a_better"], r["both_wrong"], r["percent"]) == (2, 1, 1, 0, 50.0)
    assert evaluation.accuracy(df.where("false")).first()["accuracy"] == 0.0
    seeded = evaluation.accuracy_by_tag(df, spark.createDataFrame([("t",), ("u",)], "tag string")).orderBy("tag").collect()
    assert [(x["tag"], x["total"], x["accuracy"]) for x in seeded] == [("t", 4, 25.0), ("u", 0, 0.0)]


def test_dataset_build_and_evaluate(spark, tmp_path):
    for e in range(3):
        folder = tmp_path / "base" / "viola" / f"viola put it_{e}"
        (folder / "images").mkdir(parents=True)
        (folder / "images" / "x.png").write_bytes(b"png")
        choices = [{"text": t, "image_id": None, "is_correct": t == "b"} for t in "abcde"]
        item = {"question": {"text": "q?", "image_ids": ["x"] if e else []}, "choices": choices, "metadata": {"tag": "t1"}}
        (folder / "vqa_data.json").write_text(json.dumps({"vqa_items": [item, item], "metadata": {}}))
    bad = tmp_path / "base" / "viola" / "broken"
    bad.mkdir()
    (bad / "vqa_data.json").write_text("{")
    paths = dataset_build.build(spark, f"file://{tmp_path}/base", f"file://{tmp_path}/out", config.Build(train=6, test=6))
    rows = [r for p in paths.values() for r in spark.read.parquet(p).collect()]
    assert len(rows) == 6 and {r["correct_answer"] for r in rows} == {1} and all(r["id"].startswith("viola_put_it_") for r in rows)
    assert sum(r["image"] is not None for r in rows) == 4
    cases = evaluate.eval_cases(spark.read.parquet(paths["train"]))
    got = evaluate.evaluate(cases, "m", lambda prompts: ["It is (B)." for _ in prompts]).collect()
    assert got and all(r["correct"] and r["tag"] == "viola" for r in got)
    assert all(r["correct"] is False for r in evaluate.evaluate(cases, "m", lambda prompts: 1 / 0).collect())
    cache = spark.createDataFrame([("m", got[0]["question_id"], "A", "A", 0.1, False)], "model string, question_id string, predicted string, predicted_letter string, response_time double, correct boolean")
    merged = evaluate.evaluate(cases, "m", lambda prompts: ["B" for _ in prompts], cache).collect()
    assert sum(r["from_cache"] for r in merged) == 1 and len(merged) == len(got)
    episodes.append_cache(cache, f"file://{tmp_path}/cache")
    assert episodes.read_cache(spark, f"file://{tmp_path}/cache").count() == 1 and episodes.read_cache(spark, f"file://{tmp_path}/absent").count() == 0


def test_temporal_sequence(spark):
    """Any number of phases from three on; four other orders wherever there are four."""
    cases = ["abc", "aab", "aaa", "abca", "aaab", "aaaab", "abcde", "aaaaab", "abcdbcdeabcdbcdea", "ab"]
    shown = spark.createDataFrame([(e, 0, "do it", list(c)) for e, c in enumerate(cases)], "episode_id int, step int, instruction string, phases array<string>")
    got = {r["episode_id"]: r["choices"] for r in items.temporal_sequence(shown).collect()}
    assert sorted(got) == list(range(9))
    for e, choices in got.items():
        orders = math.factorial(len(cases[e])) // math.prod(math.factorial(cases[e].count(x)) for x in set(cases[e]))
        assert choices[0] == " → ".join(cases[e].upper()) and len(choices) == len(set(choices)) == min(5, orders)
        assert all(sorted(c.split(" → ")) == sorted(cases[e].upper()) for c in choices)


def test_temporal_sequence_takes_every_keyframe(spark, small):
    from kinetable import queries

    keys = {r["episode_id"]: r["count"] for r in queries._keys(spark, small).groupBy("episode_id").count().collect()}
    got = {r["episode_id"]: len(r["choices"].split(" | ")[0].split(" → ")) for r in queries.vqa_temporal_sequence(spark, small).collect()}
    assert got == {e: n for e, n in keys.items() if n >= 3}


def test_written_items_are_read_again(spark, tmp_path):
    """Items, pictures and metadata go out as folders and come back; a picture beyond the longest side is made smaller."""
    rng = np.random.default_rng(1)
    picture = lambda h, w: raster.png(rng.integers(0, 256, (h, w, 3), dtype=np.uint8))
    schema = "dataset string, episode_id long, step int, rank int, tag string, question string, choices array<string>, correct_answer int, image_ids array<string>"
    rows = [("viola", e, k, 1, "t", f"q{e}{k}", list("abcde"), k, [f"i{e}"]) for e in (1, 2) for k in (3, 1)]
    images = spark.createDataFrame([("viola", 1, "i1", bytearray(picture(6, 9))), ("viola", 2, "i2", bytearray(picture(20, 40))), ("viola", 2, "i2", bytearray(picture(20, 40)))], "dataset string, episode_id long, image_id string, png binary")
    told = spark.createDataFrame([("viola", 1, "do it"), ("viola", 2, "do that")], "dataset string, episode_id long, language_instruction string")
    base = f"file://{tmp_path}/base"
    done = sinks.write_items(spark.createDataFrame(rows, schema), images, told, base).orderBy("episode_id").collect()
    assert [(r["episode_id"], r["items"], r["images"]) for r in done] == [("1", 2, 1), ("2", 2, 1)]
    assert json.loads((tmp_path / "base/viola/1/metadata.json").read_text()) == {"language_instruction": "do it", "episode_id": "1", "dataset": "viola"}
    back = episodes.read_items(spark, base).orderBy("id").collect()
    assert [(r["id"], r["question"], r["correct_answer"]) for r in back] == [("1_q1", "q11", 1), ("1_q2", "q13", 3), ("2_q1", "q21", 1), ("2_q2", "q23", 3)]
    paths = dataset_build.build(spark, base, f"file://{tmp_path}/out", config.Build(train=50, test=50, longest=16))
    got = {r["id"]: r["image"] for p in paths.values() for r in spark.read.parquet(p).collect()}
    size = lambda b: (int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big"))
    assert len(got) == 4 and size(got["1_q1"]["bytes"]) == (9, 6) and size(got["2_q1"]["bytes"]) == (16, 8)


def test_command_line(spark, tmp_path):
    rows = [(f"q{k}", m, "A", "A" if k % 2 else "B", bool(k % 2), "t", 0.5) for k in range(4) for m in ("x/1", "y")]
    spark.createDataFrame(rows, "question_id string, model string, expected string, predicted_letter string, correct boolean, tag string, response_time double").write.parquet(f"file://{tmp_path}/r")
    main(["score", "--responses", f"file://{tmp_path}/r", "--out", f"file://{tmp_path}/o"])
    summaries = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/o/summaries").collect()]
    assert {s["model"]: s["accuracy"] for s in summaries} == {"x/1": 50.0, "y": 50.0}
    assert spark.read.json(f"file://{tmp_path}/o/responses").count() == 8 and spark.read.json(f"file://{tmp_path}/o/comparison/pairs").first()["total"] == 4


def test_catalogue_steps(spark, tmp_path):
    rows = [(f"e{e}", s, ["Pick it.", "", None][e % 3] if s == 0 else "later", [float(s)]) for e in range(6) for s in range(3)]
    df = spark.createDataFrame(rows, "episode_id string, step int, language_instruction string, action array<double>")
    for name in ("droid", "viola"):
        df.write.parquet(f"file://{tmp_path}/{name}")
    got = catalogue.catalogue_steps(spark, f"file://{tmp_path}", ("droid", "viola", "absent"), episodes=4).select("dataset", "episode_id", "instruction", "step").collect()
    count = lambda d: sorted({(r["episode_id"], r["instruction"]) for r in got if r["dataset"] == d})
    assert count("droid") == [("e0", "pick it"), ("e3", "pick it")] and len(count("viola")) == 4 and len(got) == 18
    assert catalogue.catalogue_steps(spark, f"file://{tmp_path}", ("absent",)).count() == 0
    assert set(standards.standardize_all({"viola": df.withColumn("gripper_states", F.col("action")), "unheard_of": df})) == {"viola"}
    emptied = standardize(df.withColumns({"natural_language_instruction": F.lit("x"), "natural_language_embedding": F.lit(1), "state": F.col("action")}), "dobbe")
    assert {(r["instruction"], r["natural_language_instruction"]) for r in emptied.collect()} == {("x", None)}


def test_descriptions(spark):
    text_of = ['Sure: {"task": "pick", "location": null} ok', "A lab. They GRASP and push it", "{broken", None, ""]
    got = [r["d"].asDict() for r in spark.createDataFrame([(i, t) for i, t in enumerate(text_of)], "i int, t string").orderBy("i").select(text.description(F.col("t")).alias("d")).collect()]
    assert [tuple(g.values()) for g in got] == [("", "pick", "", ""), ("lab", "push", "", ""), ("", "", "", ""), ("", "", "", ""), ("", "", "", "")]
    r = one(spark, text.nouns(F.lit("Put the red cup on the tray, the red!")).alias("n"), text.places(F.lit("move a cup from the shelf into a box")).alias("p"), text.nouns(F.lit("go home")).alias("h"))
    assert (r["n"], r["p"], r["h"]) == (["red", "tray"], ["shelf", "box"], ["home"])


def test_a_failing_prompt_stops_no_other():
    def ask(prompts):
        if "bad" in prompts:
            raise ValueError
        return [p.upper() for p in prompts]

    assert evaluate.answers(ask, ["a", "bad", "c", "d", "e"]) == ["A", None, "C", "D", "E"] and evaluate.answers(ask, []) == []


def test_hash_cuts_are_exact(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    ranked = [r["k"] for r in rows.orderBy(draw("cap", F.col("k")), "k").collect()]
    for n in (0, 1, 77, 2999, 9000):
        assert sorted(r["k"] for r in splits.size_cap(rows, n, "k").collect()) == sorted(ranked[:n])
    assert sorted(r["k"] for r in splits.head(rows, "k", 12, 5).collect()) == list(range(12))


def test_generate_from_exports(spark, tmp_path):
    """Exported steps become item folders, which the data set build reads; data sets without a plan or an export give nothing."""
    rows = [(f"e{e}", s, "Pick the cup." if s == 0 else "x", [CASES["full"][0][s] * 1.0]) for e in range(2) for s in range(6)]
    df = spark.createDataFrame(rows, "episode_id string, step int, language_instruction string, gripper_states array<double>")
    df.write.parquet(f"file://{tmp_path}/in/viola")
    df.write.parquet(f"file://{tmp_path}/in/unheard_of")
    frames = spark.createDataFrame([("viola", f"e{e}", s, f"p{s}", bytearray(raster.png(np.full((4, 5, 3), s, np.uint8)))) for e in range(2) for s in range(6)], catalogue_run.FRAMES)
    frames.write.parquet(f"file://{tmp_path}/frames")
    (tmp_path / "c.json").write_text(json.dumps({"generation": {"datasets": ["viola", "unheard_of", "kuka"]}, "build": {"train": 90, "test": 10}}))
    main(["generate", "--folder", f"file://{tmp_path}/in", "--out", f"file://{tmp_path}/out", "--frames", f"file://{tmp_path}/frames", "--config", str(tmp_path / "c.json")])
    written = spark.read.parquet(f"file://{tmp_path}/out/_written").orderBy("episode_id").collect()
    assert [(r["dataset"], r["episode_id"]) for r in written] == [("viola", "e0"), ("viola", "e1")] and all(r["items"] > 10 and r["images"] > 1 for r in written)
    items_ = episodes.read_items(spark, f"file://{tmp_path}/out").collect()
    assert len(items_) == sum(r["items"] for r in written) and all(r["image_path"].endswith(".png") for r in items_)
    assert {r["tag"] for r in items_} >= {"vqa_robot_gripper_open", "vqa_task_success_state", "vqa_goal_configuration"}
    main(["build", "--base", f"file://{tmp_path}/out", "--out", f"file://{tmp_path}/set", "--config", str(tmp_path / "c.json")])
    built = [r for name in ("train", "test") for r in spark.read.parquet(f"file://{tmp_path}/set/{name}").collect()]
    assert len(built) <= len(items_) and all(r["image"]["bytes"] for r in built)
    assert catalogue_run.generate(spark, f"file://{tmp_path}/nothing", f"file://{tmp_path}/o").count() == 0


def test_a_text_is_searched_once_an_episode(spark):
    """The noun comes with the episode, made before keyframes are joined to it, and is the one of a search for each keyframe."""
    from kinetable.functions.text import first_noun
    from kinetable.plans import generation

    told = [(1, "move the red cup", "a/success"), (2, None, "b"), (3, "...", "c")]
    steps = spark.createDataFrame([(e, k, k % 7 / 6) for e, _, _ in told for k in range(40)], "episode_id long, step int, gripper double")
    keys = generation.keyed_steps(steps, spark.createDataFrame(told, "episode_id long, instruction string, path string"))
    assert items.NOUN in keys.columns
    rows = keys.select(F.col(items.NOUN).eqNullSafe(first_noun(F.col("instruction")))).collect()
    assert len(rows) > 6 and all(r[0] for r in rows)
    plan = keys.select("step", items.NOUN)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Generate explode" in x and "regexp_extract" in x for x in plan.splitlines())


def test_directions_are_asked_with_the_episodes_own_texts(spark, small, tmp_path):
    """A raw episode's document is its instruction, also where events have no such episode; without a text there is the stock one."""
    import duckdb
    from kinetable.queries import ORACLE_SQL, QUERIES

    cut = F.when(F.col("doc_id") == 4, None).when(F.col("doc_id") == 40, "").otherwise(F.col("text"))
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id not in (3, 33)").withColumn("text", cut)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("embeddings", "events"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.where("text is not null").selectExpr("doc_id", "lower(text) as text").collect()}
    rows = QUERIES["vqa_action_direction"](spark, str(tmp_path)).collect()
    asked = {r["episode_id"]: r["question"] for r in rows}
    assert {3, 4, 33, 40} < set(asked) and len(asked) == 50
    for episode, question in asked.items():
        assert question == f"The robot task is to {texts.get(episode, 'move the arm')}. Which colored arrow correctly shows the direction the robot will move next?"
    c = duckdb.connect()
    for name in ("documents", "embeddings", "events"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ("episode_id", "step", "question", "choices")
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['vqa_action_direction']})").fetchall()
    assert sorted(tuple(r[x] for x in columns) for r in rows) == sorted(want)
