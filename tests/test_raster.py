"""Pictures, drawn items and settings."""

import json

import numpy as np
from pyspark.sql import functions as F

from kinetable.operators import items, raster
from kinetable.plans import config, training, visualise
from kinetable.sources.episodes import read_images


def test_sheets():
    a, b = np.full((4, 6, 3), 10, np.uint8), np.full((2, 2, 3), 200, np.uint8)
    assert raster.stitch([a, b]).shape == (4, 12, 3) and raster.stitch([a, b, a]).shape == (8, 12, 3)
    assert (raster.stitch([a, b])[1:3, 8:10] == 200).all()
    assert raster.goal_sheet([a, b, a, b, a]).shape == (8, 18, 3) and raster.strip([a, a, b]).shape == (4, 18, 3)
    assert (raster.resize(a, 9, 3) == 10).all()
    assert raster.disc(a, 0, 0, 1, (1, 2, 3))[0, 0].tolist() == [1, 2, 3] and (raster.arrow(a, (0, 0), (5, 3), (9, 9, 9)) == 9).any()


def test_frames(spark, tmp_path):
    rows = [("e", 0, "wrist", 2, 2, 3, bytearray(range(12))), ("e", 0, "ext", 1, 2, 4, bytearray([7] * 8)), ("e", 1, "ext", 1, 1, 1, bytearray([5])), ("e", 2, "ext", 1, 1, 1, None)]
    frames = spark.createDataFrame(rows, "episode_id string, step int, camera string, height int, width int, channels int, data binary")
    got = {r["step"]: r for r in raster.stitch_frames(frames).collect()}
    assert set(got) == {0, 1} and (got[0]["cameras"], got[0]["height"], got[0]["width"]) == (2, 2, 4)
    made = raster.encode_frames(frames.where("camera = 'wrist'")).first()
    (tmp_path / "x.png").write_bytes(made["png"])
    back = read_images(spark, f"file://{tmp_path}/x.png").first()
    assert bytes(back["data"]) == bytes(range(12)) and len(made["image_id"]) == 64
    keys = spark.createDataFrame([("e", 1)], "episode_id string, step int")
    assert raster.key_frames(frames, keys).count() == 1
    pts = spark.createDataFrame([("e", i, u, 1) for i, u in enumerate([-1, 3, 4, -1, 6])], "episode_id string, step int, u long, v long")
    seg = raster.path_segments(pts.withColumn("p", F.struct("u", "v")), F.col("p")).orderBy("step").collect()
    assert [(r["from_u"], r["to_u"], r["is_first"], r["is_last"]) for r in seg] == [(None, 3, True, False), (3, 4, False, False), (None, 6, False, True)]


def test_drawn_items(spark):
    keys = spark.range(40).select(
        F.col("id").alias("episode_id"), F.lit(3).alias("step"), F.lit("ext1").alias("camera"), F.lit("ext1").alias("camera1"), F.lit("ext2").alias("camera2"), F.lit("pick it").alias("instruction"),
        F.expr("named_struct('u', id * 30, 'v', id * 17)").alias("right"), F.expr("array(named_struct('depth', 0.5D, 'x', 1, 'y', 1), named_struct('depth', 0.4D, 'x', 1, 'y', 1), named_struct('depth', 0.9D, 'x', 1, 'y', 1), named_struct('depth', 0.7D, 'x', 1, 'y', 1), named_struct('depth', 0.6D, 'x', 1, 'y', 1))").alias("five"),
    )
    keys = keys.withColumn("wrong", items.quadrant_points(F.col("episode_id"), F.col("right"), F.lit(1280), F.lit(720)))
    for r in keys.collect():
        pts = [(p["u"], p["v"]) for p in r["wrong"]]
        assert len(pts) == 4 and all(0 <= u < 1280 and 0 <= v < 720 for u, v in pts)
        assert len({(u >= 640, v >= 360) for u, v in pts[:3]} - {(r["right"]["u"] >= 640, r["right"]["v"] >= 360)}) == 3
    depth = items.relative_depth(keys).collect()
    assert {r["choices"][0] for r in depth} == {"Green", "Blue"} and all("CLOSEST" in r["question"] for r in depth if r["choices"][0] == "Green")
    assert {r["choices"][0] for r in items.action_direction(keys, compat=True).collect()} == {"Red"}
    assert len({r["choices"][0] for r in items.action_direction(keys).collect()}) == 5
    letters = items.correspondence(keys)
    assert len({r["choices"][0] for r in letters.collect()}) == 5 and items.finalize(letters).count() == 40
    m = spark.range(1).select(items.enriched(F.expr("map('tag', 't')"), F.expr("map('scene', 'lab', 'task', '')")).alias("m")).first()["m"]
    assert m == {"tag": "t", "vlm_scene": "lab"}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"build": {"train": 5, "odd": 1}, "evaluation": {"models": ["a"]}, "other": {}}))
    c = config.load(str(tmp_path / "c.json"))
    assert (c.build.train, c.build.test, c.evaluation.models, c.training.random_state) == (5, 10_000, ("a",), 3407)


K = [100.0, 0.0, 16.0, 0.0, 100.0, 12.0, 0.0, 0.0, 1.0]


def scene(spark):
    steps = [(1, s, [0.02 * s - 0.05, 0.0, 0.0], [0.0, 0.05, 0.0] if s == 0 else None) for s in range(4)] + [(2, 0, [9.0, 9.0, 0.0], None)]
    steps = spark.createDataFrame(steps, "episode_id long, step int, pose array<double>, target array<double>")
    cameras = spark.createDataFrame([(e, "ext1", [0.0, 0.0, -1.0, 0.0, 0.0, 0.0], K) for e in (1, 2)], "episode_id long, camera string, extrinsics array<double>, intrinsics array<double>")
    blank = bytearray(24 * 32 * 3)
    frames = spark.createDataFrame([(e, s, "ext1", 24, 32, 3, blank) for e, s in ((1, 0), (1, 3), (2, 0))] + [(1, 1, "ext1", 24, 32, 3, None)], "episode_id long, step int, camera string, height int, width int, channels int, data binary")
    return steps, cameras, frames


def test_motion_is_drawn(spark):
    steps, cameras, frames = scene(spark)
    marks = {(r["episode_id"], r["step"]): tuple(map(tuple, (r["current"], r["target"], r["future"]))) for r in visualise.action_marks(steps, cameras, ahead=2).collect()}
    assert marks[1, 0] == ((11, 12), (16, 17), (15, 12)) and marks[1, 3] == ((17, 12), (17, 12), (17, 12)) and marks[2, 0][0] == (916, 912)
    got = {(r["episode_id"], r["step"]): r for r in visualise.draw_actions(frames, visualise.action_marks(steps, cameras, ahead=2)).collect()}
    assert set(got) == {(1, 0), (1, 3), (2, 0)} and got[1, 0]["status"] == "drawn"
    a = np.frombuffer(got[1, 0]["data"], np.uint8).reshape(24, 32, 3)
    assert a[12, 11].tolist() == [255, 255, 255] and a[21, 16].tolist() == [0, 0, 255] and not np.frombuffer(got[2, 0]["data"], np.uint8).any()
    path = {(r["episode_id"], r["step"]): r for r in visualise.draw_trajectories(frames.where("step = 0"), steps.drop("target"), cameras).collect()}
    b = np.frombuffer(path[1, 0]["data"], np.uint8).reshape(24, 32, 3)
    assert b[12, 8].tolist() == [255, 0, 0] and b[12, 20].tolist() == [0, 0, 255]  # discs about the first and the last point
    phases = spark.createDataFrame([(1, 0, "contact")], "episode_id long, step int, phase string")
    names = {(r["episode_id"], r["step"]): r["name"] for r in visualise.frame_names(frames, phases).collect()}
    assert names[1, 0] == "step_0000_ext1_contact.png" and names[1, 3] == "step_0003_ext1_unknown.png"


def test_training_rows(spark):
    rows = spark.range(400).withColumnRenamed("id", "id")
    got = training.training_rows(rows, config.Training(max_train_samples=100, validation_split=0.1)).collect()
    assert sorted(r["id"] for r in got) == list(range(100)) and sum(r["split"] == "val" for r in got) == 10
    assert training.training_rows(rows).where("split = 'val'").count() == 20


def test_channels(spark):
    rows = [(1, bytearray([1, 2, 3, 4, 5, 6]), 3), (2, bytearray([1, 2, 3, 9]), 4), (3, None, 3), (4, bytearray([7, 8]), 1)]
    frames = spark.createDataFrame(rows, "step int, data binary, channels int")
    turned = {r["step"]: r["data"] and list(r["data"]) for r in raster.swapped(frames).collect()}
    assert turned == {1: [3, 2, 1, 6, 5, 4], 2: [3, 2, 1, 9], 3: None, 4: [7, 8]}
    assert {r["step"]: r["data"] and list(r["data"]) for r in raster.first_channel(frames).collect()} == {1: [1, 4], 2: [1], 3: None, 4: [7, 8]}
