"""Readers: episode folders, item JSON, images, calibration look-ups, result caches, and the HDF5 source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_trajectory_id, model_slug
from ..operators.items import ITEM, correct_index
from .hdf5 import Hdf5Source

ITEMS_FILE = f"vqa_items array<struct<{ITEM.replace(' struct', ':struct').replace(' array', ':array').replace(' map', ':map')}>>,metadata map<string,string>"
PUBLISHED = "id string, question string, choices array<string>, correct_answer bigint, image struct<bytes:binary,path:string>"


def plain_path() -> Column:
    """The file's path without escapes or a local scheme."""
    decoded = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return F.regexp_replace(decoded, "^file:/+", "/")


def read_items(spark: SparkSession, base: str) -> DataFrame:
    """Items of base/<group>/<episode>/vqa_data.json, one row each; unreadable files give none."""
    raw = spark.read.schema(ITEMS_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{base}/*/*/vqa_data.json")
    path = plain_path()
    parts = F.split(path, "/")
    return raw.select(path.alias("source_file"), F.element_at(parts, -2).alias("trajectory"), F.posexplode("vqa_items").alias("position", "item")).select(
        "source_file",
        clean_trajectory_id(F.col("trajectory")).alias("trajectory_id"),
        F.concat(clean_trajectory_id(F.col("trajectory")), F.lit("_q"), (F.col("position") + 1).cast("string")).alias("id"),
        F.col("item.question.text").alias("question"),
        F.col("item.choices.text").alias("choices"),
        correct_index(F.col("item.choices")).cast("long").alias("correct_answer"),
        first_image(F.col("source_file"), F.col("item.question.image_ids")).alias("image_path"),
        F.col("item.metadata").getItem("tag").alias("tag"),
    )


def first_image(source_file: Column, image_ids: Column) -> Column:
    """The file of the item's first picture; the others of a question are not kept."""
    return F.concat(F.regexp_replace(source_file, "/[^/]*$", ""), F.lit("/images/"), F.try_element_at(image_ids, F.lit(1)), F.lit(".png"))


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """path, width, height, channels, data (rows of blue, green, red) of pictures; broken ones are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(glob)
    return image.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_image_files(spark: SparkSession, glob: str) -> DataFrame:
    """path and bytes of picture files as they are."""
    return spark.read.format("binaryFile").load(glob).select(plain_path().alias("path"), F.col("content").alias("bytes"))


def with_images(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items in the published form; a missing picture is null.  Pictures are joined last, by path."""
    named = files.select(F.col("path").alias("_path"), F.col("bytes"))
    got = items.join(named, F.col("image_path") == F.col("_path"), "left")
    image = F.when(F.col("bytes").isNotNull(), F.struct(F.col("bytes").alias("bytes"), F.col("image_path").alias("path")))
    return got.select("id", "question", "choices", "correct_answer", image.alias("image"))


def read_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """episode_id, length and the serial of each camera of metadata_*.json files."""
    raw = spark.read.option("multiLine", True).schema("ext1_cam_serial string, ext2_cam_serial string, wrist_cam_serial string, trajectory_length int").json(glob)
    episode = F.regexp_extract(F.col("_metadata.file_name"), r"_([^_]+)\.json$", 1)
    return raw.select(episode.alias("episode_id"), "trajectory_length", F.expr("stack(3, 'ext1', ext1_cam_serial, 'ext2', ext2_cam_serial, 'wrist', wrist_cam_serial) as (camera, serial)"))


def read_extrinsics(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, episode_id, serial, extrinsics) of a JSON map of maps."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<double>>>").alias("m"))
    flat = raw.select(F.explode("m").alias("episode_id", "cameras")).select("episode_id", F.explode("cameras").alias("serial", "extrinsics"))
    return flat.select(F.lit(source).alias("source"), "episode_id", "serial", "extrinsics")


def prioritized(cameras: DataFrame, lookup: DataFrame, order: tuple[str, ...] = ("superset", "cam2base", "cam2cam"), own: str = "extrinsics") -> DataFrame:
    """Each camera's extrinsics: the first source in ``order`` that has it, else its own."""
    ranks = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    best = lookup.where(F.col("source").isin(*order)).groupBy("episode_id", "serial").agg(F.min_by("extrinsics", ranks[F.col("source")]).alias("_best"))
    return cameras.join(best, ["episode_id", "serial"], "left").withColumn(own, F.coalesce("_best", own)).drop("_best")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The result cache; an absent one is empty."""
    schema = "model string, question_id string, predicted string, predicted_letter string, response_time double, correct boolean"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.select("model", model_slug(F.col("model")).alias("slug"), "question_id", "predicted", "predicted_letter", "response_time", "correct").write.mode("append").partitionBy("slug").parquet(path)


#: Data sets of a step's action and robot state that are read unless told otherwise.
ACTION = ("cartesian_position", "cartesian_velocity", "gripper_position", "gripper_velocity", "joint_position", "joint_velocity", "target_cartesian_position", "target_gripper_position")
ROBOT_STATE = ("cartesian_position", "gripper_position", "joint_positions", "joint_velocities", "joint_torques_computed", "motor_torques_measured")


def read_hdf5(spark: SparkSession, glob: str, action: tuple[str, ...] = ACTION, robot_state: tuple[str, ...] = ROBOT_STATE) -> DataFrame:
    """Steps of trajectory.h5 files, one row an episode and step: episode_id, step, gripper_position, cartesian_position, and maps of the action and the robot state.

    The named data sets alone are read; one that a file lacks is no key of its maps.
    """
    spark.dataSource.register(Hdf5Source)
    groups = {"action": [("action", n) for n in action], "robot_state": [("observation/robot_state", n) for n in robot_state]}
    columns = {f"{folder}/{n}": "array<double>" for part in groups.values() for folder, n in part}
    raw = spark.read.format("hdf5").schema(", ".join(["episode_id string", "step int", *(f"`{k}` {v}" for k, v in columns.items())])).load(glob)

    def held(part):
        keyed = F.map_from_arrays(F.array(*[F.lit(n) for _, n in part]), F.array(*[F.col(f"`{folder}/{n}`") for folder, n in part]))
        return F.map_filter(keyed, lambda _, v: v.isNotNull())

    whole = raw.select("episode_id", "step", *[held(part).alias(name) for name, part in groups.items()])
    return whole.select("episode_id", "step", F.get(F.col("robot_state")["gripper_position"], F.lit(0)).alias("gripper_position"), F.col("robot_state")["cartesian_position"].alias("cartesian_position"), "action", "robot_state")
