"""End to end: exported catalogue episodes to folders of question items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.standardize import REGISTRY, standardize
from ..sources import catalogue, sinks
from .config import Generation
from .generation import catalogue_items, keyed_steps

MARK = "\x1f"
FRAMES = "dataset string, episode_id string, step int, image_id string, png binary"


def readings(spark: SparkSession, folder: str, settings: Generation) -> DataFrame | None:
    """dataset, episode_id (both in one, parted by MARK), step, gripper, instruction of all data sets that are there, have a plan and a gripper; None if none."""
    out = []
    for name in settings.datasets or catalogue.DEFAULT_DATASETS:
        known = catalogue.catalogue_name_of(name) in REGISTRY
        rows = catalogue.catalogue_steps(spark, folder, (name,), settings.num_episodes) if known else None
        if rows is None or "language_instruction" in rows.columns or len(rows.columns) <= 4:  # no such export
            continue
        done = standardize(rows, name)
        if "gripper_position" in done.columns:
            key = F.concat(F.lit(name + MARK), F.col("episode_id").cast("string"))
            out.append(done.select(key.alias("episode_id"), "step", F.col("gripper_position").cast("double").alias("gripper"), "instruction"))
    return reduce(DataFrame.unionByName, out) if out else None


def generate(spark: SparkSession, folder: str, out: str, settings: Generation | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Writes out/<dataset>/<episode>/ with items, pictures and metadata, and returns what was written.

    ``frames``: dataset, episode_id, step, image_id, png of keyframes' pictures; an item shows its step's.  A catalogue
    episode always counts as a success.
    """
    own = settings or Generation()
    steps = readings(spark, folder, own)
    if steps is None:
        return spark.createDataFrame([], sinks.WRITTEN)
    told = steps.groupBy("episode_id").agg(F.min_by("instruction", "step").alias("instruction")).withColumn("path", F.lit("success"))
    found = catalogue_items(keyed_steps(steps.drop("instruction"), told, own), own.compat)
    name = F.split("episode_id", MARK)
    parted = lambda rows: rows.withColumns({"dataset": name[0], "episode_id": name[1]})
    pictures = spark.createDataFrame([], FRAMES) if frames is None else frames.withColumn("episode_id", F.col("episode_id").cast("string"))
    shown = pictures.groupBy("dataset", "episode_id", "step").agg(F.array_sort(F.collect_set("image_id")).alias("image_ids"))
    rows = parted(found).join(shown, ["dataset", "episode_id", "step"], "left").withColumn("image_ids", F.coalesce("image_ids", F.array().cast("array<string>")))
    wanted = rows.select("dataset", "episode_id", F.explode("image_ids").alias("image_id")).distinct()
    used = pictures.select("dataset", "episode_id", "image_id", "png").join(wanted, ["dataset", "episode_id", "image_id"], "left_semi")
    about = parted(told).select("dataset", "episode_id", F.col("instruction").alias("language_instruction"))
    return sinks.write_items(rows, used, about, out)
