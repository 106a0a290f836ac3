"""Sequence operators over the step axis: relabelling, gripper decisions, sampling, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.vectors import subtract, take
from .phases import episode


def lengths(steps: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """episode_id, length: what ``metadata`` (episode_id, trajectory_length) says, else the last step plus one."""
    own = steps.groupBy("episode_id").agg((F.max("step") + 1).alias("length"))
    if metadata is None:
        return own
    told = metadata.groupBy("episode_id").agg(F.max("trajectory_length").alias("_told"))
    return own.join(told, "episode_id", "left").select("episode_id", F.coalesce("_told", "length").cast("int").alias("length"))


def future_step(step: Column, ahead: int, length: Column) -> Column:
    return F.least(step + ahead, length - 1)


def keyframes(runs: DataFrame, seed: str = "keyframe") -> DataFrame:
    """episode_id, step: one drawn step for each phase run (its end excluded, unless it is one step), the first and the last.

    The runs are read once; an episode's runs are together already where they come of a fold.
    """
    span = F.col("end") - F.col("start")
    drawn = F.when(span == 0, F.col("start")).otherwise(F.col("start") + F.pmod(draw(seed, F.col("episode_id"), F.col("start")), span)).cast("int")
    every = runs.groupBy("episode_id").agg(F.collect_list(drawn).alias("keys"), F.max("end").cast("int").alias("last"))
    return every.select("episode_id", F.explode(F.array_distinct(F.concat("keys", F.array(F.lit(0), F.col("last"))))).alias("step"))


def relabel_actions(steps: DataFrame, state: str = "state", action: str = "action") -> DataFrame:
    """Actions as the state's change over six dimensions with the gripper kept; the last step goes."""
    ahead = F.lead(state).over(episode("step"))
    moved = F.concat(subtract(take(ahead, 0, 6), take(F.col(state), 0, 6)), take(F.col(action), -1))
    return steps.withColumn("_ahead", ahead).withColumn(action, moved).where("_ahead is not null").drop("_ahead")


def binarize(steps: DataFrame, column: str = "gripper", high: float = 0.95, low: float = 0.05) -> DataFrame:
    """1 above ``high``, 0 below ``low``; in between the next decided value, at the end the last raw one."""
    decided = F.when(F.col(column) > high, 1.0).when(F.col(column) < low, 0.0)
    ahead = episode("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return steps.withColumn("open", F.coalesce(F.first(decided, ignorenulls=True).over(ahead), F.last(column).over(ahead)))


def relative_to_absolute_start(steps: DataFrame, column: str = "gripper") -> DataFrame:
    """The state before a relative gripper signal first acts: 1 if it first closes, 0 if it opens or never acts."""
    acts = F.when(F.col(column) < -1e-3, 1.0).when(F.col(column) > 1e-3, 0.0)
    return steps.groupBy("episode_id").agg(F.coalesce(F.min_by(acts, F.when(acts.isNotNull(), F.col("step"))), F.lit(0.0)).alias("initial"))


def subsample(steps: DataFrame, every: int) -> DataFrame:
    """Every k-th step, numbered anew."""
    return steps.where(F.col("step") % every == 0).withColumn("step", (F.col("step") / every).cast("int"))


def gnm_waypoints(steps: DataFrame, every: int = 3) -> DataFrame:
    """Waypoint actions of a navigation episode: displacements of every third position in the turned frame, scaled.

    ``steps``: episode_id, step, x, y, yaw, ax, ay (the first action).  The scale is the length of the
    first action over the length of the first displacement; the last kept step has no action.
    """
    first = episode("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c, i: F.nth_value(c, i).over(first)
    hyp = lambda a, b: F.sqrt(a * a + b * b)
    scale = hyp(at("ax", 1), at("ay", 1)) / hyp(at("x", 2) - at("x", 1), at("y", 2) - at("y", 1))
    kept = subsample(steps.withColumn("scale", scale), every)
    dx, dy = F.lead("x").over(episode("step")) - F.col("x"), F.lead("y").over(episode("step")) - F.col("y")
    turned = kept.withColumns({"dx": dx, "dy": dy}).where("dx is not null")
    c, s = F.cos("yaw"), F.sin("yaw")
    return turned.select(
        "episode_id", "step", ((F.col("dx") * c + F.col("dy") * s) * F.col("scale")).alias("wx"), ((F.col("dy") * c - F.col("dx") * s) * F.col("scale")).alias("wy")
    )


def gradient(position: Column, count: Column) -> tuple[Column, Column]:
    """Red and blue of a point on a trajectory's colour run; a single point is blue."""
    red = F.when(count > 1, F.floor(255 * position / (count - 1))).otherwise(F.lit(0)).cast("int")
    return red, (F.lit(255) - red).cast("int")


def frame_pick(frames: DataFrame, keyframe: DataFrame, lengths_: DataFrame) -> DataFrame:
    """The frame shown to a vision model: the first keyframe's, else the middle one's; a non-wrist camera first."""
    first = keyframe.groupBy("episode_id").agg(F.min("step").alias("key"))
    at = F.coalesce("key", F.floor(F.col("length") / 2).cast("int"))
    want = lengths_.join(first, "episode_id", "left").select("episode_id", at.alias("step"))
    rank = F.struct(F.contains(F.lower("camera"), F.lit("wrist")).alias("wrist"), F.col("camera"))
    return frames.join(want, ["episode_id", "step"]).groupBy("episode_id", "step").agg(F.min_by("camera", rank).alias("camera"))
