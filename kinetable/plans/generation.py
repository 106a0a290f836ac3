"""End to end: from steps to finished question items, in one lazy plan and one scan of the steps.

Two families of episodes: catalogue ones, whose templates ask about a keyframe, and raw ones with
calibrated cameras, whose templates ask about what a camera sees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import in_image, pixel_of
from ..functions.hashing import draw01
from ..functions.text import path_success
from ..operators import items
from ..operators.phases import key_steps
from .config import Generation

WRIST = "wrist"
ARROW_GAP = math.radians(30)


def keyed_steps(steps: DataFrame, episodes: DataFrame, settings: Generation | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Keyframes with what the templates need: g, phase, last_start, last, others, frames, instruction, its noun, success.

    ``episodes``: episode_id, instruction, path.  Only keyframes go on from here, so wide columns such
    as pictures are joined after this, by episode and step.
    """
    own = settings or Generation()
    keys = key_steps(steps, grasp=own.grasp_threshold, contact=own.contact_threshold, also=also)
    return keys.join(items.with_noun(episodes), "episode_id").withColumn("success", path_success(F.col("path")))


def catalogue_items(keys: DataFrame, compat: bool = False, figures: Observation | None = None) -> DataFrame:
    """The templates of catalogue episodes, finished; order by episode, step and rank gives item numbers.  ``figures``: see ``items.finalize``."""
    every = [
        items.stable_grasp_item(), items.task_success_item(), items.gripper_open_item(), items.object_reachable_item(),
        items.goal_configuration_item(compat), items.action_phase_item(), items.next_action_item(),
    ]
    return items.finalize(items.made(keys, *every), compat, figures)


def arrows(angle: Column, camera: Column) -> Column:
    """The true heading and four others at least 30 degrees apart, drawn by hash."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: draw01("arrow", F.col("episode_id"), F.col("step"), camera, i) * (2 * math.pi))
    return items.spaced_angles(angle, drawn, ARROW_GAP)


def seen_by(camera: Column, point: Column) -> Column:
    return pixel_of(point, camera["extrinsics"], camera["intrinsics"])


def raw_items(keys: DataFrame, compat: bool = False) -> DataFrame:
    """The templates of raw episodes, finished; order by episode, step, rank and tag gives item numbers.

    ``keys``: keyframes with pose and next_pose (x, y, z first), and ``cameras``, an array of structs camera,
    extrinsics, intrinsics, width, height and five (depth points, or null).  An episode asks once for each
    camera but the wrist's what its trajectory is; each keyframe asks for success, a corresponding point in
    another camera, the goal, and by camera for depths and the direction of motion.
    """
    outer = F.filter("cameras", lambda x: x["camera"] != WRIST)
    rows = keys.withColumn("outer", outer).withColumn("pair", items.camera_pair(F.col("outer"), F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"))))
    a, b = F.col("pair.a"), F.col("pair.b")
    rows = rows.withColumns({"p": F.when(F.col("pair").isNotNull(), seen_by(a, F.col("pose"))), "q": F.when(F.col("pair").isNotNull(), seen_by(b, F.col("pose")))})
    both = in_image(F.col("p"), a["width"], a["height"]) & in_image(F.col("q"), b["width"], b["height"]) & (F.col("step") + 5 < F.col("last"))
    name = F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"), a["camera"], b["camera"])
    rows = rows.withColumn("wrong", F.when(both, items.quadrant_points(name, F.col("q"), b["width"], b["height"])))

    def of_camera(x: Column) -> Column:
        here, there = seen_by(x, F.col("pose")), seen_by(x, F.col("next_pose"))
        inside = F.col("next_pose").isNotNull() & (here["u"] >= 0) & (here["v"] >= 0) & (there["u"] >= 0) & (there["v"] >= 0)
        return F.array(items.relative_depth_item(x["camera"], x["five"]), items.action_direction_item(x["camera"], inside, compat))

    told = F.transform("outer", lambda x: F.when(F.col("step") == 0, items.trajectory_language_item()))
    every = [items.task_success_item(), items.correspondence_item(a["camera"], b["camera"], F.col("q"), F.col("wrong")), items.goal_configuration_item(compat)]
    return items.finalize(items.made(rows, *every, several=F.concat(told, F.flatten(F.transform("outer", of_camera)))), compat)
