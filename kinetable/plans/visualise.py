"""Motion drawn on frames: where the hand is, is sent and will be, and the path of a whole episode.

Points are projected as columns; only frames that have something to draw go to Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import pixel_of
from ..operators.phases import episode
from ..operators.raster import arrow, disc, line, path_segments, pixels
from ..operators.sequences import gradient

AHEAD = 10
WHITE, RED, BLUE = (255, 255, 255), (0, 0, 255), (255, 0, 0)


def action_marks(steps: DataFrame, cameras: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """episode_id, step, camera, current, target, future: pixels (u, v), (-1, -1) out of view.

    ``steps``: episode_id, step, pose and target (null: the next pose); ``cameras``: episode_id, camera, extrinsics, intrinsics.  The
    future is ``ahead`` steps on, at the end the last step.
    """
    order = episode("step")
    last = F.last("pose").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = steps.withColumns({"future": F.coalesce(F.lead("pose", ahead).over(order), last), "target": F.coalesce(F.col("target"), F.lead("pose").over(order), F.col("pose"))})
    both = rows.join(cameras, "episode_id")
    at = lambda p: pixel_of(F.col(p), F.col("extrinsics"), F.col("intrinsics"))
    return both.select("episode_id", "step", "camera", at("pose").alias("current"), at("target").alias("target"), at("future").alias("future"))


def draw_actions(frames: DataFrame, marks: DataFrame) -> DataFrame:
    """``frames`` that have marks, with an arrow to the future, discs on the three points and status: drawn, or not in view."""

    @F.pandas_udf("binary")
    def drawn(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, current: pd.DataFrame, target: pd.DataFrame, future: pd.DataFrame) -> pd.Series:
        out = []
        for d, h, w, c, p, q, r in zip(data, height, width, channels, current.itertuples(index=False), target.itertuples(index=False), future.itertuples(index=False), strict=True):
            a = pixels(d, h, w, c)
            if min(*p, *r) >= 0 and tuple(p) != tuple(r):
                a = arrow(a, tuple(p), tuple(r), BLUE)
            for point, colour in ((r, BLUE), (q, RED), (p, WHITE)):
                if min(point) >= 0:
                    a = disc(a, point[0], point[1], 5, colour)
            out.append(a.tobytes())
        return pd.Series(out)

    seen = (F.col("current.u") >= 0) & (F.col("current.v") >= 0)
    rows = frames.where("data is not null").join(marks, ["episode_id", "step", "camera"])
    made = rows.withColumn("data", drawn("data", "height", "width", "channels", "current", "target", "future"))
    return made.select("episode_id", "step", "camera", "height", "width", F.lit(3).alias("channels"), "data", F.when(seen, "drawn").otherwise("not in view").alias("status"))


def draw_trajectories(frames: DataFrame, steps: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each frame with the projected path of its whole episode, red at the end and blue at the begin, first and last point marked.

    ``frames``: one an episode and camera; ``steps``: episode_id, step, pose.
    """
    at = pixel_of(F.col("pose"), F.col("extrinsics"), F.col("intrinsics"))
    every = episode().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = steps.withColumns({"n": F.count("*").over(every), "k": F.row_number().over(episode("step")) - 1}).join(cameras, "episode_id")
    red, blue = gradient(F.col("k"), F.col("n"))
    placed = rows.select(F.concat_ws("\x1f", F.col("episode_id").cast("string"), "camera").alias("episode_id"), "step", at.alias("p"), F.col("episode_id").alias("_e"), "camera", red.alias("red"), blue.alias("blue"))
    parts = path_segments(placed, F.col("p")).join(placed.select("episode_id", "step", "_e", "camera", "red", "blue"), ["episode_id", "step"])
    segment = F.struct("step", "from_u", "from_v", "to_u", "to_v", "red", "blue", "is_first", "is_last")
    paths = parts.groupBy(F.col("_e").alias("episode_id"), "camera").agg(F.array_sort(F.collect_list(segment)).alias("path"))

    @F.pandas_udf("binary")
    def drawn(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for d, h, w, c, path_ in zip(data, height, width, channels, path, strict=True):
            a = pixels(d, h, w, c)
            for s in path_:
                if s["from_u"] is not None and not pd.isna(s["from_u"]):
                    a = line(a, (int(s["from_u"]), int(s["from_v"])), (int(s["to_u"]), int(s["to_v"])), (s["blue"], 0, s["red"]))
            for s in path_:
                if s["is_first"] or s["is_last"]:
                    a = disc(a, int(s["to_u"]), int(s["to_v"]), 6, (s["blue"], 0, s["red"]))
            out.append(a.tobytes())
        return pd.Series(out)

    rows = frames.where("data is not null").join(paths, ["episode_id", "camera"])
    return rows.withColumn("data", drawn("data", "height", "width", "channels", "path")).select("episode_id", "step", "camera", "height", "width", F.lit(3).alias("channels"), "data")


def frame_names(frames: DataFrame, phases: DataFrame) -> DataFrame:
    """``frames`` with the file name that tells step, camera and phase; frames without a phase are unknown."""
    named = frames.join(phases.select("episode_id", "step", "phase"), ["episode_id", "step"], "left").withColumn("phase", F.coalesce("phase", F.lit("unknown")))
    return named.withColumn("name", F.format_string("step_%04d_%s_%s.png", "step", "camera", "phase"))
