"""Pictures as rows of bytes: resizing, stitching, drawing and PNG, in numpy; layouts stay in SQL.

``frames`` has columns episode_id, step, camera, height, width, channels and data (rows of pixels, eight
bits a channel).  Pictures are grouped by (episode, step), a handful of cameras each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phases import episode

STITCHED = "episode_id string, step int, cameras int, height int, width int, channels int, data binary, labels array<struct<camera:string,u:int,v:int>>"


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Three channels: an alpha channel goes, a single one is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, :3]


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    if a.shape[:2] == (height, width):
        return a
    y = np.clip((np.arange(height) + 0.5) * a.shape[0] / height - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * a.shape[1] / width - 0.5, 0, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def centred(a: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width, 3), np.uint8)
    top, left = (height - a.shape[0]) // 2, (width - a.shape[1]) // 2
    out[top : top + a.shape[0], left : left + a.shape[1]] = a
    return out


def stitch(images: list[np.ndarray]) -> np.ndarray:
    """All pictures on one sheet: a row of up to two, else two columns; each centred in a cell of the largest size."""
    height, width = max(a.shape[0] for a in images), max(a.shape[1] for a in images)
    columns = len(images) if len(images) <= 2 else 2
    rows = -(-len(images) // columns)
    cells = [centred(a, height, width) for a in images] + [np.zeros((height, width, 3), np.uint8)] * (rows * columns - len(images))
    return np.vstack([np.hstack(cells[r * columns : (r + 1) * columns]) for r in range(rows)])


def goal_sheet(five: list[np.ndarray]) -> np.ndarray:
    """Five pictures at the largest size, three above two and a blank."""
    height, width = max(a.shape[0] for a in five), max(a.shape[1] for a in five)
    cells = [resize(a, height, width) for a in five] + [np.zeros((height, width, 3), np.uint8)]
    return np.vstack([np.hstack(cells[:3]), np.hstack(cells[3:])])


def strip(images: list[np.ndarray]) -> np.ndarray:
    """Side by side at the median size."""
    height, width = int(np.median([a.shape[0] for a in images])), int(np.median([a.shape[1] for a in images]))
    return np.hstack([resize(a, height, width) for a in images])


def disc(a: np.ndarray, u: int, v: int, radius: int, colour: tuple[int, int, int]) -> np.ndarray:
    """A copy with a filled circle, cut at the borders."""
    y, x = np.ogrid[: a.shape[0], : a.shape[1]]
    out = a.copy()
    out[(x - u) ** 2 + (y - v) ** 2 <= radius**2] = colour
    return out


def line(a: np.ndarray, p: tuple[int, int], q: tuple[int, int], colour: tuple[int, int, int], thick: int = 2) -> np.ndarray:
    """A copy with a straight line."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    d = np.array(q, float) - p
    t = np.clip(((x - p[0]) * d[0] + (y - p[1]) * d[1]) / max(d @ d, 1e-9), 0, 1)
    out = a.copy()
    out[(x - p[0] - t * d[0]) ** 2 + (y - p[1] - t * d[1]) ** 2 <= (thick / 2) ** 2] = colour
    return out


def arrow(a: np.ndarray, p: tuple[int, int], q: tuple[int, int], colour: tuple[int, int, int], tip: float = 0.3) -> np.ndarray:
    out = line(a, p, q, colour)
    angle, size = np.arctan2(q[1] - p[1], q[0] - p[0]), tip * np.hypot(q[0] - p[0], q[1] - p[1])
    for turn in (np.pi / 4, -np.pi / 4):
        out = line(out, q, (int(q[0] - size * np.cos(angle + turn)), int(q[1] - size * np.sin(angle + turn))), colour)
    return out


def png(a: np.ndarray) -> bytes:
    """A PNG file of blue-green-red rows."""
    raw = b"".join(b"\x00" + row.tobytes() for row in np.ascontiguousarray(a[:, :, ::-1]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def stitch_frames(frames: DataFrame) -> DataFrame:
    """One sheet for each episode and step, cameras in order of name; ``labels`` says where each camera's cell begins, for captions."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("camera")
        sheet = stitch([pixels(r.data, r.height, r.width, r.channels) for r in rows.itertuples()])
        columns = min(len(rows), 2)
        high, wide = sheet.shape[0] // -(-len(rows) // columns), sheet.shape[1] // columns
        labels = [{"camera": c, "u": k % columns * wide, "v": k // columns * high} for k, c in enumerate(rows["camera"])]
        return pd.DataFrame({"episode_id": [str(key[0])], "step": [int(key[1])], "cameras": [len(rows)], "height": [sheet.shape[0]], "width": [sheet.shape[1]], "channels": [3], "data": [sheet.tobytes()], "labels": [labels]})

    whole = frames.where("data is not null").select("episode_id", "step", "camera", "height", "width", "channels", "data")
    return whole.groupBy("episode_id", "step").applyInPandas(run, STITCHED)


def encode_frames(frames: DataFrame) -> DataFrame:
    """Adds png and image_id, the SHA-256 of the file, which names and deduplicates pictures."""

    @F.pandas_udf("binary")
    def encode(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else png(pixels(d, h, w, c)) for d, h, w, c in zip(data, height, width, channels, strict=True)])

    return frames.withColumn("png", encode("data", "height", "width", "channels")).withColumn("image_id", F.sha2("png", 256)).withColumn("base64", F.base64("png"))


def with_channels(frames: DataFrame, change) -> DataFrame:
    """``frames`` whose pixels are ``change``'s, a function of [row, column, channel]; a picture without data stays as it is."""

    @F.pandas_udf("binary")
    def changed(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else np.ascontiguousarray(change(np.frombuffer(d, np.uint8).reshape(-1, 1, c))).tobytes() for d, c in zip(data, channels, strict=True)])

    return frames.withColumn("data", changed("data", "channels"))


def swapped(frames: DataFrame) -> DataFrame:
    """Blue-green-red for red-green-blue and the other way round; a fourth channel stays last."""
    return with_channels(frames, lambda a: np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], 2) if a.shape[2] >= 3 else a)


def first_channel(frames: DataFrame) -> DataFrame:
    """The first channel alone, as depth pictures of several equal channels are read."""
    return with_channels(frames, lambda a: a[:, :, :1]).withColumn("channels", F.lit(1))


def key_frames(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """Frames of keyframes only; the semi-join drops the others before their pixels move."""
    return frames.join(keys.select("episode_id", "step").distinct(), ["episode_id", "step"], "left_semi")


def path_segments(points: DataFrame, pixel: Column) -> DataFrame:
    """Line segments of a projected trajectory in order of step; points out of view part the line, the first and last in view are marked."""
    seen = (pixel.u >= 0) & (pixel.v >= 0)
    order = episode("step")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = points.withColumn("_p", F.when(seen, pixel))
    marked = at.withColumns({
        "_q": F.lag("_p").over(order),
        "_first": F.first(F.when(seen, F.col("step")), ignorenulls=True).over(whole),
        "_last": F.last(F.when(seen, F.col("step")), ignorenulls=True).over(whole),
    })
    return marked.where("_p is not null").select(
        "episode_id", "step", F.col("_q.u").alias("from_u"), F.col("_q.v").alias("from_v"), F.col("_p.u").alias("to_u"), F.col("_p.v").alias("to_v"),
        (F.col("step") == F.col("_first")).alias("is_first"), (F.col("step") == F.col("_last")).alias("is_last"),
    )
