"""Camera geometry as columns: pinhole projection, quadrants, headings, layout arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import item


def project(point: Column, extrinsics: Column, intrinsics: Column) -> Column:
    """Pixel (u, v) of a world point; (-1, -1) at or behind the camera.

    extrinsics: x, y, z and rotations about the fixed x, y and z axes (R = Rz Ry Rx); the camera point is
    the transpose of R times (point - t).  intrinsics: 3x3 row by row.  Pixels are cut toward zero.
    """
    d = [item(point, i) - item(extrinsics, i) for i in range(3)]
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(item(extrinsics, i)), F.sin(item(extrinsics, i))) for i in (3, 4, 5))
    rows = [
        (cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx),
        (sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx),
        (-sy, cy * sx, cy * cx),
    ]
    cam = [rows[0][j] * d[0] + rows[1][j] * d[1] + rows[2][j] * d[2] for j in range(3)]
    k = [item(intrinsics, i) for i in range(9)]
    x, y = cam[0] / cam[2], cam[1] / cam[2]
    u, v = k[0] * x + k[1] * y + k[2], k[3] * x + k[4] * y + k[5]
    return F.when(cam[2] > 0, F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))).otherwise(
        F.when(cam[2] <= 0, F.struct(F.lit(-1).cast("long").alias("u"), F.lit(-1).cast("long").alias("v")))
    )


def pixel_of(point: Column, extrinsics: Column, intrinsics: Column) -> Column:
    """``project`` as one opaque value, for pixels that several later expressions read: it is computed once and its
    formula is not repeated in each of them."""
    bound = F.array(F.struct(point.alias("p"), extrinsics.alias("e")))
    return F.transform(bound, lambda s: project(s["p"], s["e"], intrinsics))[0]


def in_image(pixel: Column, width: Column, height: Column) -> Column:
    return (pixel.u >= 0) & (pixel.u < width) & (pixel.v >= 0) & (pixel.v < height)


def quadrant(pixel: Column, width: Column, height: Column) -> Column:
    """0 top left, 1 top right, 2 bottom left, 3 bottom right."""
    right = pixel.u >= F.floor(width / 2)
    low = pixel.v >= F.floor(height / 2)
    return right.cast("int") + F.lit(2) * low.cast("int")


def angle_gap(a: Column, b: Column) -> Column:
    """The circular distance as the smaller of |a - b| and what is left of a full turn."""
    gap = F.abs(a - b)
    return F.least(gap, F.lit(2 * math.pi) - gap)


def arrow_end(pixel: Column, angle: Column, length: int = 80) -> Column:
    return F.struct((pixel.u + length * F.cos(angle)).cast("long").alias("u"), (pixel.v + length * F.sin(angle)).cast("long").alias("v"))


def direction_label(diff: Column, signed: bool) -> Column:
    """Upper/Lower with Left/Right or Forward/Backward where the horizontal part is significant.

    ``signed`` compares signed components over all dimensions; otherwise absolute ones over x, y, z.
    """
    size = diff if signed else F.transform(F.slice(diff, 1, 3), lambda x: F.abs(x))
    x, y, most = item(size, 0), item(size, 1), F.array_max(size)
    vertical = F.when(item(diff, 2) > 0, "Upper").otherwise("Lower")
    horizontal = F.when(x > y, F.when(item(diff, 0) > 0, "Right").otherwise("Left")).otherwise(F.when(item(diff, 1) > 0, "Forward").otherwise("Backward"))
    significant = (x > 0.4 * most) | (y > 0.4 * most)
    return F.when(significant, F.concat_ws(" ", vertical, horizontal)).otherwise(vertical)


def resized(width: Column, height: Column, longest: int = 1280) -> Column:
    """Dimensions with the longer side at most ``longest``, cut to whole pixels."""
    wide = width > height
    fit = F.greatest(width, height) <= longest
    return F.when(fit, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(
        F.struct(
            F.when(wide, F.lit(longest)).otherwise((width * (F.lit(float(longest)) / height)).cast("int")).alias("width"),
            F.when(wide, (height * (F.lit(float(longest)) / width)).cast("int")).otherwise(F.lit(longest)).alias("height"),
        )
    )


def grid(count: Column) -> Column:
    """Rows and columns of a stitched picture: one row up to two images, else two columns."""
    return F.when(count <= 2, F.struct(F.lit(1).alias("rows"), count.cast("int").alias("columns"))).otherwise(
        F.struct(F.ceil(count / 2).cast("int").alias("rows"), F.lit(2).alias("columns"))
    )
