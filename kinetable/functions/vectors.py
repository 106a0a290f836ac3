"""Vector columns: slices, fills, clips, rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(v: Column, start: int, stop: int | None = None) -> Column:
    """v[start:stop] with zero-based, possibly negative bounds."""
    n = F.size(v)
    begin = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    end = n if stop is None else (F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0)))
    return F.slice(v, begin + 1, F.greatest(end - begin, F.lit(0)))


def item(v: Column, i: int) -> Column:
    """v[i], null if there is none."""
    return F.try_element_at(v, F.lit(i + 1 if i >= 0 else i))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def invert(x: Column) -> Column:
    return F.lit(1.0) - x


def negate(x: Column) -> Column:
    return -x


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def euler_of_quaternion(q: Column) -> Column:
    """Roll, pitch and yaw (x, y, z) of a quaternion in the order x, y, z, w; it is normalised first."""
    x, y, z, w = (item(q, i) for i in range(4))
    n = x * x + y * y + z * z + w * w
    sine = clip(F.lit(2.0) * (w * y - z * x) / n, -1.0, 1.0)
    return F.array(
        F.atan2(F.lit(2.0) * (w * x + y * z) / n, F.lit(1.0) - F.lit(2.0) * (x * x + y * y) / n),
        F.asin(sine),
        F.atan2(F.lit(2.0) * (w * z + x * y) / n, F.lit(1.0) - F.lit(2.0) * (y * y + z * z) / n),
    )


def rotate2d(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """A world displacement in the frame that is turned by yaw."""
    return dx * F.cos(yaw) + dy * F.sin(yaw), dy * F.cos(yaw) - dx * F.sin(yaw)
