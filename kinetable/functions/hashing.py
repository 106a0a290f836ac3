"""Deterministic draws in place of a random generator.

``h(seed, key)`` is the number in the first eight hex digits of md5("seed|key"); the same text gives
the same number in any engine, so splits, samples and shuffles are stable and can be checked by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: str, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]).cast("binary"))


def draw(seed: str, *key: Column) -> Column:
    """A long in [0, 2^32)."""
    return F.conv(F.substring(digest(seed, *key), 1, 8), 16, 10).cast("long")


def draw01(seed: str, *key: Column) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *key) / F.lit(4294967296.0)
