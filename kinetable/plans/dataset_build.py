"""End to end: episode folders to train and test Parquet with the published schema."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import resized
from ..functions.pictures import Broken, decode_png, lanczos, png_size
from ..operators.raster import png
from ..operators.splits import size_cap, split_label, threshold
from ..sources.episodes import read_image_files, read_items, with_images
from .config import Build


def fitted_files(spark: SparkSession, glob: str, longest: int) -> DataFrame:
    """path and bytes of picture files whose longer side is ``longest`` at most; larger PNG files are made smaller by Lanczos kernels.

    Files are read once, sizes are taken from their heads, and only larger ones go to Python.  A file that is broken or of another kind stays as it is.
    """
    files = read_image_files(spark, glob).withColumn("_size", png_size(F.col("bytes")))
    large = F.greatest("_size.width", "_size.height") > longest
    size = resized(F.col("_size.width"), F.col("_size.height"), longest)

    @F.pandas_udf("binary")
    def smaller(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for b, h, w in zip(content, height, width, strict=True):
            try:
                out.append(None if b is None else png(lanczos(decode_png(b), max(int(h), 1), max(int(w), 1))))
            except (Broken, struct.error):
                out.append(None)
        return pd.Series(out)

    sized = files.withColumn("_to", F.when(large, size))
    made = smaller(F.when(large, F.col("bytes")), F.coalesce("_to.height", F.lit(0)), F.coalesce("_to.width", F.lit(0)))
    return sized.select("path", F.coalesce(made, "bytes").alias("bytes"))


def build(spark: SparkSession, base: str, out: str, settings: Build | None = None) -> dict[str, str]:
    """Writes out/train and out/test and returns their paths.

    Items are split and capped before pictures are joined, so bytes move once and only for kept items.
    """
    own = settings or Build()
    rows = read_items(spark, base).where("correct_answer is not null")
    labelled = rows.withColumn("split", split_label(F.col("id"), threshold(F.lit(float(own.train)), F.lit(float(own.test)))))
    glob = f"{base}/*/*/images/*.png"
    files = fitted_files(spark, glob, own.longest) if own.images else spark.createDataFrame([], "path string, bytes binary")
    paths = {}
    for name, n in (("train", own.train), ("test", own.test)):
        paths[name] = f"{out}/{name}"
        with_images(size_cap(labelled.where(F.col("split") == name), n, "id"), files).write.mode("overwrite").parquet(paths[name])
    return paths


def published(rows: DataFrame) -> DataFrame:
    return rows.select("id", "question", "choices", "correct_answer", "image")
