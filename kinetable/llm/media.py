"""Media columns: texts as baseline JPEG files, read back with dimensions and thumbnail hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed
from .jpeg import ROW, difference_hash, encode, thumbnails

SLICE = 1 << 20


def pad(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of 192."""
    return text + b" " * (-len(text) % ROW or (ROW if not text else 0))


def whole_picture(pictures: list[tuple[int, int, np.ndarray]]) -> tuple[int, int, np.ndarray]:
    """Width, height and luminance of all pictures of a file, one below the other; narrower ones are filled with black."""
    if len(pictures) == 1:
        return pictures[0]
    wide = max(v.shape[1] for _, _, v in pictures)
    rows = [np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, _, v in pictures]
    return max(w for w, _, _ in pictures), sum(h for _, h, _ in pictures), np.concatenate(rows)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the JPEG file), payload (read back from it), width, height, thumbnail_hash.

    A null text counts as empty: 192 spaces.  Equal texts give equal files, whatever rows surround
    them.  A text beyond 1.5 MB takes several pictures in one file; width, height and hash are those
    of all of them, one below the other.  Repeated rows and null ids keep their rows; an empty table gives
    none.  Other columns are not looked at.
    """

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE):
                texts = [(x or "").encode() for x in b.column("text").to_pylist()]
                media = encode([pad(x) for x in texts])
                read = [whole_picture(x) for x in thumbnails(media)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(x) for x in texts], pa.int64()),
                        pa.array(media, pa.binary()),
                        pa.array([x[2].tobytes() for x in read], pa.binary()),
                        pa.array([x[0] for x in read], pa.int32()),
                        pa.array([x[1] for x in read], pa.int32()),
                        pa.array([difference_hash(x[2]) for x in read], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "media", "payload", "width", "height", "thumbnail_hash"],
                )

    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, n_bytes long, media binary, payload binary, width int, height int, thumbnail_hash string")


def thumbnail_columns(files: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, width, height, thumbnail (DC-only luminance, row by row), thumbnail_hash of JPEG files.

    Several pictures in a file count as one, the first on top.  Null, broken and non-baseline files give nulls.
    Repeated rows and null ids keep their rows; other columns are not looked at.
    """

    def read(data):
        try:
            return whole_picture(thumbnails([data])[0]) if data else None
        except (ValueError, KeyError, IndexError):
            return None

    def run(batches):
        for b in batches:
            found = [read(x) for x in b.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x and x[0] for x in found], pa.int32()),
                    pa.array([x and x[1] for x in found], pa.int32()),
                    pa.array([x and x[2].tobytes() for x in found], pa.binary()),
                    pa.array([x and difference_hash(x[2]) for x in found], pa.string()),
                ],
                ["doc_id", "width", "height", "thumbnail", "thumbnail_hash"],
            )

    own = in_small_batches(files).select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return own.mapInArrow(trimmed(run), "doc_id long, width int, height int, thumbnail binary, thumbnail_hash string")
