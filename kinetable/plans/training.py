"""Rows to train on: a head by position and a labelled validation share, as the settings say."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.splits import head, validation_split
from .config import Training


def training_rows(rows: DataFrame, settings: Training | None = None, key: str = "id") -> DataFrame:
    """The first max_train_samples rows by ``key``, all if there is no such bound, labelled train or val in ``split``."""
    own = settings or Training()
    kept = rows if own.max_train_samples is None else head(rows, key, own.max_train_samples)
    return validation_split(kept, key, own.validation_split, str(own.random_state))
