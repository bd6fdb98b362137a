"""Arriving rows through the same cleaning and the saved model.

Column expressions and fitted pipelines work on streams as they are, so these
are thin: nothing here keeps state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tsweave.plans.forecaster import FittedSequence
from tsweave.plans.prepare import prepare_series


def prepare_stream(stream: DataFrame, value: str, seq: str, ts: str = "timestamp", key: str | None = None, **options) -> DataFrame:
    """A stream of raw rows as a stream of panel rows."""
    return prepare_series(stream, value, seq, ts, key, **options)


def score_stream(windows: DataFrame, fitted: FittedSequence) -> DataFrame:
    """Predictions for a stream of scaled windows with the bounds of their series."""
    return fitted.transform(windows)
