"""Min-max scaling per series, fitted on the train part only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tsweave.operators.panel import Panel

RANGE = (-1.0, 1.0)


def _span(lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def scale(value: Column, lo: Column, hi: Column, feature_range: tuple[float, float] = RANGE) -> Column:
    """``lo``..``hi`` to the range; a constant series goes to the low end."""
    a, b = feature_range
    return F.lit(a) + (value - lo) * F.lit(b - a) / _span(lo, hi)


def unscale(scaled: Column, lo: Column, hi: Column, feature_range: tuple[float, float] = RANGE) -> Column:
    """Back to original units."""
    a, b = feature_range
    return lo + (scaled - F.lit(a)) * _span(lo, hi) / F.lit(b - a)


def fit_minmax(panel: Panel, train: Column) -> Panel:
    """Add ``lo`` and ``hi``: bounds of the target over the train rows."""
    value = F.when(train, F.col(panel.spec.value))
    return panel.with_series_stats(lo=F.min(value), hi=F.max(value))


def minmax(panel: Panel, train: Column, feature_range: tuple[float, float] = RANGE) -> Panel:
    """Fit on the train rows and add ``scaled`` to all rows, without clipping."""
    fitted = fit_minmax(panel, train)
    value, lo, hi = F.col(panel.spec.value), F.col("lo"), F.col("hi")
    return fitted.with_columns({"scaled": scale(value, lo, hi, feature_range)})
