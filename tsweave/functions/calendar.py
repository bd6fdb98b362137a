"""Calendar parts of a timestamp and their cyclical encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

HOURS_PER_DAY = 24
DAYS_PER_WEEK = 7


def monday_zero(ts: Column) -> Column:
    """Day of week with Monday as 0."""
    return F.weekday(ts)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday is 0), day of month and month."""
    return {
        "hour": F.hour(ts),
        "day_of_week": monday_zero(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
    }


def date_part_columns(ts: Column) -> dict[str, Column]:
    """Year, month, day, hour and weekday (Monday is 0)."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "weekday": monday_zero(ts),
    }


def on_circle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats after ``period``."""
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def cyclical_columns(hour: Column, weekday: Column) -> dict[str, Column]:
    hour_sin, hour_cos = on_circle(hour, HOURS_PER_DAY)
    weekday_sin, weekday_cos = on_circle(weekday, DAYS_PER_WEEK)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "weekday_sin": weekday_sin,
        "weekday_cos": weekday_cos,
    }


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts)))


def add_date_parts(df: DataFrame, ts: str = "ts", cyclical: bool = True, drop_ts: bool = False) -> DataFrame:
    """Date parts, their cyclical encoding, and optionally no raw timestamp."""
    out = df.withColumns(date_part_columns(F.col(ts)))
    if cyclical:
        out = out.withColumns(cyclical_columns(F.col("hour"), F.col("weekday")))
    return out.drop(ts) if drop_ts else out


def future_timestamp(last: Column, steps: Column, step_seconds: Column | None = None) -> Column:
    """``steps`` steps after ``last``: whole days, or the given step length."""
    if step_seconds is None:
        return last + F.make_dt_interval(days=steps.cast("int"))
    return last + F.make_dt_interval(secs=(step_seconds * steps).cast("decimal(18,6)"))
