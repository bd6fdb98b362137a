"""Sliding windows: the last values of a series as input, the next as target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tsweave.operators.panel import Panel
from tsweave.operators.splits import explode_split
from tsweave.spec import SeriesSpec

WINDOW_LENGTH = 12


def history_column(value: Column, w: WindowSpec, length: int = WINDOW_LENGTH) -> Column:
    """The ``length`` values before the row on a window, oldest first."""
    return F.array(*[F.lag(value, k).over(w) for k in range(length, 0, -1)])


def with_history(panel: Panel, length: int = WINDOW_LENGTH, column: str | None = None) -> Panel:
    """Add ``x``: the ``length`` values before the row, oldest first.

    Places before the start of the series are null.
    """
    value = F.col(column or panel.spec.value)
    return panel.over(length, lambda w: {"x": history_column(value, w, length)})


def usable(start: Column, end: Column, length: int, keep_last: bool) -> Column:
    """Rows of ``[start, end)`` that are the target of a window inside it.

    The last one is left out unless ``keep_last``.
    """
    last = end - 1 if keep_last else end - 2
    return F.col("pos").between(start + length, last)


def sliding_windows(
    panel: Panel,
    length: int = WINDOW_LENGTH,
    column: str | None = None,
    keep_last: bool = False,
) -> DataFrame:
    """One row per window of a series: ``x``, its target ``y`` and ``y_ts``.

    A series of n rows gives n - length - 1 windows, or n - length with
    ``keep_last=True``.
    """
    spec = panel.spec
    held = with_history(panel, length, column)
    kept = held.where(usable(F.lit(0), F.col("n"), length, keep_last))
    return kept.rows(
        spec.key, "pos", "x", F.col(column or spec.value).alias("y"), F.col(spec.ts).alias("y_ts")
    )


def split_windows(
    panel: Panel,
    length: int = WINDOW_LENGTH,
    column: str | None = None,
    keep_last: bool = False,
) -> DataFrame:
    """Windows of the train part and of the test part, named in ``split``.

    Needs the columns of ``split_ceil_overlap``. Both parts read the same
    history, so the windows are built once; where the parts overlap a window
    counts in both. Any other column of the panel is kept.
    """
    spec = panel.spec
    held = with_history(panel, length, column).df
    train = usable(F.lit(0), F.col("train_rows"), length, keep_last)
    test = usable(F.col("test_start"), F.col("n"), length, keep_last)
    return (
        explode_split(held, train, test)
        .withColumn("y", F.col(column or spec.value))
        .withColumn("y_ts", F.col(spec.ts))
    )


def last_windows(windows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The last window of each series: the seed of a forecast."""
    w = Window.partitionBy(spec.key).orderBy(F.desc("pos"))
    return windows.withColumn("_from_end", F.row_number().over(w)).where("_from_end = 1").drop("_from_end")


def seed_windows(panel: Panel, length: int = WINDOW_LENGTH, column: str | None = None, keep_last: bool = False) -> DataFrame:
    """The window that a forecast of each series starts from: one row per series, whatever its length.

    ``x`` are the last values known to the forecast, newest last, and ``last_ts`` is the time that its steps count
    from; other columns of the panel are kept. As in :func:`sliding_windows` the last row serves only with
    ``keep_last``. ``reason`` says why a series has no usable window and is null otherwise.
    """
    spec = panel.spec
    target = F.greatest(F.col("n") - (1 if keep_last else 2), F.lit(0))
    # Only the rows that the window holds are put in order.
    ends = with_history(panel.where(F.col("pos") >= F.col("n") - length - 2), length, column).where(F.col("pos") == target).df
    if keep_last:
        ends = ends.withColumn("x", slide(F.col("x"), F.col(column or spec.value)))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e))
    short = F.col("n") < (length if keep_last else length + 2)
    reason = F.when(short, "too short").when(bad, "null or NaN in the last window")
    return ends.withColumns({"last_ts": F.col(spec.ts), "reason": reason})


def slide(window: Column, value: Column) -> Column:
    """Append a value and keep the window's length."""
    return F.concat(F.slice(window, F.lit(2), F.size(window) - 1), F.array(value))


def window_violations(windows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Windows with a null or NaN in input or target."""
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e)) | F.col(y).isNull() | F.isnan(y)
    return windows.where(bad)


def clean_windows(windows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Windows without a null or NaN in input or target."""
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e)) | F.col(y).isNull() | F.isnan(y)
    return windows.where(~bad)


def require_clean_windows(windows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Pass windows on, and stop the job at the first null or NaN."""
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e)) | F.col(y).isNull() | F.isnan(y)
    stop = F.raise_error(F.lit("null or NaN in a window"))
    # On both columns: whichever is read, the check is made.
    return windows.withColumns(
        {
            x: F.when(bad, stop.cast("array<double>")).otherwise(F.col(x)),
            y: F.when(bad, stop.cast("double")).otherwise(F.col(y)),
        }
    )
