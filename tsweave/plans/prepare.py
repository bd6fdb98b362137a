"""From a raw table to a panel: drop gaps, clean numbers, parse dates, project."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tsweave.functions.cleaning import clean_numeric, nan_to_null
from tsweave.functions.dates import parse_dates, parse_timestamp
from tsweave.sources.files import drop_incomplete, to_panel
from tsweave.spec import PANEL, SeriesSpec


def prepare_series(
    df: DataFrame,
    value: str,
    seq: str,
    ts: str = "timestamp",
    key: str | None = None,
    dates: str = "most_specific",
    signed: bool = True,
    drop_gaps: bool = True,
    spec: SeriesSpec = PANEL,
) -> DataFrame:
    """Any table to panel columns.

    ``drop_gaps`` drops rows with a null in any column of the table, before
    projecting. Text values are cleaned; text dates are parsed with the modes
    of ``parse_dates``, or as ISO text with ``dates="iso"``. What cannot be
    read becomes null. ``seq`` must be a real column that tells the order in
    which the rows arrived: Spark rows have none of their own.
    """
    rows = drop_incomplete(df) if drop_gaps else df
    kinds = {f.name: f.dataType for f in df.schema.fields}
    number = F.col(f"`{value}`")
    if isinstance(kinds[value], T.StringType):
        number = clean_numeric(number, signed)
    else:
        number = nan_to_null(number.cast("double"))
    time = F.col(f"`{ts}`")
    if isinstance(kinds[ts], T.StringType):
        time = parse_timestamp(time) if dates == "iso" else parse_dates(time, dates)
    else:
        time = time.cast("timestamp_ntz")
    return to_panel(rows, time, number, F.col(f"`{seq}`"), F.col(f"`{key}`") if key else None, spec)
