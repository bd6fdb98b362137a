"""Train and test parts of each series by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tsweave.operators.panel import Panel

TRAIN_SHARE = 0.8
OVERLAP = 60


def floor_cut(n: Column, share: float = TRAIN_SHARE) -> Column:
    """Number of train rows, rounded down."""
    return F.floor(F.lit(share) * n).cast("bigint")


def ceil_cut(n: Column, share: float = TRAIN_SHARE) -> Column:
    """Number of train rows, rounded up."""
    return F.ceil(F.lit(share) * n).cast("bigint")


def split_floor(panel: Panel, share: float = TRAIN_SHARE) -> Panel:
    """Add ``split``: the first ``floor(share * n)`` rows train, the rest test."""
    train = F.col("pos") < floor_cut(F.col("n"), share)
    return panel.with_columns({"split": F.when(train, "train").otherwise("test")})


def split_ceil_overlap(
    panel: Panel, share: float = TRAIN_SHARE, overlap: int = OVERLAP, clamp: bool = False
) -> Panel:
    """Add ``train_rows``, ``test_start``, ``in_train``, ``in_test``.

    The test part starts ``overlap`` rows before the end of train, so a row can
    be in both. If train is shorter than the overlap, the start is counted from
    the end of the series; ``clamp=True`` starts at row 0 instead.
    """
    n, cut = F.col("n"), ceil_cut(F.col("n"), share)
    back = cut - overlap
    start = F.greatest(back, F.lit(0)) if clamp else F.when(back < 0, F.greatest(n + back, F.lit(0))).otherwise(back)
    return panel.with_columns({"train_rows": cut, "test_start": start}).with_columns(
        {
            "in_train": F.col("pos") < F.col("train_rows"),
            "in_test": F.col("pos") >= F.col("test_start"),
        }
    )


def explode_split(df: DataFrame, train: Column, test: Column) -> DataFrame:
    """One row per part a row belongs to, named in ``split``."""
    parts = F.array_compact(F.array(F.when(train, "train"), F.when(test, "test")))
    return df.withColumn("split", F.explode(parts))


def split_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per series and part."""
    return df.groupBy(key, "split").agg(F.count(F.lit(1)).alias("n_rows"))
