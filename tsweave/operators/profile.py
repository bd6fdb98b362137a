"""Table profiles, hour-of-day profiles, previews and line extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tsweave.spec import PANEL, SeriesSpec

# Aggregates that can be chosen by name.
AGGREGATES = {
    # The sum of a group with nothing but nulls is 0, its mean is null.
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
}


def _missing(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column as rows ``(column_name, n_null)``."""
    counts = df.agg(*[F.count_if(_missing(f)).alias(f.name) for f in df.schema.fields])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, non-null values and type of every column, in column order."""
    fields = df.schema.fields
    present = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count_if(~_missing(f)).alias("n_non_null"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(F.array(*present).alias("columns")).select(F.inline("columns"))


def hour_profile(df: DataFrame, how: str, spec: SeriesSpec = PANEL) -> DataFrame:
    """Target aggregated by hour of day, with its rank from the highest down.

    Rows without a timestamp are left out.
    """
    grouped = (
        df.withColumn("hour", F.hour(spec.ts))
        .where(F.col("hour").isNotNull())
        .groupBy(spec.key, "hour")
        .agg(AGGREGATES[how](F.col(spec.value)).alias(spec.value))
    )
    # Rounded, as the last digits of a sum depend on its order.
    by_size = Window.partitionBy(spec.key).orderBy(F.desc(F.round(spec.value, 9)), "hour")
    return grouped.withColumn("rank", F.row_number().over(by_size))


def first_rows(df: DataFrame, k: int, spec: SeriesSpec = PANEL, last: bool = False) -> DataFrame:
    """The first (or last) ``k`` rows of each series, numbered in ``place`` from 0.

    Spark cuts each map task's rows to ``k`` per series before the shuffle.
    """
    order = [F.desc(c) if last else F.asc(c) for c in spec.order_by]
    w = Window.partitionBy(spec.key).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(w))
        .where(F.col("_place") <= k)
        .withColumn("place", (F.col("_place") - 1).cast("bigint"))
        .drop("_place")
    )


def preview(df: DataFrame, k: int = 5, spec: SeriesSpec = PANEL) -> DataFrame:
    """First ``k`` rows then last ``k`` rows; short series show rows twice."""
    head = first_rows(df, k, spec).withColumn("part", F.lit("head"))
    tail = first_rows(df, k, spec, last=True).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def target_mean(df: DataFrame, spec: SeriesSpec = PANEL) -> DataFrame:
    """Mean of the target per series and part: the simplest benchmark."""
    return df.groupBy(spec.key, "split").agg(F.avg(spec.value).alias("mean_value"))


def line_extract(df: DataFrame, feature: str, spec: SeriesSpec = PANEL) -> DataFrame:
    """One feature over time, ready to draw."""
    return df.select(spec.key, spec.ts, F.col(feature).alias("y")).orderBy(spec.key, spec.ts)


def line_buckets(df: DataFrame, feature: str, step: str, spec: SeriesSpec = PANEL) -> DataFrame:
    """A feature thinned to min, mean and max per time step, for long series."""
    return df.groupBy(spec.key, F.window(spec.ts, step)["start"].alias(spec.ts)).agg(
        F.min(feature).alias("y_min"), F.avg(feature).alias("y_avg"), F.max(feature).alias("y_max")
    )
