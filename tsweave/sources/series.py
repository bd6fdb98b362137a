"""Panels drawn from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsweave.sources.files import to_panel


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user."""
    ev = table(spark, folder, "events")
    return to_panel(ev, F.col("ts"), F.col("value"), F.col("event_id"), F.col("user_id"))


def all_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events as one long series."""
    ev = table(spark, folder, "events")
    return to_panel(ev, F.col("ts"), F.col("value"), F.col("event_id"), F.lit("all"))


def hourly_type(spark: SparkSession, folder: str) -> DataFrame:
    """Per event type and hour: min, max and mean, in the telemetry's columns."""
    ev = table(spark, folder, "events")
    return ev.groupBy(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ).agg(
        F.min("value").alias("min cpu"), F.max("value").alias("max cpu"), F.avg("value").alias("avg cpu")
    )


def hourly_avg(spark: SparkSession, folder: str) -> DataFrame:
    """The mean column of ``hourly_type`` as a panel."""
    return to_panel(hourly_type(spark, folder), F.col("ts"), F.col("avg cpu"), F.lit(0), F.col("series_id"))


def _orders_by(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    sums = orders.groupBy(F.date_trunc(unit, "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("o_totalprice").alias("value")
    )
    return to_panel(sums, F.col("ts"), F.col("value"), F.lit(0), F.lit("orders"))


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _orders_by(spark, folder, "day")


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _orders_by(spark, folder, "month")


def _pick(which: Column, options: list[Column]) -> Column:
    out = F.when(which == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(which == i, option)
    return out


# Date layouts of the messy date column, as Spark writes them.
TEXT_DATE_LAYOUTS = [
    "MMM-yy", "yyyy-MM-dd", "dd-MM-yyyy", "M/d/yyyy", "yyyy/MM/dd", "MMMM d, yyyy",
    "dd-MMM-yyyy", "MMM d, yyyy", "yyyy-MM", "MM/yyyy", "MMMM yyyy", "yyyy-MM-dd HH:mm",
    "dd-MM-yyyy HH:mm:ss", "MM/dd/yyyy hh:mm a", "yyyy-MM-dd'T'HH:mm:ss",
    "EEEE, MMMM d, yyyy", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
]


def date_text() -> Column:
    """Event times written in many layouts, and some text that is no date."""
    texts = [F.date_format("ts", layout) for layout in TEXT_DATE_LAYOUTS]
    texts += [F.lit("not a date"), F.lit(None).cast("string")]
    return _pick(F.col("event_id") % len(texts), texts)


def text_dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts").withColumn("text", date_text())


def number_text() -> Column:
    """Event values written with currency, separators, percent, sign or as no number."""
    plain = F.col("value").cast("decimal(18,2)").cast("string")
    texts = [
        F.concat(F.lit("$"), plain), F.concat(F.lit("1,"), F.lpad(plain, 6, "0")), F.concat(plain, F.lit("%")),
        F.concat(F.lit("-"), plain), F.lit("N/A"), plain, F.concat(plain, F.lit("e-05")), F.lit("1.2.3"),
        F.lit("."), F.lit(None).cast("string"),
    ]
    return _pick(F.col("event_id") % len(texts), texts)


def text_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "value").withColumn("text", number_text())
