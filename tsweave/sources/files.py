"""Reading and writing series as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tsweave.spec import PANEL, SeriesSpec

# Fixed value: keeps microseconds, which the default pattern would cut.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Columns of the telemetry layout that are not plain doubles.
TELEMETRY_TYPES = {
    "_c0": "bigint",
    "MAC": "string",
    "weekday": "int",
    "fecha_servidor": "timestamp_ntz",
    "fecha_esp32": "timestamp_ntz",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Types are inferred (a second pass) without a schema."""
    reader = spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd[ ]['T'][HH:mm:ss][.SSSSSS]")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_quoted_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """CSV in which every header and value is wrapped in literal quotes.

    Quotes are stripped from names and values. Columns get the type named in
    ``types``, all others become double; values that do not fit become null.
    """
    types = TELEMETRY_TYPES if types is None else types
    raw = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)

    def typed(name: str) -> Column:
        bare = name.strip('"')
        text = F.trim(F.regexp_replace(F.col(f"`{name}`"), '^"|"$', ""))
        return text.try_cast(types.get(bare, "double")).alias(bare)

    return raw.select(*[typed(c) for c in raw.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column, also in columns not used later.

    This has to come before projecting, and so it reads every column.
    """
    return df.na.drop("any")


def to_panel(
    df: DataFrame,
    ts: Column,
    value: Column,
    seq: Column,
    key: Column | None = None,
    spec: SeriesSpec = PANEL,
) -> DataFrame:
    """Project any table to the panel columns; one series if there is no key."""
    key = F.lit("series") if key is None else key
    return df.select(
        key.cast("string").alias(spec.key),
        ts.alias(spec.ts),
        seq.cast("bigint").alias(spec.seq),
        value.cast("double").alias(spec.value),
    )


def combine(frames: dict[str, DataFrame], spec: SeriesSpec = PANEL) -> DataFrame:
    """Many datasets as one panel; each name goes in front of its series keys."""
    out = None
    for name, frame in frames.items():
        named = frame.select(*spec.columns).withColumn(spec.key, F.concat(F.lit(name + "/"), F.col(spec.key)))
        out = named if out is None else out.unionByName(named)
    return out


def write_series(df: DataFrame, path: str, fmt: str = "parquet", spec: SeriesSpec = PANEL) -> None:
    """Write a panel with its timestamp as the first column."""
    ordered = df.select(spec.ts, *[c for c in df.columns if c != spec.ts])
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path)
    else:
        writer.format(fmt).save(path)


def read_series(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read what ``write_series`` wrote. CSV needs the schema, timestamp first."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.format(fmt).load(path)
