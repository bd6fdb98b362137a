"""Rows that a set of keys concerns, told apart from all others without a shuffle of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsweave.llm.exact_dedup import bitmap, marked

#: Columns that are added and dropped again.
MARK, FLAG = "apart_key_mark", "apart_is_key"


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is surely not in ``keys`` (``key``, distinct, written), and the rest, which may be in it.

    A bitmap of the keys, of bounded size, is broadcast. A null key is in no set.
    """
    bits, size = bitmap(keys.select(F.xxhash64(key).alias("key")), keys.count())
    bit_row, hit = marked(MARK, size)
    named = rows.withColumn(MARK, F.xxhash64(key)).withColumn("bit_row", bit_row).join(F.broadcast(bits), "bit_row", "left")
    told = named.withColumn(FLAG, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop(MARK, "bit_row", "bit_set")
    return told.where(f"NOT {FLAG}").drop(FLAG), told.where(FLAG).drop(FLAG)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in ``keys``; only those that the bitmap marks are shuffled."""
    rest, likely = parted(rows, keys, key)
    # An anti join would be pushed down below the bitmap.
    gone = keys.select(key).withColumn(FLAG, F.lit(True)).hint("merge")
    return rest.unionByName(likely.join(gone, key, "left").where(f"{FLAG} IS NULL").drop(FLAG))
