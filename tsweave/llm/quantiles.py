"""Exact quantiles of any number of rows in bounded memory."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Parts into which an interval is cut in each round.
BINS = 4096
KINDS = (pa.string(), pa.int32(), pa.float64(), pa.float64())


def order_statistics(values: DataFrame, shares: list[float]) -> dict[str, tuple[int, list[float]]]:
    """For each ``group`` of ``values`` (``group, value``): its rows and, for each share, the value of that rank.

    The rank of share ``q`` among ``n`` rows is ``floor(q * (n - 1))`` from 0 for shares up to a half and rounded
    up above. Null and not-a-number values are left out. Each round cuts the interval that holds a rank
    into bins and goes on with one bin, between its least and its greatest value, until these are equal;
    a task holds at most ``BINS`` sums for each group and share. The groups are to be few.
    """
    rows = values.where("value IS NOT NULL AND NOT isnan(value)").select("group", F.col("value").cast("double").alias("value"))
    whole = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    counts = {r["group"]: r["n"] for r in whole}
    found: dict[tuple[str, int], float] = {}
    #: Interval and rank within it for each group and share.
    wanted = {}
    for r in whole:
        for k, share in enumerate(shares):
            exact = share * (r["n"] - 1)
            wanted[r["group"], k] = (r["low"], r["high"], math.floor(exact) if share <= 0.5 else math.ceil(exact))
    while True:
        for key, (low, high, _) in list(wanted.items()):
            if low == high:
                found[key] = low
                del wanted[key]
        if not wanted:
            break
        # An Arrow table needs no Python worker to be read; a list would start one more kind on every executor.
        targets = values.sparkSession.createDataFrame(
            pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*key, low, high) for key, (low, high, _) in wanted.items())), KINDS)], ["group", "share", "low", "high"])
        )
        place = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        bins = (
            rows.join(F.broadcast(targets), "group")
            .where("value BETWEEN low AND high")
            .groupBy("group", "share", place.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
            .collect()
        )
        for key, (_, _, rank) in list(wanted.items()):
            for b in sorted((b for b in bins if (b["group"], b["share"]) == key), key=lambda b: b["bin"]):
                if rank < b["n"]:
                    wanted[key] = (b["least"], b["most"], rank)
                    break
                rank -= b["n"]
    return {group: (n, [found[group, k] for k in range(len(shares))]) for group, n in counts.items()}
