"""Positions and windows over a panel of series, whatever the length of each.

Most panels hold many series of moderate length, and one window partition per
series is the best plan: one shuffle by key, shared by every window expression.
A series too long for one task is cut into blocks of consecutive positions.
Positional operators do not see the difference: they call :meth:`Panel.over`
with the number of earlier rows they look back at, and a cut series lends each
block that many rows from the blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tsweave.session import materialise
from tsweave.spec import PANEL, SeriesSpec

# Rows of one series that one task may hold; longer series are cut.
MAX_ROWS_PER_SERIES = 1_000_000
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 1_000, 1_000_000
# monotonically_increasing_id holds the partition in the bits above these.
ID_BITS = 33


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def join_series(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on the series key, the first of ``keys``, and equal others; a null key is a series like any other."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    on = left[keys[0]].eqNullSafe(other[names[keys[0]]])
    for k in keys[1:]:
        on = on & (left[k] == other[names[k]])
    return left.join(other, on, how).drop(*names.values())


@dataclass(frozen=True)
class Panel:
    """Rows of many series with their position ``pos`` and series length ``n``.

    ``whole`` holds the series that fit one task each, ``cut`` the rows of
    longer ones with their block number in ``_block``; either may be missing.
    Operators work on both and results are put together in ``df``. Rows with a
    null key are one series.
    """

    whole: DataFrame | None
    cut: DataFrame | None = None
    spec: SeriesSpec = PANEL
    block_rows: int = MAX_BLOCK_ROWS
    # Rows per cut series: a small table.
    lengths: DataFrame | None = None

    @classmethod
    def of(
        cls,
        df: DataFrame,
        spec: SeriesSpec = PANEL,
        layout: str = "auto",
        max_rows: int = MAX_ROWS_PER_SERIES,
        block_rows: int | None = None,
    ) -> Panel:
        """Give every row its position.

        ``layout="auto"`` counts the rows of each series (one pass over the key
        column) and cuts only those above ``max_rows``. ``"series"`` skips the
        count, for series whose length is bounded by construction (one row per
        day or hour). ``"blocks"`` cuts every series.
        """
        whole = None
        if layout == "series":
            return cls(_place_whole(df, spec), spec=spec)
        if layout == "blocks":
            long_rows, total = df, df.count()
        elif layout == "auto":
            counts = df.groupBy(spec.key).agg(F.count(F.lit(1)).alias("_rows"))
            longest = counts.agg(F.max("_rows")).first()[0]
            if longest is None or longest <= max_rows:
                return cls(_place_whole(df, spec), spec=spec)
            # At most (all rows / max_rows) keys can be this long.
            long_keys = materialise(counts.where(F.col("_rows") > max_rows), "long-series")
            total = long_keys.agg(F.sum("_rows")).first()[0]
            long_rows = join_series(df, long_keys.select(spec.key), [spec.key], "left_semi")
            whole = _place_whole(join_series(df, long_keys.select(spec.key), [spec.key], "left_anti"), spec)
        else:
            raise ValueError(f"unknown layout {layout!r}")

        slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if block_rows is None:
            block_rows = min(max(total // (2 * slots), MIN_BLOCK_ROWS), MAX_BLOCK_ROWS)
        ranges = max(min(slots, total // MIN_BLOCK_ROWS), -(-total // MAX_BLOCK_ROWS), 1)
        placed, lengths = _place_cut(long_rows, spec, ranges)
        return cls(whole, placed.withColumn("_block", _div(F.col("pos"), block_rows)), spec, block_rows, lengths)

    @property
    def df(self) -> DataFrame:
        """All rows as one frame."""
        if self.cut is None:
            return self.whole
        cut = self.cut.drop("_block")
        return cut if self.whole is None else self.whole.unionByName(cut)

    def rows(self, *columns: str | Column) -> DataFrame:
        """All rows, or the given columns of them."""
        return self.df.select(*columns) if columns else self.df

    def _each(self, on_whole: Callable[[DataFrame], DataFrame], on_cut: Callable[[DataFrame], DataFrame]) -> Panel:
        return replace(
            self,
            whole=None if self.whole is None else on_whole(self.whole),
            cut=None if self.cut is None else on_cut(self.cut),
        )

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Panel:
        """Apply a function that works row by row and keeps the panel's columns.

        Rows it drops leave holes in the positions; see :meth:`renumber`.
        """
        return self._each(change, change)

    def written(self, name: str) -> Panel:
        """The same rows, written once to the shared folder."""
        return self.map(lambda d: materialise(d, name))

    def where(self, condition: Column) -> Panel:
        """Keep some rows; positions and lengths stay those of the whole series."""
        return self.map(lambda d: d.where(condition))

    def with_columns(self, columns: dict[str, Column]) -> Panel:
        return self.map(lambda d: d.withColumns(columns))

    def select(self, *columns: str | Column) -> Panel:
        """Keep these columns and what positions need."""
        kept = [self.spec.key, *self.spec.order_by, "pos", "n"]
        names = [c for c in dict.fromkeys(kept) if c not in columns]
        return self._each(lambda d: d.select(*names, *columns), lambda d: d.select(*names, "_block", *columns))

    def over(self, history: int, build: Callable[[WindowSpec], dict[str, Column]]) -> Panel:
        """Add the columns ``build(w)`` makes on an ordered window of the series.

        ``history`` is how many rows before its own the furthest expression
        reads. Expressions must not read rows after their own.
        """
        key, own, pos = self.spec.key, F.col("_block"), F.col("pos")

        def on_whole(df: DataFrame) -> DataFrame:
            return df.withColumns(build(Window.partitionBy(key).orderBy(*self.spec.order_by)))

        def on_cut(df: DataFrame) -> DataFrame:
            last = _div(F.col("n") - 1, self.block_rows)
            reach = F.greatest(own, F.least(_div(pos + history, self.block_rows), last))
            lent = df.withColumn("_into", F.explode(F.sequence(own, reach)))
            w = Window.partitionBy(key, "_into").orderBy("pos")
            return lent.withColumns(build(w)).where(F.col("_into") == own).drop("_into")

        return self._each(on_whole, on_cut)

    def attach(self, stats: DataFrame) -> Panel:
        """Join one row of statistics per series onto all its rows.

        A cut series joins block by block, so its rows stay spread out.
        """
        key = self.spec.key

        def on_cut(df: DataFrame) -> DataFrame:
            blocks = F.sequence(F.lit(0).cast("bigint"), _div(F.col("_rows") - 1, self.block_rows))
            spread = join_series(self.lengths, stats, [key], "inner").withColumn("_block", F.explode(blocks)).drop("_rows")
            return join_series(df, spread, [key, "_block"])

        return self._each(lambda df: join_series(df, stats, [key]), on_cut)

    def with_series_stats(self, **aggregates: Column) -> Panel:
        """Add aggregates over the whole series to each of its rows."""
        key = self.spec.key
        everything = (
            Window.partitionBy(key)
            .orderBy(*self.spec.order_by)
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        out = self
        if self.cut is not None:
            stats = self.cut.groupBy(key).agg(*[a.alias(name) for name, a in aggregates.items()])
            out = replace(self, whole=None).attach(stats)
        if self.whole is None:
            return out
        whole = self.whole.withColumns({name: agg.over(everything) for name, agg in aggregates.items()})
        return replace(out, whole=whole)

    def renumber(self) -> Panel:
        """Give the rows that are left new positions, after some were dropped."""
        key = self.spec.key

        def on_cut(df: DataFrame) -> DataFrame:
            sizes = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_size"))
            local = Window.partitionBy(key, "_block").orderBy("pos")
            place = F.col("_before") + F.col("_rank") - 1
            ranked = df.drop("n").withColumn("_rank", F.row_number().over(local))
            return (
                join_series(ranked, _offsets(sizes, key, "_block"), [key, "_block"], "inner")
                .withColumns({"pos": place, "_block": _div(place, self.block_rows)})
                .drop("_rank", "_before")
            )

        return self._each(lambda df: _place_whole(df.drop("pos", "n"), self.spec), on_cut)


def _offsets(sizes: DataFrame, key: str, piece: str) -> DataFrame:
    """Rows before each piece of a series (``_before``) and in all of it (``n``)."""
    series = Window.partitionBy(key)
    return sizes.withColumns(
        {
            "_before": F.sum("_size").over(series.orderBy(piece)) - F.col("_size"),
            "n": F.sum("_size").over(series),
        }
    ).drop("_size")


def _place_whole(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    w = Window.partitionBy(spec.key).orderBy(*spec.order_by)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {
            "pos": F.row_number().over(w).cast("bigint") - 1,
            "n": F.count(F.lit(1)).over(everything),
        }
    )


def _place_cut(df: DataFrame, spec: SeriesSpec, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Positions without ever bringing a whole series into one task.

    Rows are sorted across ``ranges`` range partitions on (key, order) and
    numbered inside each. The numbers are written down with the rows, since the
    ranges could differ if the plan ran again. A row's position is its place
    among the rows of its series in the same range, plus the rows of the series
    in earlier ranges. There is at most one row of offsets per range and
    series, about as many as ranges, so that join is usually a broadcast.
    """
    key = spec.key
    at = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(ranges, key, *spec.order_by).sortWithinPartitions(key, *spec.order_by)
    ranged = materialise(ordered.withColumn("_at", at), "ranges").withColumn(
        "_range", F.shiftright("_at", ID_BITS)
    )
    sizes = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    offsets = materialise(_offsets(sizes, key, "_range"), "offsets")
    placed = (
        join_series(ranged, offsets, [key, "_range"], "inner")
        .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_range", "_at", "_before", "_first")
    )
    return placed, offsets.groupBy(key).agg(F.max("n").alias("_rows"))
