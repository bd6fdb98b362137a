"""Lag products: one pass over a panel that every linear fit can start from.

Every least-squares fit on lags of a series needs sums of products
y[t-i] * y[t-j]. Those sums depend almost only on j - i: shifting both by one
adds one product at one end and drops one at the other. So the sums for
i = 0 plus the first and last values of the series give all of them, for any
lag order, any differencing and any first row. Spark makes one small row per
series (map-side combined, so a long series is no burden); the solvers then
work on those rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tsweave.operators.panel import Panel, join_series

# Up to here every lag is its own aggregate; beyond, blocks are transformed.
MAX_LAG_COLUMNS = 48
# Least rows of a block that one task transforms at once.
FFT_BLOCK_ROWS = 1 << 16


def lag_products(panel: Panel, max_lag: int, rows: Column | None = None, keep: int | None = None) -> DataFrame:
    """One row per series: what least squares on up to ``max_lag`` lags needs.

    ``rows`` limits each series to its first rows (the train part). Columns:
    ``m`` rows, ``present`` non-null values, ``centre`` their mean, ``total``
    the sum of u = value - centre, ``products[k]`` the sum of u[t]*u[t-k],
    ``head[i]`` = u[i] and ``tail[i]`` = u[m-1-i].
    """
    spec = panel.spec
    m = F.col("n") if rows is None else rows
    keep = keep if keep is not None else max_lag + 1
    part = panel.with_columns({"_m": m}).where(F.col("pos") < F.col("_m"))
    part = part.with_series_stats(_centre=F.avg(spec.value))
    part = part.with_columns({"_u": F.col(spec.value) - F.col("_centre")})
    part = part.select("_m", "_centre", "_u")
    u = F.col("_u")
    base = [
        F.count(F.lit(1)).alias("m"),
        F.count("_u").alias("present"),
        F.max("_centre").alias("centre"),
        F.sum("_u").alias("total"),
    ]
    if max_lag <= MAX_LAG_COLUMNS:
        lagged = part.over(max_lag, lambda w: {f"_u{k}": F.lag("_u", k).over(w) for k in range(1, max_lag + 1)})
        products = [F.sum(u * u), *[F.sum(u * F.col(f"_u{k}")) for k in range(1, max_lag + 1)]]
        from_end = F.col("_m") - 1 - F.col("pos")
        sums = lagged.df.groupBy(spec.key).agg(
            *base,
            *[p.alias(f"_p{k}") for k, p in enumerate(products)],
            *[F.max(F.when(F.col("pos") == i, u)).alias(f"_h{i}") for i in range(keep)],
            *[F.max(F.when(from_end == i, u)).alias(f"_t{i}") for i in range(keep)],
        )
        arrays = {
            "products": F.array(*[F.coalesce(f"_p{k}", F.lit(0.0)) for k in range(max_lag + 1)]),
            "head": F.array(*[F.col(f"_h{i}") for i in range(keep)]),
            "tail": F.array(*[F.col(f"_t{i}") for i in range(keep)]),
        }
        return sums.select(spec.key, "m", "present", "centre", "total", *[a.alias(k) for k, a in arrays.items()])

    sums = part.df.groupBy(spec.key).agg(*base)
    products = (
        _block_products(part.df.select(spec.key, "pos", "_u"), spec.key, max_lag)
        .groupBy(spec.key, "k")
        .agg(F.sum("p").alias("p"))
        .groupBy(spec.key)
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("_p"))
    )
    from_end = F.col("_m") - 1 - F.col("pos")
    ends = (
        part.df.where((F.col("pos") < keep) | (from_end < keep))
        .groupBy(spec.key)
        .agg(
            F.map_from_entries(F.collect_list(F.when(F.col("pos") < keep, F.struct("pos", "_u")))).alias("_h"),
            F.map_from_entries(F.collect_list(F.when(from_end < keep, F.struct(from_end, "_u")))).alias("_t"),
        )
    )

    def as_array(entries: str, size: int, kind: str) -> Column:
        if not size:
            return F.array().cast("array<double>")
        places = F.sequence(F.lit(0).cast(kind), F.lit(size - 1).cast(kind))
        return F.transform(places, lambda i: F.try_element_at(F.col(entries), i))

    found = join_series(join_series(sums, products, [spec.key], "left"), ends, [spec.key], "left")
    return found.select(
        spec.key, "m", "present", "centre", "total",
        F.transform(as_array("_p", max_lag + 1, "int"), lambda p: F.coalesce(p, F.lit(0.0))).alias("products"),
        as_array("_h", keep, "bigint").alias("head"),
        as_array("_t", keep, "bigint").alias("tail"),
    )


def _block_products(rows: DataFrame, key: str, max_lag: int) -> DataFrame:
    """``key, k, p``: for each block of consecutive positions the sums of u[t]*u[t-k], t in the block, k up to ``max_lag``.

    ``rows`` has ``key, pos, _u``. A block is lent the ``max_lag`` rows before it, and its products with all of
    them come from one Fourier transform, so a row costs the logarithm of the block's length and not
    one product a lag. Nulls and missing positions count as zero.
    """
    # Blocks at least as long as the lags lend to the next one alone, and at least half of what a task reads is its own.
    size = max(FFT_BLOCK_ROWS, max_lag)
    own = F.floor(F.col("pos") / size)
    dealt = F.when(F.col("pos") % size >= size - max_lag, F.array(own, own + 1)).otherwise(F.array(own))
    kind = rows.schema[key].dataType.simpleString()

    def products(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        at = table.column("pos").to_numpy() - block * size + max_lag
        u = np.nan_to_num(table.column("_u").to_numpy())
        if at.max() < max_lag:  # lent rows alone: the series ends before this block
            at = at[:0]
            u = u[:0]
        first = at.min() if len(at) else 0
        both = np.zeros(at.max() - first + 1 if len(at) else 1)
        both[at - first] = u
        here = both.copy()
        here[: max(0, max_lag - first)] = 0.0
        width = 1 << int(len(both) + max_lag - 1).bit_length()
        sums = np.fft.irfft(np.fft.rfft(here, width) * np.conj(np.fft.rfft(both, width)), width)
        lags = np.arange(min(max_lag, len(both) - 1) + 1)
        name = pa.array([table.column(key)[0].as_py()], table.schema.field(key).type).take(pa.array(np.zeros(len(lags), np.int64)))
        return pa.table({key: name, "k": pa.array(lags.astype(np.int32)), "p": pa.array(sums[lags])})

    return rows.withColumn("_block", F.explode(dealt)).groupBy(key, "_block").applyInArrow(products, f"`{key}` {kind}, k int, p double")


class Batch:
    """Lag products of many series as numpy arrays, one row per series."""

    def __init__(self, pdf):
        def stack(name: str) -> np.ndarray:
            return np.array([np.asarray(a, dtype=float) for a in pdf[name]]).reshape(len(pdf), -1)

        self.m = pdf["m"].to_numpy(dtype=float)
        self.complete = pdf["present"].to_numpy() == pdf["m"].to_numpy()
        self.centre = pdf["centre"].to_numpy(dtype=float)
        self.total = pdf["total"].to_numpy(dtype=float)
        self.products, self.head, self.tail = stack("products"), stack("head"), stack("tail")

    def select(self, rows: np.ndarray) -> Batch:
        part = object.__new__(Batch)
        part.__dict__.update({k: v[rows] for k, v in self.__dict__.items()})
        return part

    def moments(self, lags: int, start: int) -> np.ndarray:
        """Sums over t = start..m-1 of v v' with v = (1, u[t], ..., u[t-lags]).

        Series with too few rows give NaN. ``start`` must be at least ``lags``.
        """
        head, tail = np.nan_to_num(self.head), np.nan_to_num(self.tail)
        out = np.empty((len(self.m), lags + 2, lags + 2))
        out[:, 0, 0] = self.m - start
        for i in range(lags + 1):
            out[:, 0, i + 1] = self.total - head[:, : start - i].sum(axis=1) - tail[:, :i].sum(axis=1)
            for j in range(i, lags + 1):
                k = j - i
                early = (head[:, k : start - i] * head[:, : start - i - k]).sum(axis=1) if start - i > k else 0.0
                late = (tail[:, :i] * tail[:, k : i + k]).sum(axis=1)
                out[:, i + 1, j + 1] = self.products[:, k] - early - late
        upper = np.triu(np.ones((lags + 2, lags + 2), dtype=bool))
        full = np.where(upper, out, 0.0)
        full = full + np.transpose(np.triu(full, 1), (0, 2, 1))
        full[(self.m - start < 1) | ~self.complete] = np.nan
        return full


def solve(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve many small normal equations; singular ones give NaN.

    Returns the coefficients and the inverse matrices.
    """
    size = gram.shape[-1]
    if size == 0:
        return np.zeros((len(gram), 0)), gram
    diagonal = np.einsum("bii->bi", gram)
    good = np.isfinite(gram).all(axis=(1, 2)) & (diagonal > 0).all(axis=1)
    unit = np.where(good[:, None], np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 1.0)
    scaled = np.where(good[:, None, None], gram / unit[:, :, None] / unit[:, None, :], np.eye(size))
    good &= np.linalg.eigvalsh(scaled)[:, 0] > 1e-11
    scaled[~good] = np.eye(size)
    inverse = np.linalg.inv(scaled) / unit[:, :, None] / unit[:, None, :]
    beta = np.einsum("bij,bj->bi", inverse, np.nan_to_num(right))
    beta[~good] = np.nan
    inverse[~good] = np.nan
    return beta, inverse


def difference_weights(order: int, lags: int) -> np.ndarray:
    """Rows that turn (1, u[t], ..., u[t-lags]) into lags 0, 1, ... of the difference."""
    weights = np.array([1.0])
    for _ in range(order):
        weights = np.convolve(weights, [1.0, -1.0])
    rows = np.zeros((lags - order + 1, lags + 2))
    for i in range(len(rows)):
        rows[i, 1 + i : 2 + i + order] = weights
    return rows


def regress(moments: np.ndarray, target: np.ndarray, design: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of ``target`` on ``design``, both as weights on the lag vector.

    Weights have shape (size,) or (batch, size) for the target and
    (k, size) or (batch, k, size) for the design. Returns coefficients, the sum
    of squared errors and the inverse of the normal matrix.
    """
    batch, size = len(moments), moments.shape[-1]
    target = np.broadcast_to(target, (batch, size))
    design = np.broadcast_to(design, (batch, *np.shape(design)[-2:]))
    gram = design @ moments @ np.transpose(design, (0, 2, 1))
    right = np.einsum("bki,bij,bj->bk", design, moments, target)
    total = np.einsum("bi,bij,bj->b", target, moments, target)
    beta, inverse = solve(gram, right)
    return beta, total - np.einsum("bk,bk->b", beta, right), inverse
