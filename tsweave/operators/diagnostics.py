"""Autocorrelation and stationarity."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tsweave.operators.moments import Batch, difference_weights, lag_products, regress
from tsweave.operators.panel import Panel

# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
ACF_LAGS = 20
SIGNIFICANCE = 0.05

# Response surface of the unit-root test with a constant.
TAU_MIN, TAU_MAX, TAU_SPLIT = -18.83, 2.74, -1.61
SMALL_TAU = (2.1659, 1.4412, 0.038269)
LARGE_TAU = (1.7339, 0.93202, -0.12745, -0.010368)


def _correlations() -> Column:
    c0 = F.element_at("products", 1)
    return F.transform("products", lambda c: F.try_divide(c, c0))


def acf(panel: Panel, lags: int = ACF_LAGS, rows: Column | None = None) -> DataFrame:
    """Autocorrelation up to ``lags`` with its 95 % band, one row per lag.

    Lags a series is too short for are left out.
    """
    key = panel.spec.key
    sums = lag_products(panel, lags, rows, keep=0)
    out = sums.select(key, "m", _correlations().alias("r")).select(key, "m", "r", F.posexplode("r").alias("lag", "acf"))
    earlier = F.aggregate(F.slice("r", F.lit(2), F.greatest(F.col("lag") - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + r * r)
    band = F.when(F.col("lag") > 0, F.lit(Z95) * F.sqrt((1 + 2 * earlier) / F.col("m"))).otherwise(0.0)
    return out.where(F.col("lag") < F.col("m")).select(key, "lag", "acf", band.alias("band"))


def pacf(panel: Panel, lags: int = ACF_LAGS, rows: Column | None = None) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the ACF.

    Each step keeps the coefficients of the regression on k lags; the last of
    them is the partial autocorrelation at k.
    """
    key = panel.spec.key
    sums = lag_products(panel, lags, rows, keep=0).select(key, "m", _correlations().alias("r"))
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi, r = state["phi"], F.col("r")
        past = F.slice(r, F.lit(2), k - 1)
        last = F.try_divide(F.element_at(r, k + 1) - dot(phi, F.reverse(past)), 1 - dot(phi, past))
        longer = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last))
        return F.struct(longer.alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step, lambda s: s["out"])
    return (
        sums.select(key, "m", F.posexplode(steps).alias("lag", "pacf"))
        .where(F.col("lag") < F.col("m"))
        .select(key, "lag", "pacf", F.when(F.col("lag") > 0, F.lit(Z95) / F.sqrt("m")).otherwise(0.0).alias("band"))
    )


def default_adf_lags(m: int) -> int:
    """Largest number of lagged differences tried for a series of ``m`` rows."""
    return max(min(ceil(12 * (m / 100) ** 0.25), m // 2 - 2), 0)


def unit_root_p(tau: float) -> float:
    """P-value of the unit-root statistic, regression with a constant."""
    if np.isnan(tau):
        return np.nan
    if tau < TAU_MIN:
        return 0.0
    if tau > TAU_MAX:
        return 1.0
    terms = SMALL_TAU if tau <= TAU_SPLIT else LARGE_TAU
    z = sum(c * tau**k for k, c in enumerate(terms))
    return 0.5 * (1 + erf(z / sqrt(2)))


def _unit_root(batch: Batch, lags: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistic, AIC and row count of the test with ``lags`` lagged differences."""
    width = lags + 1
    moments = batch.moments(width, start)
    change = difference_weights(1, width)
    constant, level = np.eye(width + 2)[0], np.eye(width + 2)[2]
    design = np.vstack([level, constant, change[1 : lags + 1]])
    beta, sse, inverse = regress(moments, change[0], design)
    rows = moments[:, 0, 0]
    free = rows - len(design)
    with np.errstate(all="ignore"):
        tau = beta[:, 0] / np.sqrt(np.where(free > 0, sse / free, np.nan) * inverse[:, 0, 0])
        aic = rows * (np.log(2 * np.pi * sse / rows) + 1) + 2 * len(design)
    bad = ~(sse > 0) | ~(free > 0)
    tau[bad], aic[bad] = np.nan, np.nan
    return tau, aic, rows


def adf(panel: Panel, lags: int | None = None, rows: Column | None = None, autolag: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test of each series, with a constant.

    ``lags`` is the number of lagged differences, or with ``autolag`` the
    largest number tried, the one of lowest AIC on a common sample being used.
    None picks the largest from the length of each series. A series is called
    stationary when p is not above 0.05.
    """
    key = panel.spec.key
    if lags is None:
        length = F.col("n") if rows is None else rows
        longest = panel.df.agg(F.max(length)).first()[0] or 0
        # The rule is not monotone for tiny series, where m // 2 - 2 limits it.
        widest = max(default_adf_lags(int(longest)), 0)
    else:
        widest = lags
    sums = lag_products(panel, widest + 1, rows)

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            everything = Batch(pdf)
            upper = np.array([min(widest, default_adf_lags(int(m))) if lags is None else lags for m in everything.m])
            out = pdf[[key]].copy()
            for name in ("statistic", "p_value"):
                out[name] = np.nan
            out["lags"], out["n_rows"] = 0, 0
            for top in np.unique(upper):
                which = np.flatnonzero(upper == top)
                batch = everything.select(which)
                used = np.full(len(which), top)
                if autolag and top > 0:
                    scores = np.stack([_unit_root(batch, k, top + 1)[1] for k in range(top + 1)])
                    used = np.argmin(np.where(np.isnan(scores), np.inf, scores), axis=0)
                for k in np.unique(used):
                    at = used == k
                    tau, _, n_rows = _unit_root(batch.select(at), int(k), int(k) + 1)
                    place = which[at]
                    out.iloc[place, 1] = tau
                    out.iloc[place, 2] = [unit_root_p(t) for t in tau]
                    out.iloc[place, 3] = int(k)
                    out.iloc[place, 4] = np.nan_to_num(n_rows).astype(int)
            yield out

    kind = panel.df.schema[key].dataType.simpleString()
    found = sums.mapInPandas(test, f"{key} {kind}, statistic double, p_value double, lags bigint, n_rows bigint")
    p = F.when(~F.isnan("p_value"), F.col("p_value"))
    return found.select(
        key,
        F.when(~F.isnan("statistic"), F.col("statistic")).alias("statistic"),
        p.alias("p_value"), "lags", "n_rows",
        (p <= SIGNIFICANCE).alias("stationary"),
    )
