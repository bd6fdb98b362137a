"""ARIMA by regression: fit, order search, in-sample predictions, forecasts.

The fits are conditional least squares (moving-average terms by regression on
the residuals of a long autoregression), not exact likelihood. Given the
coefficients, the residuals of in-sample predictions and the errors that a
forecast starts from are those of the moving-average recursion itself, worked
out by a parallel scan. AIC values are
therefore close to, not equal to, those of a likelihood fit, and the chosen
order can differ on near ties. All orders of a series come from one row of lag
products, so the search over 48 orders is a single pass over the panel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tsweave.operators.moments import Batch, difference_weights, lag_products, regress
from tsweave.operators.panel import Panel, join_series

# The orders searched by default.
P_VALUES, D_VALUES, Q_VALUES = range(4), range(3), range(4)
# Extra lags of the autoregression that estimates the residuals.
LONG_AR_EXTRA = 4
# Forecast steps that one row carries through one recursion.
STEPS_PER_ROW = 1_000

FIT_FIELDS = (
    "p int, d int, q int, aic double, sse double, n_rows bigint, intercept double, "
    "phi array<double>, theta array<double>, long_intercept double, long_phi array<double>, "
    "z_last array<double>, e_last array<double>, levels array<double>"
)


def all_orders(p_values=P_VALUES, d_values=D_VALUES, q_values=Q_VALUES) -> list[tuple[int, int, int]]:
    return [(p, d, q) for p in p_values for d in d_values for q in q_values]


def _long_ar(orders: list[tuple[int, int, int]]) -> int:
    if not any(q for _, _, q in orders):
        return 0
    return max(max(p, q) for p, _, q in orders) + LONG_AR_EXTRA


def _needed_lags(orders: list[tuple[int, int, int]]) -> int:
    """Rows lost at the start of a series: the same for all orders compared."""
    long_ar = _long_ar(orders)
    return max(d + max(p, (q + long_ar) if q else 0) for p, d, q in orders)


def _fit_batch(batch: Batch, orders: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
    lags, long_ar = _needed_lags(orders), _long_ar(orders)
    moments = batch.moments(lags, lags)
    size, rows = lags + 2, moments[:, 0, 0]
    constant = np.eye(size)[0]
    tail = np.nan_to_num(batch.tail)
    for d in sorted({d for _, d, _ in orders}):
        z = difference_weights(d, lags)
        mean_term = constant[None, :] if d == 0 else np.zeros((0, size))
        n_const = len(mean_term)
        # The last values of the differenced series, newest first.
        z_tail = _difference_tail(tail, d)
        max_q = max(q for _, dd, q in orders if dd == d)
        if max_q:
            long_beta, _, _ = regress(moments, z[0], np.vstack([mean_term, z[1 : long_ar + 1]]))
            long_const = long_beta[:, 0] if n_const else np.zeros(len(rows))
            long_phi = long_beta[:, n_const:]
            residual = [
                z[j] - long_const[:, None] * constant - long_phi @ z[j + 1 : j + 1 + long_ar] for j in range(max_q + 1)
            ]
            e_tail = np.stack(
                [z_tail[:, j] - long_const - (long_phi * z_tail[:, j + 1 : j + 1 + long_ar]).sum(axis=1) for j in range(max_q)],
                axis=1,
            )
        for p, _, q in (o for o in orders if o[1] == d):
            fixed = np.broadcast_to(np.vstack([mean_term, z[1 : p + 1]]), (len(rows), n_const + p, size))
            design = np.concatenate([fixed, np.stack(residual[1 : q + 1], axis=1)], axis=1) if q else fixed
            beta, sse, _ = regress(moments, z[0], design)
            parameters = n_const + p + q + 1
            ok = (sse > 1e-12 * moments[:, 1, 1]) & (rows > n_const + p + q) & np.isfinite(beta).all(axis=1)
            with np.errstate(all="ignore"):
                aic = rows * np.log(sse / rows) + rows * (1 + np.log(2 * np.pi)) + 2 * parameters
            phi, theta = beta[:, n_const : n_const + p], beta[:, n_const + p :]
            # Coefficients are for centred values; give the intercept in units of the series.
            intercept, long_intercept = np.zeros(len(rows)), np.zeros(len(rows))
            z_last = z_tail[:, :p]
            if d == 0:
                intercept = beta[:, 0] + batch.centre * (1 - phi.sum(axis=1))
                z_last = z_last + batch.centre[:, None]
                if q:
                    long_intercept = long_const + batch.centre * (1 - long_phi.sum(axis=1))
            levels = np.zeros((len(rows), d))
            if d >= 1:
                levels[:, 0] = tail[:, 0] + batch.centre
            if d == 2:
                levels[:, 1] = tail[:, 0] - tail[:, 1]
            yield pd.DataFrame(
                {
                    "p": p, "d": d, "q": q,
                    "aic": np.where(ok, aic, np.nan),
                    "sse": np.where(np.isfinite(sse), sse, np.nan),
                    "n_rows": np.maximum(np.nan_to_num(rows), 0).astype(int),
                    "intercept": intercept,
                    "phi": list(phi), "theta": list(theta),
                    "long_intercept": long_intercept,
                    "long_phi": list(long_phi) if q else [np.zeros(0)] * len(rows),
                    "z_last": list(z_last),
                    "e_last": list(e_tail[:, :q]) if q else [np.zeros(0)] * len(rows),
                    "levels": list(levels),
                    "_solved": np.isfinite(beta).all(axis=1) & np.isfinite(rows),
                }
            )


def _difference_tail(tail: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        tail = tail[:, :-1] - tail[:, 1:]
    return tail


def _schema(sums: DataFrame, key: str) -> str:
    return f"{key} {sums.schema[key].dataType.simpleString()}, {FIT_FIELDS}, _solved boolean"


def fit_orders(panel: Panel, orders: list[tuple[int, int, int]], rows: Column | None = None) -> DataFrame:
    """Fit every order to every series, all on the same rows of the series.

    One row per series and order with AIC, coefficients and the values a
    forecast starts from. Orders that cannot be solved have null AIC.
    """
    key = panel.spec.key
    sums = lag_products(panel, _needed_lags(orders), rows)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            for part in _fit_batch(Batch(pdf), orders):
                part.insert(0, key, pdf[key].to_numpy())
                yield part

    fits = sums.mapInPandas(fit, _schema(sums, key))
    clean = {name: F.when(~F.isnan(name), F.col(name)) for name in ("aic", "sse")}
    for name in ("phi", "theta", "intercept"):
        clean[name] = F.when(F.col("_solved"), F.col(name))
    return fits.withColumns(clean).drop("_solved")


def arima_grid(
    panel: Panel, p_values=P_VALUES, d_values=D_VALUES, q_values=Q_VALUES, rows: Column | None = None
) -> DataFrame:
    """AIC of every order for every series."""
    fits = fit_orders(panel, all_orders(p_values, d_values, q_values), rows)
    return fits.select(panel.spec.key, "p", "d", "q", "aic")


def best_orders(grid: DataFrame, key: str) -> DataFrame:
    """The order of lowest AIC per series; the first in (p, d, q) wins ties."""
    scored = grid.where(F.col("aic").isNotNull())
    best = F.min(F.struct("aic", "p", "d", "q"))
    return scored.groupBy(key).agg(best.alias("_best")).select(key, "_best.p", "_best.d", "_best.q", "_best.aic")


def refit_best(panel: Panel, orders: list[tuple[int, int, int]], rows: Column | None = None) -> DataFrame:
    """Search the orders of each series and fit the best one again, in one pass.

    The search compares orders on rows that all of them can use; the final fit
    uses every row its own order can. ``search_aic`` is the AIC of the search.
    """
    key = panel.spec.key
    sums = lag_products(panel, _needed_lags(orders), rows)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            batch = Batch(pdf)
            tried = [(tuple(int(part[c].iloc[0]) for c in "pdq"), part["aic"].to_numpy()) for part in _fit_batch(batch, orders)]
            tried.sort(key=lambda t: t[0])
            scores = np.stack([np.where(np.isnan(aic), np.inf, aic) for _, aic in tried])
            best, lowest = scores.argmin(axis=0), scores.min(axis=0)
            for place in np.unique(best[np.isfinite(lowest)]):
                which = np.flatnonzero((best == place) & np.isfinite(lowest))
                for part in _fit_batch(batch.select(which), [tried[place][0]]):
                    part.insert(0, key, pdf[key].to_numpy()[which])
                    yield part.assign(search_aic=lowest[which])

    fits = sums.mapInPandas(fit, _schema(sums, key) + ", search_aic double")
    return fits.where("_solved").drop("_solved")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _push(values: Column, new: Column) -> Column:
    """Put ``new`` in front and keep the length."""
    return F.slice(F.concat(F.array(new), values), F.lit(1), F.size(values))


def _powers(fits: pd.DataFrame, p: int, q: int, d: int) -> np.ndarray:
    """Values, errors and levels of fits of one order after ``skip`` steps each: all fits at once, by squaring."""
    size, n = 1 + p + q + d, len(fits)
    a = np.zeros((n, size, size))
    a[:, 0, 0] = 1.0
    wide = lambda c, w: np.stack(fits[c].map(lambda x: np.asarray(x, float)).to_list()).reshape(n, w)
    following = np.concatenate([fits["intercept"].to_numpy(float)[:, None], wide("phi", p), wide("theta", q), np.zeros((n, d))], axis=1)
    if p:
        a[:, 1] = following
        a[:, 2 : 1 + p, 1:p] = np.eye(p - 1)
    if q > 1:
        a[:, 2 + p : 1 + p + q, 1 + p : p + q] = np.eye(q - 1)
    for i in reversed(range(d)):
        at = 1 + p + q + i
        a[:, at] = following if i == d - 1 else a[:, at + 1]
        a[:, at, at] += 1.0
    state = np.concatenate([np.ones((n, 1)), wide("z_last", p), wide("e_last", q), wide("levels", d)], axis=1)
    left = fits["skip"].to_numpy(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        state[odd] = np.einsum("nij,nj->ni", a[odd], state[odd])
        a, left = a @ a, left >> 1
    return state[:, 1:]


def _jump(fits: DataFrame, key: str) -> DataFrame:
    """Move each fit's starting values ``skip`` steps ahead.

    The recursion is linear, so many steps at once are a power of its matrix.
    This lets the steps of a very long forecast be worked out by many tasks.
    """

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ahead = np.flatnonzero((pdf["skip"].to_numpy() > 0) & pdf["phi"].notna().to_numpy())
            if len(ahead):
                pdf = pdf.reset_index(drop=True)
                shapes = pd.DataFrame({c: pdf[c].map(len) for c in ("z_last", "e_last", "levels")}).iloc[ahead]
                for shape, rows in shapes.groupby(list(shapes.columns)).groups.items():
                    moved = _powers(pdf.loc[rows], *shape)
                    for c, part in zip(("z_last", "e_last", "levels"), np.split(moved, np.cumsum(shape)[:2], axis=1)):
                        pdf.loc[rows, c] = pd.Series(list(part), index=rows, dtype=object)
            yield pdf

    return fits.mapInPandas(advance, fits.schema)


def forecast(fits: DataFrame, key: str, steps: Column, steps_per_row: int = STEPS_PER_ROW) -> DataFrame:
    """Recursive forecasts ``(key, step, predicted)`` for steps 1..``steps``.

    Steps are worked out ``steps_per_row`` at a time; a longer horizon is
    spread over several rows that start from exact values further ahead.
    """
    ahead = fits.withColumn("_steps", steps.cast("bigint")).where((F.col("_steps") > 0) & F.col("phi").isNotNull())
    pieces = F.floor((F.col("_steps") - 1) / F.lit(steps_per_row)).cast("bigint")
    ahead = ahead.withColumn("skip", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), pieces), lambda k: k * steps_per_row)))
    ahead = _jump(ahead.repartition(key, "skip"), key)
    count = F.least(F.col("_steps") - F.col("skip"), F.lit(steps_per_row))
    none = F.array().cast("array<double>")
    start = F.struct(
        F.col("z_last").alias("z"), F.col("e_last").alias("e"), F.col("levels").alias("lev"), none.alias("out")
    )

    def step(s: Column, _: Column) -> Column:
        z = F.col("intercept") + _dot(F.col("phi"), s["z"]) + _dot(F.col("theta"), s["e"])
        first = F.try_element_at(s["lev"], F.lit(1))
        second = F.try_element_at(s["lev"], F.lit(2))
        slope = F.coalesce(second, F.lit(0.0)) + z
        lev = F.when(F.size(s["lev"]) == 2, F.array(first + slope, slope)).when(
            F.size(s["lev"]) == 1, F.array(first + z)
        ).otherwise(s["lev"])
        y = F.coalesce(F.try_element_at(lev, F.lit(1)), z)
        return F.struct(
            _push(s["z"], z).alias("z"), _push(s["e"], F.lit(0.0)).alias("e"), lev.alias("lev"),
            F.concat(s["out"], F.array(y)).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1).cast("bigint"), count), start, step, lambda s: s["out"])
    return ahead.select(key, "skip", F.posexplode(path).alias("_i", "predicted")).select(
        key, (F.col("skip") + F.col("_i") + 1).alias("step"), "predicted"
    )


def ma_residuals(u: np.ndarray, theta: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``e[t] = u[t] - theta[0] * e[t-1] - ...`` for all ``t``, and the last errors, newest first.

    ``before`` holds the errors before the first, newest first. The sequence is
    cut into pieces that start from zero errors; a piece's true start comes
    from a scan over the pieces, whose response to it is the same for all.
    """
    q, n = len(theta), len(u)
    if not q or not n:
        return u.copy(), before.copy()
    size = max(q, int(np.sqrt(n)))
    pieces = -(-n // size)
    e = np.zeros(pieces * size)
    e[:n] = u
    e = e.reshape(pieces, size)
    # Column s + q of the response is what each start error adds at place s.
    response = np.zeros((size + q, q))
    response[:q] = np.eye(q)[::-1]
    with np.errstate(all="ignore"):
        for s in range(size):
            for j in range(min(q, s)):
                e[:, s] -= theta[j] * e[:, s - 1 - j]
            response[s + q] = -theta @ response[s : s + q][::-1]
        ends, start = e[:, ::-1][:, :q], before.astype(float)
        for piece in range(pieces):
            own = start
            start = ends[piece] + response[size:][::-1][:q] @ own
            e[piece] += response[q:] @ own
    e = e.reshape(-1)[:n]
    return e, np.concatenate([e[::-1][:q], before])[:q]


def _ma_block(table: pa.Table, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a block's rows, their errors and the last ones. Errors before the first usable row are zero."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    theta = np.asarray(table.column("theta")[0].as_py() or [], float)
    u = table.column("_u").to_numpy().astype(float)[order]
    pos = table.column("pos").to_numpy()[order]
    first = table.column("_first")[0].as_py()
    q = len(theta)
    out = np.full(len(u), np.nan)
    usable = np.zeros(len(u), bool) if first is None else pos >= first
    start = np.zeros(q) if before is None else before
    out[usable], last = ma_residuals(u[usable], theta, start)
    return order, out, last


def _with_errors(panel: Panel) -> Panel:
    """Add ``_error`` from ``_u`` (the row without its moving-average terms), ``theta`` and ``_first`` (its first usable row).

    A whole series is one task's work. A cut one is worked out block by block
    from zero errors; the blocks' last errors and how they pass on earlier ones
    give every block its start, and a second pass the errors.
    """
    key = panel.spec.key

    def schema(df: DataFrame) -> StructType:
        return StructType([*df.schema.fields, StructField("_error", DoubleType())])

    def done(table: pa.Table, before: np.ndarray | None = None) -> pa.Table:
        order, error, _ = _ma_block(table, before)
        placed = np.empty(len(error))
        placed[order] = error
        return table.append_column("_error", pa.array(placed, mask=np.isnan(placed)))

    def on_whole(df: DataFrame) -> DataFrame:
        return df.groupBy(key).applyInArrow(lambda table: done(table), schema(df))

    def on_cut(df: DataFrame) -> DataFrame:
        def ends(table: pa.Table) -> pa.Table:
            _, error, last = _ma_block(table)
            theta = np.asarray(table.column("theta")[0].as_py() or [], float)
            # How each earlier error comes through the block: the block run without input.
            rows = int((~np.isnan(error)).sum())
            through = [ma_residuals(np.zeros(rows), theta, one)[1] for one in np.eye(len(theta))]
            return pa.table(
                {
                    key: table.column(key)[:1], "_block": table.column("_block")[:1], "last": pa.array([last.tolist()], pa.list_(pa.float64())),
                    "through": pa.array([np.stack(through, 1).ravel().tolist() if through else []], pa.list_(pa.float64())),
                }
            )

        def starts(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("_block").to_numpy())
            before = [None] * len(order)
            now = None
            for i in order.tolist():
                last = np.asarray(table.column("last")[i].as_py(), float)
                through = np.asarray(table.column("through")[i].as_py(), float).reshape(len(last), len(last))
                now = np.zeros(len(last)) if now is None else now
                before[i] = now.tolist()
                now = last + through @ now
            return pa.table({key: table.column(key), "_block": table.column("_block"), "_before": pa.array(before, pa.list_(pa.float64()))})

        kind = df.schema[key].dataType.simpleString()
        ran = df.select(key, "_block", "pos", "_u", "theta", "_first").groupBy(key, "_block")
        # One row a block.
        summary = ran.applyInArrow(ends, f"{key} {kind}, _block bigint, last array<double>, through array<double>")
        start = summary.groupBy(key).applyInArrow(starts, f"{key} {kind}, _block bigint, _before array<double>")
        joined = join_series(df, start, [key, "_block"])

        def again(table: pa.Table) -> pa.Table:
            before = np.asarray(table.column("_before")[0].as_py() or [], float)
            return done(table.drop_columns(["_before"]), before)

        return joined.groupBy(key, "_block").applyInArrow(again, schema(df))

    return panel._each(on_whole, on_cut)


def in_sample(panel: Panel, fits: DataFrame, max_order: tuple[int, int, int]) -> Panel:
    """Add ``predicted``: the one-step prediction of every row from the rows before it.

    ``max_order`` bounds the orders in ``fits``. Rows with too little history
    have a null prediction: the first ``p + d``. Errors before these rows are
    taken as zero. A fit whose moving-average part cannot be inverted leaves
    null predictions once its errors are no longer finite.
    """
    p, d, q = max_order
    lags = d + p
    columns = ["d", "intercept", "phi", "theta"]
    value = F.col(panel.spec.value)
    ready = panel.attach(fits.select(panel.spec.key, *columns))
    if lags:
        ready = ready.over(lags, lambda w: {f"_y{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})
    y = [value, *[F.col(f"_y{k}") for k in range(1, lags + 1)]]

    def z(i: int) -> Column:
        """Lag i of the differenced series, whatever the row's d."""
        options = {0: lambda: y[i], 1: lambda: y[i] - y[i + 1], 2: lambda: y[i] - 2 * y[i + 1] + y[i + 2]}
        usable = [k for k in range(d + 1) if i + k < len(y)]
        out = F.when(F.col("d") == usable[0], options[usable[0]]())
        for k in usable[1:]:
            out = out.when(F.col("d") == k, options[k]())
        return out

    change = F.col("intercept")
    for i in range(1, p + 1):
        # Orders without that coefficient add 0.
        change = change + F.when(F.size("phi") < i, F.lit(0.0)).otherwise(F.try_element_at(F.col("phi"), F.lit(i)) * z(i))
    first = F.when(F.col("phi").isNotNull(), F.col("d") + F.size("phi"))
    # What is left of the row without its moving-average terms; differences cancel out.
    ready = ready.with_columns({"_u": z(0) - change, "_first": first.cast("bigint")})
    if q:
        ready = _with_errors(ready)
    else:
        ready = ready.with_columns({"_error": F.col("_u")})
    finite = F.col("_error").isNotNull() & ~F.isnan("_error") & (F.abs("_error") < F.lit(float("inf")))
    out = ready.with_columns({"predicted": F.when((F.col("pos") >= F.col("_first")) & finite, value - F.col("_error"))})
    return out.map(lambda d: d.drop(*columns, "_u", "_first", "_error", *[f"_y{k}" for k in range(1, lags + 1)]))


def with_last_errors(fits: DataFrame, predicted: Panel, rows: Column) -> DataFrame:
    """``fits`` with ``e_last`` taken from in-sample predictions of the first ``rows`` rows of each series."""
    key = predicted.spec.key
    width = F.greatest(F.coalesce(F.size("theta"), F.lit(0)), F.lit(0))
    error = F.col(predicted.spec.value) - F.col("predicted")
    # Few rows a series: the errors that its order looks back at, newest first.
    late = predicted.attach(fits.select(key, width.alias("_width"))).df.where(
        (F.col("pos") < rows) & (F.col("pos") >= rows - F.col("_width"))
    )
    last = late.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("pos"), error.alias("e")))), lambda s: s["e"]).alias("_last"))
    none = F.array_repeat(F.lit(0.0), width)
    full = F.slice(F.concat(F.transform(F.coalesce("_last", none), lambda e: F.coalesce(e, F.lit(0.0))), none), F.lit(1), width)
    return join_series(fits, last, [key]).withColumn("e_last", full).drop("_last")
