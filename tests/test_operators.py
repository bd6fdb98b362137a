"""Positional operators on tiny series, and in both layouts of a panel."""

from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsweave.operators import arima, diagnostics, evaluate, features, moments, profile, scaling, splits, windows
from tsweave.operators.panel import Panel
from tsweave.spec import PANEL, SeriesSpec


def values(df, column, order="pos"):
    return [r[0] for r in df.orderBy("series_id", order).select(column).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with most of the rows, ties in time, and many short ones."""
    rng = np.random.default_rng(7)
    rows = [("hot", int(i // 3), i, float(v)) for i, v in enumerate(rng.normal(size=3000).cumsum())]
    rows += [(f"s{k}", i, i, float(v)) for k in range(20) for i, v in enumerate(rng.normal(size=10 + 5 * k))]
    df = spark.createDataFrame(rows, "series_id string, t int, seq bigint, value double")
    df = df.selectExpr("series_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, t) AS ts", "seq", "value")
    return df.repartition(5)


@pytest.fixture(scope="module")
def layouts(skewed):
    """The same rows whole, with the long series cut, and with every series cut."""
    return [
        Panel.of(skewed, layout="series"),
        Panel.of(skewed, max_rows=500, block_rows=100),
        Panel.of(skewed, layout="blocks", block_rows=64),
        # Blocks shorter than the history an operator needs.
        Panel.of(skewed, layout="blocks", block_rows=5),
    ]


def same_everywhere(layouts, build, keys):
    frames = [build(p).toPandas().sort_values(keys).reset_index(drop=True) for p in layouts]
    first = frames[0]
    assert len(first)
    for other in frames[1:]:
        assert len(other) == len(first)
        for c in first.columns:
            if first[c].dtype == float:
                np.testing.assert_allclose(other[c], first[c], rtol=1e-7, atol=1e-9, err_msg=c)
            else:
                assert [str(v) for v in other[c]] == [str(v) for v in first[c]], c


def test_layout_is_chosen_by_length(skewed):
    assert Panel.of(skewed).cut is None
    panel = Panel.of(skewed, max_rows=500, block_rows=100)
    blocks = panel.cut.groupBy("series_id", "_block").count().collect()
    assert {r.series_id for r in blocks} == {"hot"} and [r["count"] for r in blocks] == [100] * 30
    assert panel.whole.where("series_id = 'hot'").count() == 0
    assert panel.df.count() == skewed.count() and "_block" not in panel.df.columns


def test_positions_follow_time_then_seq(layouts):
    for panel in layouts:
        rows = panel.df.where("series_id = 'hot'").orderBy("pos").select("pos", "seq", "n").collect()
        assert [(r.pos, r.seq, r.n) for r in rows] == [(i, i, 3000) for i in range(3000)]


def test_features_same_in_all_layouts(layouts):
    same_everywhere(layouts, lambda p: features.lag_rolling(p).rows("series_id", "pos", "lag1", "lag2", "rolling_mean_3"), ["series_id", "pos"])
    same_everywhere(layouts, lambda p: features.difference(p, 2).rows("series_id", "pos", "diff"), ["series_id", "pos"])


def test_windows_same_in_all_layouts(layouts):
    same_everywhere(layouts, lambda p: windows.sliding_windows(p), ["series_id", "pos"])


def test_scaling_same_in_all_layouts(layouts):
    same_everywhere(
        layouts,
        lambda p: scaling.minmax(splits.split_ceil_overlap(p), F.col("in_train")).rows("series_id", "pos", "lo", "hi", "scaled"),
        ["series_id", "pos"],
    )


def test_renumber_same_in_all_layouts(layouts):
    same_everywhere(layouts, lambda p: p.where(F.col("seq") % 3 != 0).renumber().rows("series_id", "seq", "pos", "n"), ["series_id", "pos"])

    def lag_after(p):
        left = p.where(F.col("seq") % 3 != 0).renumber()
        return features.lag_rolling(left).rows("series_id", "pos", "lag1", "lag2")

    same_everywhere(layouts, lag_after, ["series_id", "pos"])


def test_diagnostics_same_in_all_layouts(layouts):
    same_everywhere(layouts, lambda p: diagnostics.acf(p, 8), ["series_id", "lag"])
    same_everywhere(layouts, lambda p: diagnostics.pacf(p, 8), ["series_id", "lag"])
    same_everywhere(layouts, lambda p: diagnostics.adf(p, 3).drop("p_value"), ["series_id"])


def test_arima_same_in_all_layouts(layouts):
    orders = [(2, 1, 1)]

    def predicted(p):
        fits = arima.fit_orders(p, orders)
        return arima.in_sample(p, fits, orders[0]).rows("series_id", "pos", "predicted")

    same_everywhere(layouts, predicted, ["series_id", "pos"])


def test_result_does_not_depend_on_partitions(skewed):
    a = features.lag_rolling(Panel.of(skewed.repartition(1))).rows("series_id", "seq", "lag1")
    b = features.lag_rolling(Panel.of(skewed.repartition(11, "value"))).rows("series_id", "seq", "lag1")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_lag_and_rolling_over_a_null(panel_of):
    out = features.lag_rolling(Panel.of(panel_of({"a": [1, 2, None, 4, 5, 6, 7]}))).df
    assert values(out, "rolling_mean_3") == [None] * 5 + [5.0, 6.0]
    assert values(out, "lag1") == [None, 1, 2, None, 4, 5, 6]
    safe = features.lag_rolling(Panel.of(panel_of({"a": [1, 2, 3, 4]})), leak_safe=True).df
    assert values(safe, "rolling_mean_3") == [None, None, None, 2.0]


def test_the_rolling_mean_holds_the_target(panel_of):
    out = features.lag_rolling(Panel.of(panel_of({"a": [3, 1, 4, 1, 5, 9, 2]}))).df.na.drop()
    gap = out.select(F.max(F.abs(F.expr("3*rolling_mean_3 - lag1 - lag2 - value")))).first()[0]
    assert gap < 1e-12


def test_arrival_order(spark):
    df = spark.createDataFrame([("a", None, 0, 1.0), ("a", dt(2024, 1, 1), 1, 2.0), ("a", dt(2023, 1, 1), 2, 3.0)],
                               "series_id string, ts timestamp_ntz, seq bigint, value double")
    spec = SeriesSpec(order=("seq",))
    out = features.forecasting_features(Panel.of(df, spec), leak_safe=False).df
    assert values(out, "lag1", "seq") == [None, 1.0, 2.0]
    # Lags have seen the row without a timestamp before it is dropped.
    kept = features.drop_warmup(out, ["hour"])
    assert values(kept, "lag1", "seq") == [1.0, 2.0]


def test_difference(panel_of):
    panel = Panel.of(panel_of({"a": [1, 4, 9, 16]}))
    assert values(features.difference(panel, 0).df, "diff") == [1, 4, 9, 16]
    assert values(features.difference(panel, 1).df, "diff") == [None, 3, 5, 7]
    assert values(features.difference(panel, 2).df, "diff") == [None, None, 2, 2]


@pytest.mark.parametrize("n,expected,with_last", [(12, 0, 0), (13, 0, 1), (14, 1, 2), (20, 7, 8)])
def test_number_of_windows(panel_of, n, expected, with_last):
    panel = Panel.of(panel_of({"a": range(1, n + 1)}))
    out = windows.sliding_windows(panel).orderBy("pos").collect()
    assert len(out) == expected
    assert windows.sliding_windows(panel, keep_last=True).count() == with_last
    if out:
        assert list(out[0].x) == [float(v) for v in range(1, 13)] and out[0].y == 13.0
        assert out[0].y_ts == dt(2024, 1, 13)


def test_slide_and_gate(spark, panel_of):
    panel = Panel.of(panel_of({"a": [float(i) if i != 5 else None for i in range(20)]}))
    out = windows.sliding_windows(panel)
    assert sorted(r.pos for r in windows.window_violations(out).collect()) == list(range(12, 18))
    with pytest.raises(Exception, match="null or NaN"):
        windows.require_clean_windows(out).collect()
    row = spark.sql("SELECT array(1D, 2D, 3D) AS x").select(windows.slide(F.col("x"), F.lit(4.0))).first()
    assert list(row[0]) == [2.0, 3.0, 4.0]


def test_floor_split(panel_of):
    out = splits.split_floor(Panel.of(panel_of({"a": range(7), "b": [1]}))).df
    counts = {(r.series_id, r.split): r.n_rows for r in splits.split_counts(out, "series_id").collect()}
    assert counts == {("a", "train"): 5, ("a", "test"): 2, ("b", "test"): 1}


@pytest.mark.parametrize("n,train,start,clamped", [(397, 318, 258, 258), (50, 40, 30, 0), (75, 60, 0, 0), (10, 8, 0, 0), (74, 60, 0, 0), (70, 56, 66, 0)])
def test_overlap_split(panel_of, n, train, start, clamped):
    panel = Panel.of(panel_of({"a": range(n)}))
    row = splits.split_ceil_overlap(panel).df.first()
    assert (row.train_rows, row.test_start) == (train, start)
    assert splits.split_ceil_overlap(panel, clamp=True).df.first().test_start == clamped


def test_monthly_series_sizes(panel_of):
    panel = Panel.of(panel_of({"a": range(397)}))
    split = splits.split_ceil_overlap(panel)
    both = splits.explode_split(split.df, F.col("in_train"), F.col("in_test"))
    counts = {r.split: r.n_rows for r in splits.split_counts(both, "series_id").collect()}
    assert counts == {"train": 318, "test": 139}
    parts = {r.split: r["count"] for r in windows.split_windows(split).groupBy("split").count().collect()}
    assert parts == {"train": 305, "test": 126}


def test_split_windows_equal_windows_of_the_parts(panel_of):
    data = panel_of({"a": [((i * 37) % 101) / 7 for i in range(150)]})
    split = splits.split_ceil_overlap(Panel.of(data))
    got = windows.split_windows(split).select("split", "y_ts", "x", "y")
    test_part = data.where(F.col("seq") >= 120 - 60)
    expected = windows.sliding_windows(Panel.of(test_part)).select(F.lit("test").alias("split"), "y_ts", "x", "y")
    assert got.where("split = 'test'").exceptAll(expected).count() == 0
    assert expected.count() == got.where("split = 'test'").count() == 77


def test_scaling_round_trip_and_constant(panel_of):
    panel = Panel.of(panel_of({"a": [1, 5, 3, 9, -2], "c": [3] * 5}))
    for low, high in [(-1.0, 1.0), (0.0, 1.0)]:
        out = scaling.minmax(panel, F.col("pos") < 3, (low, high)).df
        back = scaling.unscale(F.col("scaled"), F.col("lo"), F.col("hi"), (low, high))
        assert out.select(F.max(F.abs(back - F.col("value")))).first()[0] < 1e-12
        assert values(out.where("series_id = 'c'"), "scaled") == [low] * 5
        # Test rows are not clipped.
        assert max(values(out.where("series_id = 'a'"), "scaled")) > high


def test_errors_by_hand(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 6.0), ("a", 0.0, 1.0), ("a", None, 1.0), ("a", 3.0, None)],
                               "series_id string, actual double, predicted double")
    row = evaluate.evaluate(df, ["series_id"]).first()
    assert (row.n_rows, row.n_zero, row.mse, row.mae) == (3, 1, 2.0, pytest.approx(4 / 3))
    assert row.rmse == pytest.approx(2**0.5) and row.mape_pct == pytest.approx(50.0)
    assert row.mape == pytest.approx((0.5 + 0.5 + 1 / evaluate.EPSILON) / 3)


def test_profiles(spark, panel_of):
    df = spark.sql("""SELECT * FROM VALUES (1, 'x', double('NaN')), (2, null, 1.5), (null, 'z', null) AS t(a, b, c)""")
    assert {r.column_name: r.n_null for r in profile.null_counts(df).collect()} == {"a": 1, "b": 1, "c": 2}
    rows = profile.table_profile(df).orderBy("position").collect()
    assert [(r.column_name, r.data_type, r.n_non_null, r.n_rows) for r in rows] == [
        ("a", "int", 2, 3), ("b", "string", 2, 3), ("c", "double", 1, 3)]


def test_hour_profile_of_nulls(spark):
    df = spark.sql("""SELECT 'a' AS series_id, ts, 0L AS seq, v AS value FROM VALUES
        (timestamp_ntz'2024-01-01 01:00:00', 2D), (timestamp_ntz'2024-01-02 01:30:00', 4D),
        (timestamp_ntz'2024-01-01 05:00:00', null), (null, 9D) AS t(ts, v)""")
    total = {r.hour: (r.value, r["rank"]) for r in profile.hour_profile(df, "sum").collect()}
    assert total == {1: (6.0, 1), 5: (0.0, 2)}
    mean = {r.hour: r.value for r in profile.hour_profile(df, "mean").collect()}
    assert mean == {1: 3.0, 5: None}


def test_preview_repeats_rows_of_short_series(panel_of):
    out = profile.preview(panel_of({"a": range(7)}))
    assert sorted((r.part, r.place, r.value) for r in out.collect()) == [
        *[("head", i, float(i)) for i in range(5)], *[("tail", i, float(6 - i)) for i in range(5)]]


def test_line_buckets(panel_of):
    rows = profile.line_buckets(panel_of({"a": range(10)}), "value", "5 days").orderBy("ts").collect()
    assert sum(1 for _ in rows) in (2, 3) and min(r.y_min for r in rows) == 0 and max(r.y_max for r in rows) == 9


# Lag products and what is fitted from them


def lagged(y, lags, start):
    return np.column_stack([y[start - k : len(y) - k] for k in range(lags + 1)])


@pytest.mark.parametrize("max_columns", [48, 0])
def test_lag_products_give_exact_moments(spark, panel_of, monkeypatch, max_columns):
    monkeypatch.setattr(moments, "MAX_LAG_COLUMNS", max_columns)
    y = np.random.default_rng(1).normal(size=60).cumsum() + 100
    sums = moments.lag_products(Panel.of(panel_of({"a": y, "b": y[:6]})), 4, keep=9)
    batch = moments.Batch(sums.orderBy("series_id").toPandas())
    for start in (4, 5, 7):
        v = np.column_stack([np.ones(60 - start), lagged(y - y.mean(), 4, start)])
        np.testing.assert_allclose(batch.moments(4, start)[0], v.T @ v, atol=1e-9)
    assert np.isnan(batch.moments(4, 7)[1]).all()


def test_acf_against_numpy(panel_of):
    y = np.random.default_rng(2).normal(size=80).cumsum()
    rows = diagnostics.acf(Panel.of(panel_of({"a": y, "flat": [2] * 30, "short": [1, 3]})), 20).orderBy("lag").collect()
    u = y - y.mean()
    expected = [1.0, *[(u[k:] * u[:-k]).sum() / (u * u).sum() for k in range(1, 21)]]
    got = [r.acf for r in rows if r.series_id == "a"]
    np.testing.assert_allclose(got, expected, atol=1e-12)
    assert max(map(abs, got)) <= 1
    band = [r.band for r in rows if r.series_id == "a"]
    assert band[0] == 0 and band[1] == pytest.approx(diagnostics.Z95 / 80**0.5)
    assert band[3] == pytest.approx(diagnostics.Z95 * ((1 + 2 * (expected[1] ** 2 + expected[2] ** 2)) / 80) ** 0.5)
    assert all(r.acf is None for r in rows if r.series_id == "flat")
    assert [r.lag for r in rows if r.series_id == "short"] == [0, 1]


def test_pacf_solves_yule_walker(panel_of):
    y = np.random.default_rng(3).normal(size=100).cumsum()
    got = [r.pacf for r in diagnostics.pacf(Panel.of(panel_of({"a": y})), 10).orderBy("lag").collect()]
    u = y - y.mean()
    r = np.array([1.0, *[(u[k:] * u[:-k]).sum() / (u * u).sum() for k in range(1, 11)]])
    for k in range(1, 11):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert got[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1], abs=1e-9)


def dickey_fuller(y, lags, start):
    dy = np.diff(y)
    t = np.arange(start, len(y))
    x = np.column_stack([y[t - 1], np.ones(len(t)), *[dy[t - 1 - i] for i in range(1, lags + 1)]])
    target = dy[t - 1]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    sse = ((target - x @ beta) ** 2).sum()
    tau = beta[0] / np.sqrt(sse / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    return tau, len(t) * (np.log(2 * np.pi * sse / len(t)) + 1) + 2 * x.shape[1], len(t)


def test_adf_against_direct_regression(panel_of):
    rng = np.random.default_rng(4)
    series = {"walk": rng.normal(size=200).cumsum(), "noise": rng.normal(size=120), "flat": np.ones(50), "short": [1, 2, 4]}
    rows = {r.series_id: r for r in diagnostics.adf(Panel.of(panel_of(series))).collect()}
    for name in ("walk", "noise"):
        y = series[name]
        top = diagnostics.default_adf_lags(len(y))
        best = min(range(top + 1), key=lambda k: dickey_fuller(y, k, top + 1)[1])
        tau, _, n = dickey_fuller(y, best, best + 1)
        assert rows[name].lags == best and rows[name].n_rows == n
        assert rows[name].statistic == pytest.approx(tau, rel=1e-8)
    assert rows["noise"].stationary and not rows["walk"].stationary
    assert rows["flat"].statistic is None and rows["flat"].stationary is None


def test_unit_root_p_values():
    assert diagnostics.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.001)
    assert diagnostics.unit_root_p(-20) == 0 and diagnostics.unit_root_p(3) == 1


def test_ar_fit_against_numpy(panel_of):
    rng = np.random.default_rng(5)
    y = np.zeros(300)
    for t in range(2, 300):
        y[t] = 5 + 0.5 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    row = arima.fit_orders(Panel.of(panel_of({"a": y})), [(2, 0, 0)]).first()
    x = np.column_stack([np.ones(298), y[1:-1], y[:-2]])
    beta, *_ = np.linalg.lstsq(x, y[2:], rcond=None)
    np.testing.assert_allclose([row.intercept, *row.phi], beta, rtol=1e-9)
    sse = ((y[2:] - x @ beta) ** 2).sum()
    assert row.aic == pytest.approx(298 * np.log(sse / 298) + 298 * (1 + np.log(2 * np.pi)) + 8)


def test_arma_is_recovered(panel_of):
    rng = np.random.default_rng(6)
    e = rng.normal(size=4000)
    y = np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    row = arima.fit_orders(Panel.of(panel_of({"a": y})), [(1, 0, 1)]).first()
    assert row.phi[0] == pytest.approx(0.6, abs=0.05) and row.theta[0] == pytest.approx(0.4, abs=0.05)


def test_grid_has_all_orders_and_survives_odd_series(panel_of):
    rng = np.random.default_rng(8)
    panel = Panel.of(panel_of({"a": rng.normal(size=80), "flat": [1] * 40, "short": [1, 2, 3], "holed": [1, None] * 30}))
    grid = arima.arima_grid(panel)
    rows = grid.collect()
    assert len(rows) == 4 * 48
    assert all(r.aic is None for r in rows if r.series_id in ("flat", "short", "holed"))
    best = arima.best_orders(grid, "series_id").collect()
    assert [b.series_id for b in best] == ["a"]
    mine = [r for r in rows if r.series_id == "a"]
    assert best[0].aic == min(r.aic for r in mine)


def test_noiseless_ar_forecast_is_its_closed_form(panel_of):
    y = [10.0]
    for _ in range(9):
        y.append(2 + 0.5 * y[-1])
    fits = arima.fit_orders(Panel.of(panel_of({"a": y})), [(1, 0, 0)])
    out = arima.forecast(fits, "series_id", F.lit(20)).orderBy("step").collect()
    assert [r.step for r in out] == list(range(1, 21))
    for r in out:
        assert r.predicted == pytest.approx(4 + (y[-1] - 4) * 0.5**r.step, abs=1e-6)


@pytest.mark.parametrize("order", [(2, 0, 0), (1, 1, 2), (0, 2, 3), (3, 2, 1), (0, 1, 0), (0, 0, 2)])
def test_long_forecasts_in_pieces(panel_of, order):
    y = np.random.default_rng(9).normal(size=200).cumsum()
    fits = arima.fit_orders(Panel.of(panel_of({"a": y})), [order])
    whole = [r.predicted for r in arima.forecast(fits, "series_id", F.lit(95)).orderBy("step").collect()]
    pieces = arima.forecast(fits, "series_id", F.lit(95), steps_per_row=10).orderBy("step").collect()
    assert [r.step for r in pieces] == list(range(1, 96))
    np.testing.assert_allclose([r.predicted for r in pieces], whole, rtol=1e-6, atol=1e-6)


def test_forecast_continues_the_in_sample_predictions(panel_of):
    """The first forecast is the one-step prediction of the row after the last."""
    y = np.random.default_rng(10).normal(size=121).cumsum()
    for order in [(2, 0, 0), (1, 1, 1), (2, 2, 2)]:
        short = Panel.of(panel_of({"a": y[:120]}))
        fits = arima.fit_orders(short, [order])
        fits = arima.with_last_errors(fits, arima.in_sample(short, fits, order), F.lit(120))
        ahead = arima.forecast(fits, "series_id", F.lit(1)).first().predicted
        held = arima.in_sample(Panel.of(panel_of({"a": y})), fits, order).df.where("pos = 120").first().predicted
        assert ahead == pytest.approx(held, rel=1e-9)


def test_in_sample_handles_mixed_orders(panel_of):
    y = np.random.default_rng(11).normal(size=90).cumsum()
    panel = Panel.of(panel_of({"a": y, "b": y[::-1]}))
    fits = arima.fit_orders(panel, [(1, 0, 0)]).where("series_id = 'a'").unionByName(
        arima.fit_orders(panel, [(2, 1, 1)]).where("series_id = 'b'"))
    both = arima.in_sample(panel, fits, (2, 1, 1)).df
    alone = arima.in_sample(panel, fits.where("series_id = 'a'"), (1, 0, 0)).df
    np.testing.assert_allclose(
        np.array(values(both.where("series_id = 'a'"), "predicted"), dtype=float),
        np.array(values(alone.where("series_id = 'a'"), "predicted"), dtype=float))
    assert values(both.where("series_id = 'b'"), "predicted").count(None) == 1 + 2


def sequential_predictions(y, d, c, phi, theta):
    """One-step predictions by the plain recursion, row by row."""
    z = np.diff(y, d) if d else np.asarray(y, float)
    e, out = np.zeros(len(z)), [None] * len(y)
    for t in range(len(phi), len(z)):
        mean = c + sum(a * z[t - 1 - i] for i, a in enumerate(phi)) + sum(b * e[t - 1 - j] for j, b in enumerate(theta) if t - 1 - j >= 0)
        e[t] = z[t] - mean
        out[t + d] = y[t + d] - e[t]
    return out


@pytest.mark.parametrize("order", [(0, 0, 1), (1, 0, 2), (2, 1, 1), (1, 2, 3), (3, 0, 0)])
def test_moving_average_residuals_are_those_of_the_recursion(spark, panel_of, order):
    p, d, q = order
    rng = np.random.default_rng(sum(order))
    series = {"a": rng.normal(size=301).cumsum(), "b": rng.normal(size=40), "tiny": [1.0, 2.0]}
    phi, theta = [0.4, -0.2, 0.1][:p], [0.5, 0.3, -0.2][:q]
    fits = spark.createDataFrame(
        [(k, d, 0.1, phi, theta) for k in series], "series_id string, d int, intercept double, phi array<double>, theta array<double>"
    )
    df = panel_of(series)
    cut = Panel.of(df, layout="blocks", block_rows=23)
    mixed = Panel.of(df, max_rows=100, block_rows=7)
    for panel in (Panel.of(df, layout="series"), cut, mixed):
        rows = arima.in_sample(panel, fits, order).df.orderBy("series_id", "pos").collect()
        for key, y in series.items():
            got = [r.predicted for r in rows if r.series_id == key]
            want = sequential_predictions(y, d, 0.1, phi, theta)
            assert [g is None for g in got] == [w is None for w in want]
            np.testing.assert_allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-9, atol=1e-9)


def test_scan_passes_errors_on():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 1000):
        for theta in ([], [0.7], [0.5, -0.3, 0.2]):
            u, before = rng.normal(size=n), rng.normal(size=len(theta))
            e = list(before[::-1])
            for x in u:
                e.append(x - sum(t * e[-1 - j] for j, t in enumerate(theta)))
            got, last = arima.ma_residuals(u, np.array(theta), before)
            np.testing.assert_allclose(got, e[len(theta):], atol=1e-9)
            np.testing.assert_allclose(last, e[::-1][: len(theta)], atol=1e-9)


def test_fits_that_cannot_be_inverted_do_not_stop_the_rest(spark, panel_of):
    y = list(np.random.default_rng(5).normal(size=3000))
    fits = spark.createDataFrame([("a", 0, 0.0, [0.1], [3.0]), ("b", 0, 0.0, [0.1], [0.3])], "series_id string, d int, intercept double, phi array<double>, theta array<double>")
    out = arima.in_sample(Panel.of(panel_of({"a": y, "b": y, "no fit": y})), fits, (1, 0, 1)).df
    n = {r.series_id: r.n for r in out.groupBy("series_id").agg(F.count("predicted").alias("n")).collect()}
    assert n["b"] == 2999 and 0 < n["a"] < 2999 and n["no fit"] == 0


@pytest.mark.parametrize("layout", ["series", "blocks"])
@pytest.mark.parametrize("block", [50, 1 << 16])
def test_many_lags_by_blocks_equal_direct_sums(spark, panel_of, monkeypatch, layout, block):
    monkeypatch.setattr(moments, "FFT_BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    long, short = np.cumsum(rng.normal(size=3000)), rng.normal(size=40)
    panel = Panel.of(panel_of({"a": list(long), "b": list(short), "c": [5.0]}), layout=layout, **({"block_rows": 1200} if layout == "blocks" else {}))
    got = {r.series_id: r for r in moments.lag_products(panel, 1000, keep=3).collect()}
    for name, y in (("a", long), ("b", short), ("c", np.array([5.0]))):
        u = y - y.mean()
        direct = [float(u[k:] @ u[: len(u) - k]) if k < len(u) else 0.0 for k in range(1001)]
        np.testing.assert_allclose(got[name].products, direct, atol=1e-9 * max(1.0, direct[0]))
    assert np.allclose(got["a"].tail, (long - long.mean())[::-1][:3])


def test_many_lags_over_nulls(spark, panel_of):
    y = [1.0, None, 4.0, 2.0, None, 7.0] * 20
    got = moments.lag_products(Panel.of(panel_of({"a": y})), 60, keep=0).first()
    mean = np.mean([v for v in y if v is not None])
    u = np.array([0.0 if v is None else v - mean for v in y])
    np.testing.assert_allclose(got.products, [u[k:] @ u[: len(u) - k] for k in range(61)], atol=1e-9)
