"""The registered queries: every operator over the test tables.

Each query takes ``(spark, folder)``. Doubles are rounded and integers widened
so that another engine's result can be compared value by value.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsweave.functions import calendar, cleaning, dates
from tsweave.operators import (
    arima, diagnostics, evaluate, features, profile, scaling, splits, windows,
)
from tsweave.operators.panel import Panel, join_series
from tsweave.plans import compare, forecaster, prepare
from tsweave.session import scratch_path
from tsweave.sources import files, series, store
from tsweave.sources.series import all_events, daily_orders, hourly_avg, hourly_type, monthly_orders, table, user_events
from tsweave.spec import PANEL

KEY = PANEL.key
HORIZON = 10


def nudge(digits: int) -> float:
    """Less than a hundredth of the last digit kept.

    A mean of two-digit numbers often lies exactly between two roundings, where
    the order of summation would decide. The nudge decides it instead.
    """
    return 0.37 * 10.0 ** -(digits + 2)


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(nudge(digits)), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, all integers and flags as bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        column = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            column = r(column.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            column = column.cast("bigint")
        out.append(column.alias(f.name))
    return df.select(*out)


def joined(values: Column) -> Column:
    """An array of numbers as text, two digits each."""
    return F.array_join(F.transform(values, lambda v: v.cast("decimal(18,2)").cast("string")), ",")


def _hourly_panel(spark: SparkSession, folder: str) -> Panel:
    # At most one row per hour: no series can outgrow a task.
    return Panel.of(hourly_avg(spark, folder), layout="series")


def _gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with nulls in the target and in a column nothing else uses."""
    return table(spark, folder, "events").withColumns(
        {
            "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
            "props": F.when(F.col("event_id") % 11 != 0, F.col("props")),
        }
    )


# Ingest and cleaning


def table_profile(spark, folder):
    return rounded(profile.table_profile(_gappy_events(spark, folder)))


def null_counts(spark, folder):
    return profile.null_counts(_gappy_events(spark, folder))


def clean_numeric(spark, folder):
    text = F.col("text")
    return series.text_numbers(spark, folder).select(
        "event_id", "text",
        r(cleaning.clean_numeric(text)).alias("digits_only"),
        F.round(cleaning.clean_numeric(text, signed=True), 8).alias("signed"),
    )


def parse_dates_first_match(spark, folder):
    return series.text_dates(spark, folder).select(
        "event_id", "text", dates.parse_dates(F.col("text"), "first_match").alias("parsed")
    )


def unread_dates(spark, folder):
    """Shapes of the texts that no short layout reads, with counts."""
    return dates.unread_layouts(series.text_dates(spark, folder), "text", "first_match")


def parse_dates_most_specific(spark, folder):
    return series.text_dates(spark, folder).select(
        "event_id", "text", dates.parse_dates(F.col("text")).alias("parsed")
    )


def parse_iso(spark, folder):
    return series.text_dates(spark, folder).select(
        "event_id",
        dates.parse_timestamp(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                              .otherwise(F.lit("no date"))).alias("parsed"),
    )


def concat_day_hour(spark, folder):
    ev = table(spark, folder, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    hour = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm:ss"))
    return ev.select("event_id", dates.day_and_hour(day, hour).alias("timestamp"))


def dropna_then_project(spark, folder):
    return files.drop_incomplete(_gappy_events(spark, folder)).select("ts", "value")


def preview_head_tail(spark, folder):
    return profile.preview(user_events(spark, folder), 5).select(KEY, "part", "place", "ts", "value")


def first_rows(spark, folder):
    return profile.first_rows(user_events(spark, folder), 13).select(KEY, "place", "ts", "value")


# Features, windows, splits, scaling


def calendar_features(spark, folder):
    ev = user_events(spark, folder)
    return rounded(calendar.add_calendar(ev).select("seq", *features.CALENDAR_FEATURES))


def cyclical_features(spark, folder):
    ev = user_events(spark, folder)
    return rounded(calendar.add_date_parts(ev, drop_ts=True).drop(KEY))


def lag_rolling_features(spark, folder):
    out = features.lag_rolling(Panel.of(user_events(spark, folder)))
    return rounded(out.rows(KEY, "seq", "pos", "value", "lag1", "lag2", "rolling_mean_3"))


def leak_safe_features(spark, folder):
    out = features.lag_rolling(Panel.of(user_events(spark, folder)), leak_safe=True)
    return rounded(out.rows(KEY, "seq", "lag1", "lag2", "rolling_mean_3"))


def warmup_drop(spark, folder):
    panel = Panel.of(user_events(spark, folder))
    names = features.feature_names()
    out = features.forecasting_features(panel, leak_safe=False)
    kept = out.map(lambda d: features.drop_warmup(d, [*names, "value"])).renumber()
    return rounded(kept.rows(KEY, "seq", "pos", "n", *names, "value"))


def split_floor(spark, folder):
    out = splits.split_floor(Panel.of(user_events(spark, folder)))
    return out.rows(KEY, "seq", "pos", "split")


def split_ceil_overlap(spark, folder):
    out = splits.split_ceil_overlap(Panel.of(user_events(spark, folder)))
    return rounded(out.rows(KEY, "seq", "train_rows", "test_start", "in_train", "in_test"))


def split_ceil_overlap_hourly(spark, folder):
    out = splits.split_ceil_overlap(_hourly_panel(spark, folder))
    return rounded(out.rows(KEY, "ts", "train_rows", "test_start", "in_train", "in_test"))


def split_counts(spark, folder):
    out = splits.split_ceil_overlap(Panel.of(user_events(spark, folder))).df
    both = splits.explode_split(out, F.col("in_train"), F.col("in_test"))
    return splits.split_counts(both, KEY)


def _scaled(spark, folder, feature_range=scaling.RANGE) -> Panel:
    split = splits.split_ceil_overlap(Panel.of(user_events(spark, folder)))
    return scaling.minmax(split, F.col("in_train"), feature_range)


def minmax_fit_apply(spark, folder):
    return rounded(_scaled(spark, folder).rows(KEY, "seq", "lo", "hi", "scaled"))


def minmax_inverse(spark, folder):
    out = _scaled(spark, folder, (0.0, 1.0))
    back = scaling.unscale(F.col("scaled"), F.col("lo"), F.col("hi"), (0.0, 1.0))
    return out.rows(
        KEY, "seq", r("scaled", 4).alias("scaled"), r(back).alias("restored"),
        cleaning.to_float32(F.col("value")).cast("decimal(18,2)").cast("double").alias("as_float32"),
    )


def sliding_windows(spark, folder):
    out = windows.sliding_windows(Panel.of(user_events(spark, folder)))
    return out.select(KEY, "pos", joined(F.col("x")).alias("x"), "y", "y_ts")


def split_sliding_windows(spark, folder):
    out = windows.split_windows(splits.split_ceil_overlap(Panel.of(user_events(spark, folder))))
    return out.select(KEY, "split", "pos", joined(F.col("x")).alias("x"), "y", "y_ts")


def last_window(spark, folder):
    out = windows.seed_windows(Panel.of(user_events(spark, folder)))
    return out.select(KEY, joined(F.col("x")).alias("x"), F.col("value").alias("y"), F.col("last_ts").alias("y_ts"), "reason")


def slide_append(spark, folder):
    out = windows.sliding_windows(Panel.of(user_events(spark, folder)))
    return out.select(KEY, "pos", joined(windows.slide(F.col("x"), F.col("y"))).alias("x"))


def window_null_gate(spark, folder):
    holed = user_events(spark, folder).withColumn("value", F.when(F.col("seq") % 97 != 0, F.col("value")))
    bad = windows.window_violations(windows.sliding_windows(Panel.of(holed)))
    return bad.select(KEY, "pos", F.size(F.filter("x", lambda v: v.isNull())).cast("bigint").alias("n_null"))


# Profiles and diagnostics


def hour_profile_sum(spark, folder):
    return rounded(profile.hour_profile(user_events(spark, folder), "sum"), 4)


def hour_profile_mean(spark, folder):
    return rounded(profile.hour_profile(all_events(spark, folder), "mean"), 4)


def differenced(spark, folder):
    panel = Panel.of(user_events(spark, folder))
    out = features.difference(features.difference(panel, 1, "diff1"), 2, "diff2")
    return rounded(out.rows(KEY, "seq", "diff1", "diff2"))


def _train() -> Column:
    """Rows of the train part of a series."""
    return splits.floor_cut(F.col("n"))


def acf_20(spark, folder):
    return rounded(diagnostics.acf(Panel.of(user_events(spark, folder)), 20, _train()))


def pacf_2(spark, folder):
    return rounded(diagnostics.pacf(Panel.of(user_events(spark, folder)), 2, _train()))


def pacf_20(spark, folder):
    return rounded(diagnostics.pacf(_hourly_panel(spark, folder), 20, _train()))


def adf_lag0(spark, folder):
    out = diagnostics.adf(Panel.of(user_events(spark, folder)), 0, _train())
    return rounded(out.select(KEY, "statistic", "n_rows"))


def adf_auto(spark, folder):
    return rounded(diagnostics.adf(_hourly_panel(spark, folder), rows=_train()))


def line_extract(spark, folder):
    return profile.line_extract(hourly_type(spark, folder), "max cpu")


def line_buckets(spark, folder):
    return rounded(profile.line_buckets(user_events(spark, folder), "value", "1 day"))


# Linear forecasting

AR1 = [(1, 0, 0)]
AR_CANDIDATES = arima.all_orders((0, 1), (0, 1), (0,))


def ar1_fit_aic(spark, folder):
    fits = arima.fit_orders(Panel.of(user_events(spark, folder)), AR1, _train())
    return rounded(
        fits.select(KEY, "n_rows", "intercept", F.element_at("phi", 1).alias("phi1"), "sse", "aic"), 5
    )


def ar1_in_sample(spark, folder):
    panel = Panel.of(user_events(spark, folder))
    cut = _train()
    fits = arima.fit_orders(panel, AR1, cut)
    out = arima.in_sample(panel, fits, (1, 0, 0)).where(F.col("pos") < cut)
    return rounded(out.rows(KEY, "pos", "value", "predicted"))


def ar1_forecast(spark, folder):
    panel = Panel.of(user_events(spark, folder))
    cut = _train()
    fits = arima.fit_orders(panel, AR1, cut)
    lengths = panel.df.groupBy(KEY).agg(F.max("n").alias("n"))
    return rounded(arima.forecast(join_series(fits, lengths, [KEY], "inner"), KEY, F.col("n") - cut))


def best_ar_order(spark, folder):
    cut = _train()
    fits = arima.fit_orders(Panel.of(user_events(spark, folder)), AR_CANDIDATES, cut)
    return rounded(arima.best_orders(fits, KEY), 5)


def arima_grid(spark, folder):
    return rounded(arima.arima_grid(Panel.of(user_events(spark, folder)), rows=_train()), 4)


def arima_eval(spark, folder):
    _, _, errors = forecaster.arima_run(Panel.of(user_events(spark, folder)))
    return rounded(errors, 4)


def arima_ar_eval(spark, folder):
    """Search, refit, in-sample predictions, forecast of the test part and errors."""
    _, _, errors = forecaster.arima_run(Panel.of(user_events(spark, folder)), AR_CANDIDATES)
    return rounded(errors.select(KEY, "split", "n_rows", "mse", "rmse", "mae"), 4)


def _fixed_ma(panel: Panel) -> DataFrame:
    """The same ARIMA(1,1,1) for every series."""
    numbers = {"d": F.lit(1), "intercept": F.lit(0.01), "phi": F.array(F.lit(0.5)), "theta": F.array(F.lit(0.4))}
    return panel.df.select(KEY).distinct().withColumns(numbers)


def arima_ma_in_sample(spark, folder):
    """One-step predictions of a given ARIMA(1,1,1), whose errors depend on all errors before."""
    panel = _hourly_panel(spark, folder)
    return rounded(arima.in_sample(panel, _fixed_ma(panel), (1, 1, 1)).rows(KEY, "pos", "predicted"), 5)


def long_series_ma_in_sample(spark, folder):
    """The same on one series that is cut into blocks: errors are passed on from block to block."""
    panel = Panel.of(all_events(spark, folder), layout="blocks")
    return rounded(arima.in_sample(panel, _fixed_ma(panel), (1, 1, 1)).rows("seq", "pos", "predicted"), 5)


def linear_window_forecast(spark, folder):
    out = forecaster.series_linear_forecast(Panel.of(user_events(spark, folder)), HORIZON, length=1)
    return rounded(out)


def linear_window_forecast_12(spark, folder):
    return rounded(forecaster.series_linear_forecast(Panel.of(user_events(spark, folder)), HORIZON))


def future_dates(spark, folder):
    ev = user_events(spark, folder)
    last = ev.groupBy(KEY).agg(F.max("ts").alias("last_ts"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(30)))
    out = last.withColumn("step", steps)
    return rounded(out.select(KEY, "step", calendar.future_timestamp(F.col("last_ts"), F.col("step")).alias("date")))


# Evaluation and comparison


def persistence_eval(spark, folder):
    """Hourly panel, features, warm-up drop, split, persistence forecast, errors."""
    panel = _hourly_panel(spark, folder)
    out = features.forecasting_features(panel, leak_safe=False)
    kept = out.map(lambda d: features.drop_warmup(d, [*features.feature_names(), "value"])).renumber()
    scored = splits.split_floor(kept).rows(
        KEY, "split", F.col("value").alias("actual"), F.col("lag1").alias("predicted")
    )
    return rounded(evaluate.evaluate(scored, [KEY, "split"]), 5)


def messy_pipeline_eval(spark, folder):
    """Text dates and text numbers, in arrival order, through to forecast errors."""
    raw = table(spark, folder, "events").select(
        "event_id", "user_id", series.date_text().alias("timestamp"), series.number_text().alias("energy")
    )
    spec = replace(PANEL, order=("seq",))
    rows = prepare.prepare_series(raw, "energy", "event_id", key="user_id", spec=spec)
    out = features.forecasting_features(Panel.of(rows, spec), leak_safe=False)
    kept = out.map(lambda d: features.drop_warmup(d, [*features.feature_names(), "value"])).renumber()
    scored = splits.split_floor(kept).rows(
        KEY, "split", F.col("value").alias("actual"), F.col("lag1").alias("predicted")
    )
    errors = evaluate.evaluate(scored, [KEY, "split"])
    return rounded(errors.select(KEY, "split", "n_rows", "rmse", "mae"), 4)


def persistence_windows_eval(spark, folder):
    """The last value of each window as its prediction, in the windows of both parts."""
    parts = windows.split_windows(splits.split_ceil_overlap(Panel.of(user_events(spark, folder))))
    scored = parts.select(KEY, "split", F.col("y").alias("actual"), F.element_at("x", -1).alias("predicted"))
    return rounded(evaluate.evaluate(scored, [KEY, "split"]), 5)


def mean_benchmark(spark, folder):
    split = splits.split_floor(Panel.of(user_events(spark, folder)))
    return rounded(profile.target_mean(split.rows()), 5)


def baseline_compare(spark, folder):
    errors = compare.baseline_errors(Panel.of(user_events(spark, folder)))
    ranked = evaluate.rank_models(errors, KEY)
    return rounded(ranked.select(KEY, "model", "rmse", "mae", "rank"), 5)


def baseline_side_by_side(spark, folder):
    errors = compare.baseline_errors(_hourly_panel(spark, folder))
    return rounded(evaluate.side_by_side(errors, KEY, ["persistence", "train_mean"]), 5)


def rf_eval(spark, folder):
    """Errors of a hundred trees on lags, by series and part."""
    return rounded(forecaster.EnsembleForecaster("random_forest").fit(Panel.of(user_events(spark, folder))).errors(), 5)


def rf_date_parts_eval(spark, folder):
    return rounded(forecaster.EnsembleForecaster("random_forest", features="date_parts").fit(_hourly_panel(spark, folder)).errors(), 5)


def gbt_eval(spark, folder):
    """Errors after a hundred rounds, by series and part."""
    return rounded(forecaster.EnsembleForecaster("boosted_trees").fit(Panel.of(user_events(spark, folder))).errors(), 5)


def gbt_loss_curve(spark, folder):
    """Train and validation loss after each of a hundred rounds."""
    return rounded(forecaster.SequenceForecaster("boosted_trees_slow").fit(Panel.of(user_events(spark, folder))).loss_curve(), 8)


def model_compare(spark, folder):
    """Errors and rank of the three tree models and both baselines on the test part."""
    names = ["random_forest", "boosted_trees", "boosted_trees_slow"]
    errors = compare.compare_models(_hourly_panel(spark, folder), [forecaster.EnsembleForecaster(n) for n in names])
    return rounded(evaluate.rank_models(errors, KEY).select(KEY, "model", "n_rows", "rmse", "mae", "rank"), 5)


def sequence_predictions(spark, folder):
    fitted = forecaster.SequenceForecaster().fit(Panel.of(user_events(spark, folder)))
    return rounded(fitted.predictions(), 4)


def sequence_predictions_1(spark, folder):
    """Windows of one value, so that the fit is a plain regression line."""
    fitted = forecaster.SequenceForecaster(length=1).fit(Panel.of(user_events(spark, folder)))
    return rounded(fitted.predictions(), 4)


def sequence_eval_1(spark, folder):
    fitted = forecaster.SequenceForecaster(length=1).fit(Panel.of(user_events(spark, folder)))
    return rounded(fitted.errors().select(KEY, "split", "n_rows", "rmse", "mae"), 4)


def sequence_eval(spark, folder):
    fitted = forecaster.SequenceForecaster().fit(Panel.of(user_events(spark, folder)))
    return rounded(fitted.errors(), 4)


def tree_forecast(spark, folder):
    """A forest's forecasts, steps as long as the data's own."""
    return rounded(forecaster.SequenceForecaster("random_forest").fit(_hourly_panel(spark, folder)).forecast(HORIZON, step="infer"), 5)


def tree_forecast_year(spark, folder):
    """365 steps of a forest of a hundred trees, in one stage."""
    return rounded(forecaster.SequenceForecaster("random_forest").fit(_hourly_panel(spark, folder)).forecast(365), 5)


RECURRENT = {"units": 16, "epochs": 12, "batches": 4, "rate": 0.02}


def recurrent_eval(spark, folder):
    """Errors of a recurrent model on twelve values, by series and part."""
    return rounded(forecaster.SequenceForecaster("recurrent", settings=RECURRENT).fit(_hourly_panel(spark, folder)).errors(), 5)


def recurrent_loss_curve(spark, folder):
    """Train and validation loss of a recurrent model after each epoch."""
    return rounded(forecaster.SequenceForecaster("recurrent", settings=RECURRENT).fit(Panel.of(user_events(spark, folder))).loss_curve(), 6)


def recurrent_forecast(spark, folder):
    """A month of a recurrent model fed with its own output, steps as long as the data's own."""
    return rounded(forecaster.SequenceForecaster("recurrent", settings=RECURRENT).fit(_hourly_panel(spark, folder)).forecast(30, step="infer"), 5)


# Saving, many datasets, one long series


def save_load_forecast(spark, folder):
    """Forecast of a saved and reloaded model."""
    fitted = forecaster.SequenceForecaster(length=1).fit(Panel.of(user_events(spark, folder)))
    path = scratch_path(spark, "forecaster")
    fitted.save(path)
    return rounded(forecaster.FittedSequence.load(spark, path).forecast(HORIZON), 4)


def sequence_forecast(spark, folder):
    """Windows of twelve values, a month ahead, steps as long as the data's own."""
    fitted = forecaster.SequenceForecaster(aligned=True, clamp=True).fit(Panel.of(user_events(spark, folder)))
    return rounded(fitted.forecast(30, step="infer"), 4)


def series_roundtrip(spark, folder):
    path = scratch_path(spark, "series")
    ev = user_events(spark, folder)
    files.write_series(ev, path, "csv")
    schema = "ts timestamp_ntz, series_id string, seq bigint, value double"
    return files.read_series(spark, path, "csv", schema)


def csv_roundtrip(spark, folder):
    """Events written as plain CSV and read again with a schema."""
    path = scratch_path(spark, "csv")
    table(spark, folder, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "event_id bigint, event_type string, value double")


def quoted_csv_roundtrip(spark, folder):
    """Events with every header and value wrapped in literal quotes, read as the telemetry layout is."""
    path = scratch_path(spark, "quoted")
    ev = table(spark, folder, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    quoted = ev.select(*(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')).alias(f'"{c}"') for c in ev.columns))
    quoted.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    return files.read_quoted_csv(spark, path, {"event_id": "bigint", "event_type": "string", "ts": "timestamp_ntz"})


def strict_timestamps(spark, folder):
    """Text in one known layout, all of which must be read."""
    text = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    ev = table(spark, folder, "events")
    return ev.select("event_id", dates.parse_timestamp(text, "dd/MM/yyyy HH:mm:ss", strict=True).alias("parsed"))


def reuse_forecast(spark, folder):
    """Trained and saved at first, read back the second time, with the same forecasts."""
    panel, path = Panel.of(user_events(spark, folder)), scratch_path(spark, "reused")
    made = [
        store.load_or_train(spark, path, forecaster.FittedSequence.load, lambda: forecaster.SequenceForecaster(length=1).fit(panel))
        for _ in range(2)
    ]
    return rounded(made[1].forecast(HORIZON), 4)


def panel_union(spark, folder):
    """Four datasets as one panel, evaluated in one job."""
    union = files.combine(
        {
            "user": user_events(spark, folder),
            "type": hourly_avg(spark, folder),
            "day": daily_orders(spark, folder),
            "month": monthly_orders(spark, folder),
        }
    )
    errors = evaluate.evaluate(compare.persistence(Panel.of(union)), [KEY, "split"])
    return rounded(errors.select(KEY, "split", "n_rows", "rmse", "mae"), 3)


def long_series_features(spark, folder):
    """Features of one long series that is cut into blocks."""
    panel = Panel.of(all_events(spark, folder), layout="blocks")
    value = F.col("value")
    history, columns = features.lag_rolling_columns(value)
    # All columns in one window pass: the blocks are shuffled once.
    out = panel.over(
        max(history, windows.WINDOW_LENGTH),
        lambda w: {**columns(w), "x": windows.history_column(value, w)},
    )
    return out.rows(
        "seq", "pos", r("lag1").alias("lag1"), r("lag2").alias("lag2"),
        r("rolling_mean_3").alias("rolling_mean_3"), joined(F.col("x")).alias("x"),
    )


def long_series_acf(spark, folder):
    panel = Panel.of(all_events(spark, folder), layout="blocks")
    return rounded(diagnostics.acf(panel, 20))


def long_series_acf_1000(spark, folder):
    """A thousand lags of one series that is cut: blocks are transformed, no lag is a column or a row of its own."""
    return rounded(diagnostics.acf(Panel.of(all_events(spark, folder), layout="blocks"), 1000))


def acf_240(spark, folder):
    """Ten days of hourly lags for every series."""
    return rounded(diagnostics.acf(_hourly_panel(spark, folder), 240))


QUERIES = {
    f.__name__: f
    for f in (
        table_profile, null_counts, clean_numeric, parse_dates_first_match, parse_dates_most_specific, unread_dates,
        parse_iso, concat_day_hour, dropna_then_project, preview_head_tail, first_rows,
        calendar_features, cyclical_features, lag_rolling_features, leak_safe_features, warmup_drop,
        split_floor, split_ceil_overlap, split_ceil_overlap_hourly, split_counts,
        minmax_fit_apply, minmax_inverse,
        sliding_windows, split_sliding_windows, last_window, slide_append, window_null_gate,
        hour_profile_sum, hour_profile_mean, differenced, acf_20, pacf_2, pacf_20, adf_lag0, adf_auto,
        line_extract, line_buckets,
        ar1_fit_aic, ar1_in_sample, ar1_forecast, best_ar_order, arima_grid, arima_eval, arima_ar_eval, arima_ma_in_sample, long_series_ma_in_sample,
        linear_window_forecast, linear_window_forecast_12, future_dates,
        persistence_eval, messy_pipeline_eval, persistence_windows_eval, mean_benchmark, baseline_compare, baseline_side_by_side,
        rf_eval, rf_date_parts_eval, gbt_eval, gbt_loss_curve, model_compare,
        sequence_predictions, sequence_predictions_1, sequence_eval, sequence_eval_1, sequence_forecast, tree_forecast, tree_forecast_year,
        recurrent_eval, recurrent_loss_curve, recurrent_forecast,
        save_load_forecast, series_roundtrip, csv_roundtrip, quoted_csv_roundtrip, strict_timestamps, reuse_forecast, panel_union, long_series_features, long_series_acf, long_series_acf_1000, acf_240,
    )
}
