"""Files, saved forecasters, end-to-end runs and streams."""

import subprocess
import sys
from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsweave.functions.dates import parse_dates
from tsweave.operators import evaluate, models
from tsweave.operators.panel import Panel
from tsweave.plans import compare
from tsweave.plans.forecaster import (
    EnsembleForecaster, FittedSequence, SequenceForecaster, arima_run, series_linear_forecast,
)
from tsweave.plans.prepare import prepare_series
from tsweave.session import materialise, scratch_path, shared_dir
from tsweave.sources import files, store
from tsweave.streaming.scoring import prepare_stream, score_stream

SMALL = {"numTrees": 5, "maxDepth": 4, "maxBins": 32}
BOOST = {"maxIter": 4, "maxDepth": 3, "maxBins": 32}


@pytest.fixture(scope="module")
def seasonal(spark):
    """Two hourly series with a daily cycle, and one of them much larger."""
    rng = np.random.default_rng(0)
    rows = [
        (key, i, float(level + size * np.sin(2 * np.pi * i / 24) + size * 0.05 * rng.normal()))
        for key, level, size in (("a", 50, 10), ("b", 500, 80)) for i in range(400)
    ]
    df = spark.createDataFrame(rows, "series_id string, seq bigint, value double")
    return df.selectExpr("series_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(seq)) AS ts", "seq", "value")


def test_read_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("DATE,V\n1/1/1985,72.5052\n2/1/1985,70.672\n")
    df = files.read_csv(spark, str(tmp_path / "m.csv"))
    assert dict(df.dtypes) == {"DATE": "string", "V": "double"}
    got = df.select(parse_dates(F.col("DATE"), "first_match").alias("ts"), "V").collect()
    assert [tuple(r) for r in got] == [(dt(1985, 1, 1), 72.5052), (dt(1985, 2, 1), 70.672)]
    typed = files.read_csv(spark, str(tmp_path / "m.csv"), "DATE string, V string")
    assert typed.first().V == "72.5052"


def test_read_quoted_csv(spark, tmp_path):
    q = '"""'
    head = "," + ",".join(f"{q}{c}{q}" for c in ["MAC", "weekday", "fecha_servidor", "voltaje", "fp"])
    lines = [f"255,{q}AC:67{q},{q}4{q},{q}2021-11-25 14:33:14{q},{q}118.3{q},{q}0.9{q}",
             f"256,{q}AC:68{q},{q}5{q},{q}bad{q},{q}x{q},{q}{q}"]
    (tmp_path / "t.csv").write_text("\n".join([head, *lines]) + "\n")
    df = files.read_quoted_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.orderBy("_c0").collect()] == [
        (255, "AC:67", 4, dt(2021, 11, 25, 14, 33, 14), 118.3, 0.9), (256, "AC:68", 5, None, None, None)]
    rows = prepare_series(df, "voltaje", "_c0", ts="fecha_servidor", key="MAC").collect()
    assert [tuple(r) for r in rows] == [("AC:67", dt(2021, 11, 25, 14, 33, 14), 255, 118.3)]


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_series_round_trip(spark, panel_of, tmp_path, fmt):
    df = panel_of({"a": [1, 2.5, None], "b": [4]}).withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, 0.000123)"))
    files.write_series(df, str(tmp_path / "s"), fmt)
    schema = "ts timestamp_ntz, series_id string, seq bigint, value double"
    back = files.read_series(spark, str(tmp_path / "s"), fmt, schema if fmt == "csv" else None)
    assert back.columns[0] == "ts"
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == 4


def test_combine_keeps_keys_apart(panel_of):
    both = files.combine({"x": panel_of({"a": [1]}), "y": panel_of({"a": [2, 3]})})
    assert {r.series_id: r["count"] for r in both.groupBy("series_id").count().collect()} == {"x/a": 1, "y/a": 2}


def test_prepare_drops_rows_with_any_gap(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "1,000", "x", 0), ("2024-01-02", "-2", None, 1), ("bad", "-3%", "x", 2), ("2024-01-03", None, "x", 3)],
        "timestamp string, v string, other string, row int")
    got = prepare_series(df, "v", "row").orderBy("seq").collect()
    assert [(r.ts, r.seq, r.value) for r in got] == [(dt(2024, 1, 1), 0, 1000.0), (None, 2, -3.0)]
    kept = prepare_series(df, "v", "row", drop_gaps=False, signed=False).orderBy("seq").collect()
    assert [r.value for r in kept] == [1000.0, 2.0, 3.0, None]


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    df = spark.range(5)
    again = materialise(df, "t")
    assert again.count() == 5 and again.dtypes == df.dtypes


def test_written_tables_are_released(tmp_path):
    """In a process of its own, as release() takes everything the application wrote."""
    code = """
import os, sys
from tsweave.session import local_session, materialise, run_dir, written_tables
spark = local_session(1, "release", **{"spark.checkpoint.dir": "file:" + sys.argv[1]})
with written_tables(spark) as folder:
    assert materialise(spark.range(3), "t").count() == 3
    assert os.listdir(folder.removeprefix("file:"))
assert not os.path.exists(folder.removeprefix("file:"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, timeout=120)


def test_saved_forecaster(spark, seasonal):
    for config in (SequenceForecaster(), SequenceForecaster("random_forest", settings=SMALL)):
        fitted = config.fit(Panel.of(seasonal))
        path = scratch_path(spark, "test")
        assert not store.artefact_exists(spark, path)
        made = store.load_or_train(spark, path, FittedSequence.load, lambda: fitted)
        assert made is fitted and store.artefact_exists(spark, path)
        loaded = store.load_or_train(spark, path, FittedSequence.load, lambda: 1 / 0)
        assert loaded.config == config
        for step in ("days", "infer"):
            a = fitted.forecast(14, step).orderBy("series_id", "step").collect()
            b = loaded.forecast(14, step).orderBy("series_id", "step").collect()
            assert a == b and len(a) == 28
        if config.model == "linear":
            assert [r.date for r in a[:2]] == [dt(2024, 1, 17, 15), dt(2024, 1, 17, 16)]


def test_forecast_by_hand(seasonal):
    """The linear forecast equals feeding a numpy model with its own output."""
    fitted = SequenceForecaster().fit(Panel.of(seasonal))
    weights, intercept = fitted.model.weights, fitted.model.intercept
    got = fitted.forecast(40).where("series_id = 'a'").orderBy("step").collect()
    y = np.array([r.value for r in seasonal.where("series_id = 'a'").orderBy("seq").collect()])
    lo, hi = y[:320].min(), y[:320].max()
    x = list((y[-14:-2] - lo) / (hi - lo) * 2 - 1)
    for r in got:
        x.append(float(np.dot(weights, x[-12:]) + intercept))
        assert r.predicted == pytest.approx((x[-1] + 1) / 2 * (hi - lo) + lo, rel=1e-9)
    last = dt(2024, 1, 1) + (dt(2024, 1, 2) - dt(2024, 1, 1)) * 398 / 24
    assert got[0].date == last + (dt(2024, 1, 2) - dt(2024, 1, 1))


def test_linear_fit_equals_library_fit(seasonal):
    """Lag products give the line that a regression on the windows gives."""
    for aligned in (False, True):
        config = SequenceForecaster(length=5, aligned=aligned)
        for panel in (Panel.of(seasonal), Panel.of(seasonal, layout="blocks", block_rows=30)):
            fitted = config.fit(panel)
            train = fitted.windows.where("split = 'train'")
            line = models.fit_pipeline(models.window_pipeline("linear", 5), train, ["x", "y"]).stages[-1]
            assert list(fitted.model.weights) == pytest.approx(list(line.coefficients), rel=1e-6)
            assert fitted.model.intercept == pytest.approx(line.intercept, rel=1e-6, abs=1e-9)


def test_linear_fit_stops_at_nulls(panel_of):
    holed = Panel.of(panel_of({"a": [float(i % 7) if i != 20 else None for i in range(100)]}))
    with pytest.raises(Exception, match="null or NaN"):
        SequenceForecaster().fit(holed)


def test_aligned_forecast_uses_the_last_row(seasonal):
    fitted = SequenceForecaster(aligned=True).fit(Panel.of(seasonal))
    state = fitted.state.where("series_id = 'a'").first()
    last = seasonal.where("series_id = 'a' AND seq = 399").first()
    assert state.last_ts == last.ts
    assert (state.x[-1] + 1) / 2 * (state.hi - state.lo) + state.lo == pytest.approx(last.value)


def test_tree_forecast_past_a_cut_plan(seasonal):
    fitted = SequenceForecaster("random_forest", settings=SMALL).fit(Panel.of(seasonal))
    out = fitted.forecast(23).groupBy("series_id").agg(F.count("*").alias("n"), F.count("predicted").alias("p")).collect()
    assert {(r.n, r.p) for r in out} == {(23, 23)}
    with pytest.raises(ValueError):
        fitted.forecast(0)


def test_every_series_is_forecast(panel_of):
    series = {"long": [float(i % 7) for i in range(100)], "short": [1.0] * 5, "one": [2.0], "gap": [float(i % 5) for i in range(65)],
              "holed": [float(i % 7) if i != 95 else None for i in range(100)]}
    rows = panel_of(series)
    panel = Panel.of(rows.unionByName(panel_of({"x": series["long"]}).selectExpr("cast(null as string) series_id", "ts", "seq", "value")))
    for fitted in (SequenceForecaster(strict=False), SequenceForecaster("random_forest", strict=False, settings=SMALL)):
        got = fitted.fit(panel).forecast(400 if fitted.model == "linear" else 2).collect()
        by = {}
        for r in got:
            by.setdefault(r.series_id, []).append(r)
        assert set(by) == {*series, None} and len({len(v) for v in by.values()}) == 1
        assert {k: v[0].reason for k, v in by.items()} == {
            "long": None, None: None, "gap": None, "short": "too short", "one": "too short", "holed": "null or NaN in the last window"}
        assert all((r.predicted is None) == (r.reason is not None) for r in got)
    own = series_linear_forecast(panel, 3).groupBy("series_id").agg(F.count("*").alias("n"), F.max("reason").alias("reason")).collect()
    assert len(own) == 6 and {r.n for r in own} == {3}
    parity = SequenceForecaster(strict=False, seed_in_test=True).fit(panel).forecast(1).collect()
    assert {r.series_id for r in parity if r.reason == "test part too short"} >= {"gap"}


def test_nulls_in_the_test_part(panel_of):
    holed = Panel.of(panel_of({"a": [float(i % 7) if i != 90 else None for i in range(100)]}))
    fitted = SequenceForecaster().fit(holed)
    with pytest.raises(Exception, match="null or NaN"):
        fitted.errors().collect()
    with pytest.raises(Exception, match="null or NaN"):
        fitted.windows.select("x").collect()
    assert {r.reason for r in fitted.forecast(2).collect()} == {"null or NaN in the last window"}
    lenient = SequenceForecaster(strict=False).fit(holed)
    assert lenient.errors().count() == 2


def test_null_keys_are_a_series(panel_of):
    rows = panel_of({"a": [float(i * i % 11) for i in range(60)]})
    both = rows.unionByName(rows.selectExpr("cast(null as string) series_id", "ts", "seq", "value"))
    for panel in (Panel.of(both), Panel.of(both, layout="blocks", block_rows=10)):
        _, _, errors = arima_run(panel, [(1, 0, 0)])
        found = {(r.series_id, r.split): (r.n_rows, r.rmse) for r in errors.collect()}
        for split in ("train", "test"):
            assert found[None, split] == found["a", split] and found["a", split][1] is not None


def test_loss_curves_of_other_models(seasonal):
    line = SequenceForecaster().fit(Panel.of(seasonal))
    curve = line.loss_curve().collect()
    errors = line.transform(line.windows).selectExpr("split", "actual", "predicted")
    assert [r.iteration for r in curve] == [1] and curve[0].train_loss > 0 and errors.count()
    forest = EnsembleForecaster("random_forest", settings=SMALL).fit(Panel.of(seasonal))
    last = forest.loss_curve().orderBy(F.desc("iteration")).first()
    mse = {r.split: r.mse for r in forest.predictions().groupBy("split").agg(F.avg(F.expr("pow(actual - predicted, 2)")).alias("mse")).collect()}
    assert last.train_loss == pytest.approx(mse["train"]) and last.validation_loss == pytest.approx(mse["test"])


def test_models_without_an_error_rank_last(spark):
    rows = [("a", "test", "none", None), ("a", "test", "nan", float("nan")), ("a", "test", "good", 1.0), ("a", "test", "better", 0.5)]
    ranked = evaluate.rank_models(spark.createDataFrame(rows, "series_id string, split string, model string, rmse double"), "series_id")
    assert [r.model for r in ranked.orderBy("rank").collect()] == ["better", "good", "nan", "none"]


def test_models_beat_the_mean_where_there_is_signal(seasonal):
    panel = Panel.of(seasonal)
    candidates = [EnsembleForecaster("random_forest", settings=SMALL),
                  EnsembleForecaster("boosted_trees", settings=BOOST)]
    errors = {(r.series_id, r.model): r.rmse for r in compare.compare_models(panel, candidates).where("split = 'test'").collect()}
    for key in ("a", "b"):
        assert errors[key, "random_forest"] < errors[key, "train_mean"] / 2
        assert errors[key, "boosted_trees"] < errors[key, "train_mean"]
    sequence = {r.series_id: r.rmse for r in SequenceForecaster().fit(panel).errors().where("split = 'test'").collect()}
    assert sequence["a"] < errors["a", "train_mean"] / 5


def test_leaking_models_are_labelled(seasonal):
    fitted = EnsembleForecaster("random_forest", leak_safe=False, settings=SMALL).fit(Panel.of(seasonal))
    assert fitted.name == "random_forest (leaking)"
    assert {r.model for r in fitted.errors().collect()} == {fitted.name}


def test_training_frame(seasonal):
    frame, names = models.training_frame(Panel.of(seasonal))
    assert names[-2:] == ["series_mean", "series_std"] and frame.select(*names).na.drop().count() == 2 * 397
    counts = {(r.series_id, r.split): r["count"] for r in frame.groupBy("series_id", "split").count().collect()}
    assert counts["a", "train"] == int(0.8 * 397)
    parts, names = models.training_frame(Panel.of(seasonal), features="date_parts")
    assert parts.count() == 800 and "hour_sin" in names


def test_loss_curve_falls(seasonal):
    for fitted in (
        SequenceForecaster("boosted_trees_slow", settings=BOOST).fit(Panel.of(seasonal)),
        EnsembleForecaster("boosted_trees_slow", settings=BOOST).fit(Panel.of(seasonal)),
    ):
        curve = fitted.loss_curve().orderBy("iteration").collect()
        assert [r.iteration for r in curve] == [1, 2, 3, 4]
        assert curve[-1].train_loss < curve[0].train_loss and curve[-1].validation_loss > 0
    *prepare, boosted = fitted.model.stages
    for split, column in (("train", "train_loss"), ("test", "validation_loss")):
        data = prepare[0].transform(fitted.frame.where(F.col("split") == split))
        expected = boosted.evaluateEachIteration(data, "squared")
        assert [r[column] for r in curve] == pytest.approx(expected)


def test_series_linear_forecast_follows_each_series(seasonal):
    out = series_linear_forecast(Panel.of(seasonal), 24).collect()
    for key, level, size in (("a", 50, 10), ("b", 500, 80)):
        path = [r.predicted for r in sorted(out, key=lambda r: r.step) if r.series_id == key]
        truth = [level + size * np.sin(2 * np.pi * (398 + k) / 24) for k in range(24)]
        assert np.abs(np.array(path) - truth).max() < size * 0.4


def test_arima_run(seasonal):
    panel = Panel.of(seasonal)
    cut = Panel.of(seasonal, layout="blocks", block_rows=50)
    chosen, frame, errors = arima_run(panel)
    assert {(r.series_id, r.split): r["count"] for r in frame.groupBy("series_id", "split").count().collect()} == {
        (k, s): n for k in "ab" for s, n in (("train", 320), ("test", 80))}
    assert frame.where("split = 'test' AND predicted IS NULL").count() == 0
    other = arima_run(cut)[2].orderBy("series_id", "split").collect()
    for a, b in zip(errors.orderBy("series_id", "split").collect(), other):
        assert a.n_rows == b.n_rows and a.rmse == pytest.approx(b.rmse, rel=1e-5)
    assert chosen.count() == 2


def test_streams(spark, seasonal, tmp_path):
    raw = seasonal.selectExpr("series_id AS dev", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp",
                              "concat('$', cast(cast(value AS decimal(10,2)) AS string)) AS v", "seq AS row")
    raw.write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    query = prepare_stream(stream, "v", "row", key="dev").writeStream.format("memory").queryName("prepared").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(60)
    batch = prepare_series(raw, "v", "row", key="dev")
    assert spark.table("prepared").exceptAll(batch).count() == 0 and spark.table("prepared").count() == 800

    fitted = SequenceForecaster().fit(Panel.of(seasonal))
    fitted.windows.write.parquet(str(tmp_path / "windows"))
    stream = spark.readStream.schema(fitted.windows.schema).parquet(str(tmp_path / "windows"))
    query = score_stream(stream, fitted).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(60)
    assert spark.table("scored").count() == fitted.predictions().count()
