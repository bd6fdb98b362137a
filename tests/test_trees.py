"""Flat tree models, and the tree queries' results against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tsweave.operators import evaluate, models
from tsweave.operators.forecast import recursive_model, recursive_steps
from tsweave.operators.forest import FlatForest
from tsweave.operators.panel import Panel
from tsweave.plans import compare
from tsweave.plans.forecaster import EnsembleForecaster, SequenceForecaster

SETTINGS = {
    "random_forest": {"numTrees": 7, "maxDepth": 5}, "boosted_trees": {"maxIter": 6, "maxDepth": 4}, "boosted_trees_slow": {"maxIter": 5, "maxDepth": 3},
}


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, n, level in (("a", 300, 5.0), ("b", 180, 90.0)):
        y = level + level / 5 * np.sin(np.arange(n) / 5) + rng.normal(size=n)
        rows += [(key, i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, seq bigint, value double")
    return df.selectExpr("series_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(seq)) AS ts", "seq", "value")


@pytest.mark.parametrize("kind", sorted(SETTINGS))
def test_flat_trees_equal_the_model(noisy, kind):
    fitted = EnsembleForecaster(kind, settings=SETTINGS[kind]).fit(Panel.of(noisy))
    *prepare, trees = fitted.model.stages
    rows = fitted.model.transform(fitted.frame).select(vector_to_array("features").alias("x"), "predicted").toPandas()
    flat = FlatForest.of(trees)
    x = np.array(rows["x"].to_list())
    np.testing.assert_allclose(flat.predict(x), rows["predicted"], rtol=1e-12)
    assert len(flat.roots) == trees.getNumTrees and flat.by_tree(x[:3]).shape == (3, trees.getNumTrees)


@pytest.mark.parametrize("kind", sorted(SETTINGS))
def test_recursion_in_one_stage_equals_stepwise_transform(noisy, kind):
    fitted = SequenceForecaster(kind, settings=SETTINGS[kind]).fit(Panel.of(noisy))
    holed = fitted.state.withColumn("series_id", F.concat("series_id", F.lit("-holed"))).withColumn(
        "x", F.transform("x", lambda v, i: F.when(i != 3, v))
    )
    seeds = fitted.state.unionByName(holed)
    one = recursive_model(seeds, fitted.model, 23)
    got = {r.series_id: r.path for r in one.collect()}
    want = {r.series_id: r.path for r in recursive_steps(seeds, fitted.model, 23).collect()}
    assert set(got) == {"a", "b", "a-holed", "b-holed"} and got["a-holed"] == [None] * 23
    for key, path in want.items():
        assert path == got[key] if path[0] is None else got[key] == pytest.approx(path, rel=1e-9)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "predicted" not in plan


def test_a_year_ahead(noisy):
    fitted = SequenceForecaster("random_forest", settings=SETTINGS["random_forest"]).fit(Panel.of(noisy))
    out = fitted.forecast(365).groupBy("series_id").agg(F.count("predicted").alias("n"), F.max("step").alias("last")).collect()
    assert {(r.n, r["last"]) for r in out} == {(365, 365)}


def numpy_errors(actual, predicted):
    error = predicted - actual
    return {"mse": np.mean(error**2), "rmse": np.sqrt(np.mean(error**2)), "mae": np.mean(np.abs(error))}


@pytest.mark.parametrize("kind, parts", [("random_forest", "lags"), ("random_forest", "date_parts"), ("boosted_trees", "lags")])
def test_errors_are_those_of_the_predictions(noisy, kind, parts):
    fitted = EnsembleForecaster(kind, features=parts, settings=SETTINGS[kind]).fit(Panel.of(noisy))
    rows = fitted.predictions().toPandas()
    errors = fitted.errors().collect()
    assert len(errors) == 4
    for r in errors:
        own = rows[(rows["series_id"] == r.series_id) & (rows["split"] == r.split)]
        want = numpy_errors(own["actual"].to_numpy(), own["predicted"].to_numpy())
        assert r.n_rows == len(own) and {k: r[k] for k in want} == pytest.approx(want)


def test_losses_are_those_of_the_first_trees(noisy):
    fitted = SequenceForecaster("boosted_trees_slow", settings=SETTINGS["boosted_trees_slow"]).fit(Panel.of(noisy))
    *prepare, trees = fitted.model.stages
    windows = fitted.windows.select("split", "x", "y").toPandas()
    curve = fitted.loss_curve().orderBy("iteration").collect()
    assert [r.iteration for r in curve] == [1, 2, 3, 4, 5]
    x, y = np.array(windows["x"].to_list()), windows["y"].to_numpy()
    each = np.array([[t.predict(row) for t in trees.trees] for row in fitted.model.transform(fitted.windows).limit(20).select("features").toPandas()["features"]])
    np.testing.assert_allclose(FlatForest.of(trees).by_tree(np.array([r.toArray() for r in fitted.model.transform(fitted.windows).limit(20).select("features").toPandas()["features"]])), each)
    running = FlatForest.of(trees).running(x)
    for r in curve:
        loss = (running[:, r.iteration - 1] - y) ** 2
        assert r.train_loss == pytest.approx(loss[windows["split"] == "train"].mean())
        assert r.validation_loss == pytest.approx(loss[windows["split"] == "test"].mean())


def test_ranks_are_those_of_the_errors(noisy):
    panel = Panel.of(noisy)
    errors = compare.compare_models(panel, [EnsembleForecaster(k, settings=v) for k, v in SETTINGS.items()])
    ranked = evaluate.rank_models(errors, "series_id").toPandas()
    assert len(ranked) == 10
    for _, own in ranked.groupby("series_id"):
        assert own.sort_values("rmse")["rank"].to_list() == [1, 2, 3, 4, 5]


def test_a_single_tree(spark, noisy):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    data = VectorAssembler(inputCols=["seq"], outputCol="features").transform(noisy)
    model = DecisionTreeRegressor(labelCol="value", maxDepth=4).fit(data)
    x = np.arange(0, 300, 7, dtype=float)[:, None]
    want = [model.predict(v) for v in (r.features for r in VectorAssembler(inputCols=["v"], outputCol="features").transform(spark.createDataFrame([(float(v),) for v in x[:, 0]], "v double")).collect())]
    np.testing.assert_allclose(FlatForest.of(model).predict(x), want)
