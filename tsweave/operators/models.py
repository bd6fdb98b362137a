"""Tree and linear regressors over a whole panel, as pyspark.ml pipelines.

One global model is fitted for all series of a panel; level and spread of each
series over its train rows are features, so the model can tell series apart.
Library defaults for the tree counts follow common practice (100 trees or
rounds); the trees are depth-limited, as every Spark tree is.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tsweave.functions.calendar import add_date_parts
from tsweave.operators.features import drop_warmup, feature_names, forecasting_features
from tsweave.operators.forest import FlatForest, is_trees, running_losses
from tsweave.operators.panel import Panel
from tsweave.operators.splits import split_floor
from tsweave.session import materialise
from tsweave.spec import SeriesSpec

SEED = 42
SERIES_FEATURES = ["series_mean", "series_std"]
DATE_PART_FEATURES = [
    "year", "month", "day", "hour", "weekday", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"
]


def regressor(kind: str, label: str, **settings):
    """A regressor by name; ``settings`` override its defaults."""
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "predicted"}
    if kind == "linear":
        return LinearRegression(**{**common, **settings})
    common["seed"] = SEED
    if kind == "random_forest":
        return RandomForestRegressor(
            **{**common, "numTrees": 100, "maxDepth": 10, "maxBins": 128, "featureSubsetStrategy": "all", **settings}
        )
    if kind == "boosted_trees":
        return GBTRegressor(**{**common, "maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "maxBins": 128, **settings})
    if kind == "boosted_trees_slow":
        return GBTRegressor(**{**common, "maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "maxBins": 128, **settings})
    raise ValueError(f"unknown model {kind!r}")


def table_pipeline(kind: str, features: list[str], label: str, **settings) -> Pipeline:
    """Feature columns to prediction."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), regressor(kind, label, **settings)])


def window_pipeline(kind: str, length: int, label: str = "y", **settings) -> Pipeline:
    """Window array ``x`` to prediction."""
    names = [f"x_{i}" for i in range(length)]
    items = ", ".join(f"x[{i}] AS {n}" for i, n in enumerate(names))
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {items} FROM __THIS__"),
            VectorAssembler(inputCols=names, outputCol="features"),
            regressor(kind, label, **settings),
        ]
    )


def fit_pipeline(pipeline: Pipeline, train: DataFrame, columns: list[str]) -> PipelineModel:
    """Fit on the named columns only.

    Trees read their input several times, so it is written down first; a linear
    fit reads it once.
    """
    data = train.select(*columns)
    if not isinstance(pipeline.getStages()[-1], LinearRegression):
        data = materialise(data, "training")
    return pipeline.fit(data)


def training_frame(panel: Panel, leak_safe: bool = True, features: str = "lags") -> tuple[DataFrame, list[str]]:
    """Features, target and split of every usable row, and the feature names.

    ``features="lags"`` gives calendar parts, lags and rolling mean;
    ``"date_parts"`` gives date parts with their cyclical encoding. The split
    is taken after the warm-up rows are gone.
    """
    spec = panel.spec
    if features == "lags":
        ready, names = forecasting_features(panel, leak_safe), feature_names()
    elif features == "date_parts":
        ready, names = panel.map(lambda d: add_date_parts(d, spec.ts)), DATE_PART_FEATURES
    else:
        raise ValueError(f"unknown features {features!r}")
    kept = ready.map(lambda d: drop_warmup(d, [*names, spec.ts, spec.value])).renumber()
    out = split_floor(kept)
    value = F.when(F.col("split") == "train", F.col(spec.value))
    out = out.with_series_stats(series_mean=F.avg(value), series_std=F.stddev_pop(value))
    # A series without train rows has no level yet.
    return out.rows().na.fill(0.0, SERIES_FEATURES), names + SERIES_FEATURES


def predictions(model: PipelineModel, df: DataFrame, spec: SeriesSpec, actual: str | None = None) -> DataFrame:
    """The prediction frame: series, split, time, actual and predicted."""
    return model.transform(df).select(
        spec.key, "split", spec.ts, "pos", F.col(actual or spec.value).alias("actual"), "predicted"
    )


def loss_curve(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Squared loss of train and test rows after every boosting round or tree.

    Every tree scores every row once: the running sums of a row's scores are
    its predictions after each round, and their running means those of a
    forest. Tasks send sums, so one pass gives the whole curve. A linear model
    is fitted at once and has one row.
    """
    if isinstance(model, PipelineModel) and is_trees(model.stages[-1]):
        *prepare, trees = model.stages
        ready = df.select("split", label, *[c for c in df.columns if c not in ("split", label, "predicted")])
        for stage in prepare:
            ready = stage.transform(ready)
        rows = ready.select("split", F.col(label).alias("label"), vector_to_array("features").alias("features"))
        losses = running_losses(rows, FlatForest.of(trees))
    else:
        error = F.col("predicted") - F.col(label)
        scored = model.transform(df).withColumn("iteration", F.lit(1).cast("bigint"))
        losses = scored.groupBy("split", "iteration").agg(F.sum(error * error).alias("loss_sum"), F.count(F.lit(1)).alias("n_rows"))
    mean = F.col("loss_sum") / F.col("n_rows")
    return losses.groupBy("iteration").agg(
        F.max(F.when(F.col("split") == "train", mean)).alias("train_loss"),
        F.max(F.when(F.col("split") == "test", mean)).alias("validation_loss"),
    )
