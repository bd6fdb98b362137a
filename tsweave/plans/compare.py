"""Baselines and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsweave.operators.evaluate import evaluate
from tsweave.operators.panel import Panel
from tsweave.operators.splits import split_floor
from tsweave.plans.forecaster import EnsembleForecaster


def persistence(panel: Panel) -> DataFrame:
    """Every row predicted by the row before it; the first row has no prediction."""
    spec = panel.spec
    held = panel.over(1, lambda w: {"predicted": F.lag(spec.value, 1).over(w)})
    return split_floor(held).rows(
        spec.key, "split", spec.ts, "pos", F.col(spec.value).alias("actual"), "predicted"
    )


def mean_forecast(panel: Panel) -> DataFrame:
    """Every row predicted by the train mean of its series."""
    spec = panel.spec
    split = split_floor(panel)
    train = F.when(F.col("split") == "train", F.col(spec.value))
    return split.with_series_stats(predicted=F.avg(train)).rows(
        spec.key, "split", spec.ts, "pos", F.col(spec.value).alias("actual"), "predicted"
    )


def baseline_errors(panel: Panel) -> DataFrame:
    """Errors of both baselines per series and part, from one pass over the panel."""
    spec = panel.spec
    held = split_floor(panel.over(1, lambda w: {"_last": F.lag(spec.value, 1).over(w)}))
    train = F.when(F.col("split") == "train", F.col(spec.value))
    both = held.with_series_stats(_mean=F.avg(train)).df.select(
        spec.key, "split", F.col(spec.value).alias("actual"),
        F.explode(F.create_map(F.lit("persistence"), F.col("_last"), F.lit("train_mean"), F.col("_mean"))).alias(
            "model", "predicted"
        ),
    )
    return evaluate(both, [spec.key, "model", "split"])


def compare_models(panel: Panel, candidates: list[EnsembleForecaster]) -> DataFrame:
    """Errors of the candidates and of the baselines, one row per series, model and part."""
    out = baseline_errors(panel)
    for candidate in candidates:
        out = out.unionByName(candidate.fit(panel).errors())
    return out
