"""Forecast errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: the smallest denominator of the guarded percentage error.
EPSILON = 2.220446049250313e-16


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """MSE, RMSE, MAE and both forms of the mean absolute percentage error.

    ``mape`` is a fraction with the denominator kept above zero; ``mape_pct``
    is in percent and skips actual values of zero, which ``n_zero`` counts.
    """
    both = actual.isNotNull() & predicted.isNotNull()
    error = predicted - actual
    square = error * error
    return {
        "n_rows": F.count_if(both),
        "mse": F.avg(square),
        "rmse": F.sqrt(F.avg(square)),
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.abs(error) / F.greatest(F.abs(actual), F.lit(EPSILON))),
        "mape_pct": F.avg(F.abs(F.try_divide(error, actual))) * 100,
        "n_zero": F.count_if(both & (actual == 0)),
    }


def evaluate(
    df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row of errors per group; rows without a prediction do not count."""
    columns = error_columns(F.col(actual), F.col(predicted))
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def rank_models(errors: DataFrame, key: str, measure: str = "rmse") -> DataFrame:
    """Rank the models of each series by their test error, best first; those without an error come last."""
    known = F.when(~F.isnan(measure), F.col(measure))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(known), "model")
    return errors.where(F.col("split") == "test").withColumn("rank", F.row_number().over(w))


def side_by_side(errors: DataFrame, key: str, models: list[str], measure: str = "rmse") -> DataFrame:
    """One column per model."""
    return errors.groupBy(key, "split").pivot("model", models).agg(F.first(measure))
