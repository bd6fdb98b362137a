"""Fitted tree models as flat arrays, evaluated over batches of rows.

A model of any number of trees becomes five arrays of nodes. They are broadcast
and evaluated by numpy, all rows and trees of a batch one level at a time, so
that what needs many evaluations in a row, such as a recursive forecast or a
loss curve, is one stage over the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tsweave.session import scratch_path

#: Rows evaluated at once; each takes a few arrays of one number a tree.
BATCH_ROWS = 4096


@dataclass(frozen=True)
class FlatForest:
    """Nodes of all trees: a row goes to ``left`` where its ``feature`` is at most ``threshold``; leaves have feature -1."""

    feature: np.ndarray = field(repr=False)
    threshold: np.ndarray = field(repr=False)
    left: np.ndarray = field(repr=False)
    right: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    roots: np.ndarray
    weights: np.ndarray
    averaged: bool

    @staticmethod
    def of(model) -> FlatForest:
        """From a fitted tree, forest or boosted model, by way of its saved nodes. A model's size does not depend on the data's."""
        spark = SparkSession.getActiveSession()
        path = scratch_path(spark, "trees")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data")
        if "treeID" not in nodes.columns:
            nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        split = F.col("nodeData.split")
        rows = nodes.select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            split["featureIndex"].alias("feature"), F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
            split["numCategories"].alias("categories"),
        ).orderBy("treeID", "id").toPandas()
        inner = rows["leftChild"].to_numpy() >= 0
        if (rows["categories"].to_numpy()[inner] >= 0).any():
            raise ValueError("splits by category are not supported")
        tree, number = rows["treeID"].to_numpy(), rows["id"].to_numpy()
        roots = np.searchsorted(tree, np.arange(tree.max() + 1))
        # Nodes of a tree are numbered without gaps.
        base = roots[tree]
        assert np.array_equal(base + number, np.arange(len(rows)))
        single = isinstance(model, DecisionTreeRegressionModel)
        return FlatForest(
            np.where(inner, rows["feature"], -1).astype(np.int32), np.where(inner, rows["threshold"], 0.0),
            np.where(inner, base + rows["leftChild"], 0).astype(np.int32), np.where(inner, base + rows["rightChild"], 0).astype(np.int32),
            rows["prediction"].to_numpy(float), roots, np.ones(1) if single else np.asarray(model.treeWeights, float),
            isinstance(model, RandomForestRegressionModel),
        )

    def by_tree(self, x: np.ndarray) -> np.ndarray:
        """The value of every tree for every row of ``x``."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[node]
            goes_left = x[row, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)

    def running(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the first tree, the first two, and so on, as columns."""
        sums = np.cumsum(self.by_tree(x) * (1.0 if self.averaged else self.weights), axis=1)
        return sums / np.arange(1, len(self.roots) + 1) if self.averaged else sums

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.running(x)[:, -1]


def is_trees(model) -> bool:
    return hasattr(model, "treeWeights") or isinstance(model, DecisionTreeRegressionModel)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def recursive_path(seeds: DataFrame, forest: FlatForest, horizon: int, window: str = "x") -> DataFrame:
    """Add ``path``: ``horizon`` predictions, each from the window with the ones before it slid in, in one stage.

    Windows run from the oldest value to the newest. A window with a null or a
    not-a-number has a path of nulls; windows of one table are equally long.
    ``forest`` may be any model with a ``predict`` of its own.
    """
    shared = seeds.sparkSession.sparkContext.broadcast(forest)
    kept = [f for f in seeds.schema.fields if f.name != "path"]
    place = [f.name for f in kept].index(window)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(begin, BATCH_ROWS)
                x = _matrix(batch.column(place))
                bad = np.isnan(x).any(1)
                x = np.where(bad[:, None], 0.0, x)
                path = np.empty((len(x), horizon))
                for step in range(horizon):
                    path[:, step] = trees.predict(x)
                    x = np.concatenate([x[:, 1:], path[:, step : step + 1]], axis=1)
                ends = np.arange(0, path.size + 1, horizon, dtype=np.int32)
                values = pa.array(path.ravel(), mask=np.repeat(bad, horizon))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, values)], [*(f.name for f in kept), "path"])

    schema = StructType([*kept, StructField("path", ArrayType(DoubleType()))])
    return seeds.select(*(f"`{f.name}`" for f in kept)).mapInArrow(walk, schema)


def running_losses(rows: DataFrame, forest: FlatForest) -> DataFrame:
    """``split, iteration, loss_sum, n_rows`` after each tree, from ``split, label, features`` (an array).

    Each task sends one row for each part and tree.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(begin, BATCH_ROWS)
                error = trees.running(_matrix(batch.column(2))) - batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                split = np.array(batch.column(0).to_pylist(), object)
                for name in set(split.tolist()):
                    own = split == name
                    sums[name] = sums.get(name, 0.0) + (error[own] ** 2).sum(0)
                    counts[name] = counts.get(name, 0) + int(own.sum())
        for name, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array(np.arange(1, n + 1)), pa.array(total), pa.array([counts[name]] * n, pa.int64())],
                ["split", "iteration", "loss_sum", "n_rows"],
            )

    out = rows.select("split", F.col("label").cast("double"), "features").mapInArrow(losses, "split string, iteration long, loss_sum double, n_rows long")
    return out.groupBy("split", "iteration").agg(F.sum("loss_sum").alias("loss_sum"), F.sum("n_rows").alias("n_rows"))
