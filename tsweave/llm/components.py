"""Connected components of a graph given by its edges, on Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import text as T
from tsweave.session import materialise


#: Edges that a task holds at once when it thins its own.
HELD_EDGES = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least one of its component, among these edges alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least
        least = least.copy()
        low = np.minimum(before[left], before[right])
        # Roots hang on the least root across an edge, then every path is cut short.
        np.minimum.at(least, before[left], low)
        np.minimum.at(least, before[right], low)
        while not np.array_equal(least, up := least[least]):
            least = up
        if np.array_equal(least, before):
            hung = np.flatnonzero(least != np.arange(len(nodes)))
            return nodes[hung], nodes[least[hung]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as forests of stars, so that no more than one edge a node and piece travels."""
    held, count = [], 0

    def stars() -> pa.RecordBatch:
        pairs = _forest(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], ["a", "b"])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        count += batch.num_rows
        if count >= HELD_EDGES:
            yield stars()
            held, count = [], 0
    if count:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """One round: hang each node's larger neighbours, then its smaller ones, on the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # The larger node stays in front, as the least one known is never above it; repeated edges go at the end.
    down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    root = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.unionByName(root.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other to one that has none of its own: stars, and nothing left to join."""
    ends = edges.select("a", F.lit(1).alias("hangs")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("hangs")))
    seen = ends.groupBy("a").agg(F.sum("hangs").alias("hung"), F.min("hangs").alias("least"))
    return seen.where("hung > 1 OR hung = 1 AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges`` (``a``, ``b``).

    Nodes are long. Those without edges are not returned; nulls, loops and repeated edges are ignored.
    Tasks first thin their own edges, which leaves the lower node behind. Each round is written to the shared folder; the rounds end when all
    edges are stars, after about the logarithm of the longest path.
    """
    known = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = materialise(known.mapInArrow(T.tidy(_thinned), "a long, b long").distinct(), "edges")
    while not _settled(now):
        now = materialise(_stars(now), "stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
