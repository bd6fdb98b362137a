"""URL filter: rules first, then the ratio of two character models.

Two Markov models of variable order, one of accepted and one of rejected
URLs, give every character its probability after the longest context that was
seen, mixed with shorter ones by the Witten-Bell rule: a context that was
followed by many different characters trusts itself less, and one never seen
leaves all to the shorter. A URL's score is the mean difference of its log
likelihoods; where the cut lies is fitted on URLs that the models have not seen.

URLs train the models when a rule judges them. Characters fall into 32
classes, so a model is a table of ``32 ** ORDER`` numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tsweave.llm import text as T

#: Characters looked at: one and those before it.
ORDER, CLASSES = 4, 32
#: One in this many judged URLs is held out to fit the cut.
HELD_OUT = 5
#: Bins of the held-out scores, from -RANGE to RANGE.
BINS, RANGE = 4001, 4.0

#: Fixed rules of the filter: verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

_CLASS = np.full(256, 31, np.uint32)
_CLASS[[*range(97, 123)]] = np.arange(1, 27)
_CLASS[[*range(65, 91)]] = np.arange(1, 27)
_CLASS[[*range(48, 58)]] = 27
_CLASS[[ord(c) for c in "/"]] = 28
_CLASS[[ord(c) for c in "."]] = 29
_CLASS[[ord(c) for c in "-_"]] = 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(begin))
        name = F.when(fits, F.lit(own + begin)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _contexts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every character its class and those of the ``ORDER - 1`` before it, as one number; 0 stands before a URL."""
    kind = _CLASS[raw]
    key = kind.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(kind)
        before[back:] = kind[:-back] if len(kind) > back else 0
        for k in range(back):
            starts = at[:-1] + k
            before[starts[starts < at[1:]]] = 0
        key |= before << np.uint32(5 * back)
    return key


@dataclass(frozen=True)
class UrlModel:
    """Log ratio of each character in its context, and the cut between blocked and allowed scores."""

    ratios: np.ndarray
    cut: float

    @staticmethod
    def fit(pages: DataFrame, rules=RULES) -> UrlModel:
        """Models of all URLs that ``rules`` judge; one in ``HELD_OUT`` fits the cut. What the driver gets is bounded by the tables."""
        host, path = host_and_path(F.col("url"))
        judged = pages.select("url", rule_of(host, path, rules)[1].alias("said")).where("said IS NOT NULL").select(
            "url", (F.col("said") == "allow").cast("int").alias("good"), (F.pmod(F.crc32("url"), F.lit(HELD_OUT)) == 0).alias("held")
        )

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, CLASSES**ORDER), np.int64)
            for batch in T.slices(batches, "url"):
                raw, at = T.laid_out(batch.column(0))
                key, good = _contexts(raw, at), np.repeat(batch.column(1).to_numpy(), np.diff(at))
                for k in (0, 1):
                    sums[k] += np.bincount(key[good == k], minlength=CLASSES**ORDER)
            good, key = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(key), pa.array(sums[good, key])], ["good", "key", "n"])

        rows = (
            judged.where("NOT held").select("url", "good").mapInArrow(count, "good long, key long, n long")
            .groupBy("good", "key").agg(F.sum("n").alias("n")).toPandas()
        )
        counts = np.zeros((2, CLASSES**ORDER))
        counts[rows["good"], rows["key"]] = rows["n"]
        model = UrlModel((_log_probability(counts[1]) - _log_probability(counts[0])).astype(np.float32), 0.0)
        scored = model.scores(judged.where("held").select("url", "good"))
        bin_of = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
        held = scored.groupBy("good", bin_of.alias("bin")).agg(F.count("*").alias("n")).toPandas()
        shares = np.zeros((2, BINS))
        for k in (0, 1):
            own = held[held["good"] == k]
            shares[k, own["bin"].astype(int)] = own["n"] / max(1, own["n"].sum())
        if not shares.any(1).all():
            return model  # one kind only: the cut stays where both models are as likely
        # Least sum of both error rates; the middle of the bins that reach it.
        errors = np.concatenate([[0], np.cumsum(shares[1])]) + 1 - np.concatenate([[0], np.cumsum(shares[0])])
        best = np.flatnonzero(errors <= errors.min() + 1e-12)
        return UrlModel(model.ratios, float(best.mean()) / BINS * 2 * RANGE - RANGE)

    def scores(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``score``: the mean log ratio of the characters of ``url``, 0 for null and empty ones."""
        shared = urls.sparkSession.sparkContext.broadcast(self.ratios)
        rest = [f for f in urls.schema.fields if f.name != "score"]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratios = shared.value
            for batch in T.slices(batches, "url"):
                raw, at = T.laid_out(batch.column(batch.schema.get_field_index("url")))
                sums = np.concatenate([[0.0], np.cumsum(ratios[_contexts(raw, at)], dtype=np.float64)])
                mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean)], [*batch.schema.names, "score"])

        return urls.select(*(f"`{f.name}`" for f in rest)).mapInArrow(score, StructType([*rest, StructField("score", DoubleType())]))


def _log_probability(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell log probability of the last character of every context, from counts of the longest."""
    shape = (CLASSES,) * ORDER
    table = counts.reshape(shape)
    lower = np.full(CLASSES, 1 / CLASSES)
    for length in range(1, ORDER + 1):
        own = table.sum(axis=tuple(range(ORDER - length)))
        seen, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        mixed = (own + kinds * lower) / np.maximum(seen + kinds, 1)
        lower = np.where(seen > 0, mixed, np.broadcast_to(lower, own.shape))
    return np.log(lower).ravel()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``.

    Null and empty URLs, and those without ``://``, have an empty host and path and fit no rule. A URL
    that fits no rule is allowed if its score reaches the cut; one without characters is allowed, as
    nothing speaks against it. Repeated rows are judged alike; other columns are not read.
    """
    model = UrlModel.fit(pages.select("url"), rules)
    host, path = host_and_path(F.col("url"))
    out = model.scores(pages.select("page_id", "url")).withColumns({"host": host, "path": path})
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when((F.coalesce(F.length("url"), F.lit(0)) == 0) | (F.col("score") >= F.lit(model.cut)), "allow").otherwise("block")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(said, learned).alias("verdict"), "score")
