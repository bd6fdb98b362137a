"""Quality rules: hashed n-gram log-likelihood ratio of trusted to raw text.

Words and word pairs of every text fall into a fixed number of buckets. Two
multinomials over the buckets, one of trusted documents and one of the whole
corpus, give each document the mean log ratio of its n-grams. A document is
kept when that mean is at least a threshold fixed before: a low quantile of the
trusted documents' own means. No randomness is involved.

The counts are vectors of ``buckets`` numbers, so what reaches the driver and
the workers is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tsweave.llm import text as T
from tsweave.llm.quantiles import order_statistics
from tsweave.llm.trusted import trusted_documents
from tsweave.session import materialise

BUCKETS = 16_384
#: Share of trusted documents that may fall below the threshold, and how far below it a document must lie.
TAIL, MARGIN = 0.001, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Fixed set of characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CODE_POINT = ~T.SPACE
_CODE_POINT[0x80:0xC0] = False

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for every text."""
    begin, end, first = T.words_of(raw, at)
    docs = np.arange(len(at) - 1, dtype=np.uint64) * T.ODD
    windows, place = T.grams(T.hashes(raw, begin, end), first, WINDOW)
    owner = T.owners(first)
    twice = place[T.repeated(T.mix(windows ^ T.mix(docs + T.ODD)[owner[place]]))]
    edges = np.zeros(len(begin) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0

    line_begin, line_end, line_first = T.lines_of(raw, at)
    words_before = np.concatenate([[0], np.cumsum(~T.SPACE[raw])])
    full = np.flatnonzero(words_before[line_end] > words_before[line_begin])
    line_owner = T.owners(line_first)[full]
    keys = T.mix(T.hashes(raw, line_begin[full], line_end[full]) ^ T.mix(docs + T.ODD)[line_owner])
    distinct, head = np.unique(keys, return_index=True)
    del distinct
    texts = len(at) - 1
    return {
        "n_words": np.diff(first),
        "word_chars": T.totals(_CODE_POINT[raw], at),
        "n_symbols": T.totals(_SYMBOL[raw], at),
        "n_dup_lines": np.bincount(line_owner, minlength=texts) - np.bincount(line_owner[head], minlength=texts),
        "n_repeat_words": T.totals(covered, first),
    }


def buckets_of(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text of each."""
    begin, end, first = T.words_of(raw, at)
    word = T.hashes(T.LOWER[raw], begin, end)
    owner = T.owners(first)
    pairs, place = T.grams(word, first, 2)
    keys = np.concatenate([word, pairs]) % np.uint64(buckets)
    return keys.astype(np.int64), np.concatenate([owner, owner[place]])


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """How many n-grams of all documents fall into each bucket. At most ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in T.slices(batches, text):
            keys, _ = buckets_of(*T.laid_out(batch.column(0)), buckets)
            sums += np.bincount(keys, minlength=buckets)
        bucket = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(sums[bucket])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(T.tidy(count), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


@dataclass(frozen=True)
class ImportanceFilter:
    """Log ratio of each bucket and the least mean that is kept."""

    ratios: np.ndarray
    threshold: float

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, tail: float = TAIL, margin: float = MARGIN) -> ImportanceFilter:
        """Counts over all of ``docs``; ``labels`` name the trusted ones, all of which count.

        Without trusted documents every ratio is 0 and every document is kept.
        """
        trusted = trusted_documents(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"))
        counts = np.stack([bucket_counts(docs, buckets), bucket_counts(trusted, buckets)])
        if not counts[1].any():
            return ImportanceFilter(np.zeros(buckets), -np.inf)
        share = (counts + 1) / (counts.sum(1, keepdims=True) + buckets)
        model = ImportanceFilter(np.log(share[1]) - np.log(share[0]), -np.inf)
        scored = model.apply(trusted).where("NOT base_failed").select(F.lit("").alias("group"), F.col("score").alias("value"))
        least = order_statistics(materialise(scored, "trusted-scores"), [tail])
        return ImportanceFilter(model.ratios, least[""][1][0] - margin if least else -np.inf)

    def apply(self, docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """``docs`` with the counts, ``score``, ``base_failed`` and ``kept``, each named after ``prefix``.

        Null and empty texts have no words, score 0 and fail the base rules.
        Repeated rows are judged alike. Columns of ``docs`` that carry one of
        these names are replaced.
        """
        ratios, threshold = self.ratios, self.threshold
        names = [prefix + c for c in [*COUNTS, "score"]]
        kept = [f for f in docs.schema.fields if f.name not in {*names, prefix + "base_failed", prefix + "kept"}]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches, text):
                raw, at = T.laid_out(batch.column(batch.schema.get_field_index(text)))
                counts = text_counts(raw, at)
                keys, owner = buckets_of(raw, at, len(ratios))
                n = np.bincount(owner, minlength=len(at) - 1)
                mean = np.bincount(owner, ratios[keys], len(at) - 1) / np.maximum(n, 1)
                new = [pa.array(np.asarray(counts[c], np.int64)) for c in COUNTS] + [pa.array(mean)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

        schema = StructType([*kept, *(StructField(c, DoubleType() if c.endswith("score") else LongType()) for c in names)])
        out = docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(T.tidy(score), schema)
        n, repeat = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        return out.withColumns(
            {prefix + "base_failed": failed, prefix + "kept": ~failed & (F.col(prefix + "score") >= F.lit(float(threshold)))}
        )
