"""Language identification by Bayesian fusion of text and metadata.

Four pieces of evidence are multiplied: how likely the text is under each
language's letter trigrams, the language that the markup declares, the one
that the address names (a path segment or a country suffix), and a prior of
the host. The host prior is a share of grouped counts, smoothed towards the
host's site and that towards all hosts. A class without a language, under
which all trigrams are alike, competes with the languages, so junk is rejected.

Languages are those that some document declares. Trigrams fall into a fixed
number of buckets, so a model is a vector for each language code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from tsweave.llm import text as T

BITS = 15
#: Trigrams of one text are not independent: each counts this much, up to a total.
WEIGHT, MOST_WEIGHT = 0.25, 60.0
#: How often a declared language or an address is right.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
#: Pseudo-documents with which a host is pulled to its site, and a site to all.
HOST_PULL, SITE_PULL = 5.0, 20.0
NO_LANGUAGE, NO_LANGUAGE_PRIOR = "und", 0.01
LEAST_POSTERIOR = 0.5
#: Languages told apart: those that most documents declare. A document of another one is judged among these.
MOST_CLASSES = 256

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def code_of(column: Column) -> Column:
    """Primary language subtag in lower case, or null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def address_code(url: Column) -> Column:
    """The first path segment of two letters, else a two-letter suffix of the host."""
    segment = F.regexp_extract(url, "://[^/?#]*/(?:[^?#]*/)?([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.regexp_extract(F.lower(url), r"://[^/?#]*\.([a-z]{2})(?::[0-9]+)?(?:[/?#]|$)", 1)
    return F.coalesce(F.nullif(segment, F.lit("")), F.nullif(suffix, F.lit("")))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "://([^/?#]+)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The last two labels of a host, or a name without dots."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def markup_code(html: Column) -> Column:
    return code_of(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def _trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of three letters or gaps, and where each text's begin; runs of gaps are left out."""
    b = _LETTERS[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    good = key != 0x202020
    ends = at[1:-1]
    for back in (1, 2):
        good[ends[(ends >= back) & (ends - back < len(good))] - back] = False
    place = np.flatnonzero(good)
    bucket = ((key[place] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    return bucket, np.searchsorted(place, at)


@dataclass(frozen=True)
class LanguageModel:
    """Log likelihood of every bucket under each language."""

    languages: list[str]
    table: np.ndarray = field(repr=False)

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", declared: str = "lang") -> LanguageModel:
        """Trigram counts of all documents by declared language; those that declare none are passed over."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in T.slices(batches, text):
                bucket, first = _trigrams(*T.laid_out(batch.column(0)))
                codes = batch.column(1).dictionary_encode()
                code = np.repeat(codes.indices.to_numpy(), np.diff(first))
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    own = np.bincount(bucket[code == k], minlength=1 << BITS)
                    sums[name] = sums[name] + own if name in sums else own
            for name, own in sums.items():
                full = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(own[full])], ["language", "bucket", "n"]
                )

        code = code_of(F.col(declared)).alias("code")
        # Reads one column. The list is of bounded size, and so are the table and what each task holds.
        named = docs.select(code).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
        classes = [r["code"] for r in named.orderBy(F.desc("n"), "code").limit(MOST_CLASSES).collect()]
        rows = (
            docs.select(text, code).where(F.col("code").isin(classes))
            .mapInArrow(T.tidy(count), "language string, bucket long, n long")
            .groupBy("language", "bucket").agg(F.sum("n").alias("n"))
            .toPandas()
        )
        languages = sorted(rows["language"].unique())
        counts = np.zeros((len(languages), 1 << BITS))
        for k, name in enumerate(languages):
            own = rows[rows["language"] == name]
            counts[k, own["bucket"]] = own["n"]
        # A tenth of a count for every bucket; the last row is the class without a language.
        share = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * (1 << BITS))
        table = np.vstack([np.log(share), np.full(1 << BITS, -BITS * np.log(2))])
        return LanguageModel(languages, table.astype(np.float32))

    def likelihoods(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` without the text, with the weighted log likelihood of each class in ``evidence``; null without letters."""
        # A broadcast is read once by each worker.
        shared = docs.sparkSession.sparkContext.broadcast(self.table)
        rest = [f for f in docs.schema.fields if f.name not in (text, "evidence")]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in T.slices(batches, text):
                bucket, first = _trigrams(*T.laid_out(batch.column(0)))
                n = np.diff(first)
                weight = np.minimum(WEIGHT, MOST_WEIGHT / np.maximum(n, 1))
                out = np.empty((len(n), len(table)))
                for k in range(len(table)):
                    sums = np.concatenate([[0.0], np.cumsum(table[k][bucket], dtype=np.float64)])
                    out[:, k] = (sums[first[1:]] - sums[first[:-1]]) * weight
                ends = np.arange(0, out.size + 1, len(table), dtype=np.int32)
                evidence = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], evidence], [*(f.name for f in rest), "evidence"])

        schema = StructType([*rest, StructField("evidence", ArrayType(DoubleType()))])
        return docs.select(text, *(f"`{f.name}`" for f in rest)).mapInArrow(T.tidy(score), schema)

    def identify(self, scored: DataFrame, voters: DataFrame, keys: list[str]) -> DataFrame:
        """Language of rows with ``evidence, declared, address, host``; null evidence says nothing.

        ``voters`` are the same rows without evidence, from which the host priors are counted.

        Returns ``keys, language, posterior, text_language, accepted``. A row without letters has no
        language; it and rows whose best class has no language, or less than half of the posterior, are
        not accepted. Ties go to the language first in the alphabet. Repeated rows are judged alike, but
        each counts for its host. A row's own vote is taken out of the prior that it meets.
        """
        languages = self.languages
        known = F.array(*map(F.lit, languages)) if languages else F.array().cast("array<string>")
        code = lambda c: F.when(F.array_contains(known, code_of(F.col(c))), code_of(F.col(c)))
        coded = lambda rows: rows.withColumns({"declared": code("declared"), "address": code("address"), "site": site_of(F.col("host"))})
        votes = coded(voters).withColumn("vote", F.coalesce("declared", "address")).where("vote IS NOT NULL").select("host", "site", "vote")
        names = [F.lit(x) for x in languages]

        def counts(key: str, name: str) -> DataFrame:
            """An array of votes for each value of ``key``: as many rows as values, however many votes."""
            by = votes.where(F.col(key).isNotNull()).groupBy(key, "vote").agg(F.count("*").alias("n"))
            sums = [F.coalesce(F.sum(F.when(F.col("vote") == x, F.col("n"))), F.lit(0)).cast("double") for x in names]
            return by.groupBy(key).agg(F.array(*sums).alias(name))

        if not languages:
            return scored.select(
                *keys, F.lit(NO_LANGUAGE).alias("language"), F.lit(1.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"),
                F.lit(False).alias("accepted"),
            )
        overall = votes.agg(*(F.sum(F.when(F.col("vote") == x, 1).otherwise(0)).cast("double") for x in names)).first()
        base = np.array([x or 0.0 for x in overall])
        joined = (
            coded(scored).join(counts("host", "host_votes"), "host", "left")
            .join(counts("site", "site_votes"), "site", "left")
            .select(*keys, "evidence", "declared", "address", "host_votes", "site_votes")
        )

        def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rest = batch.columns[len(keys) :]
                size, classes = batch.num_rows, len(languages)
                matrix = lambda c, w: np.array([x if x is not None else [0.0] * w for x in c.to_pylist()], float).reshape(size, w)
                place = {x: k for k, x in enumerate(languages)}
                said = [np.array([place.get(x, -1) for x in c.to_pylist()], np.int64) for c in rest[1:3]]
                evidence, hosts, sites = matrix(rest[0], classes + 1), matrix(rest[3], classes), matrix(rest[4], classes)
                vote = np.where(said[0] >= 0, said[0], said[1])
                own = np.zeros((size, classes))
                own[np.flatnonzero(vote >= 0), vote[vote >= 0]] = 1
                everywhere = np.maximum(base - own, 0) + 1
                prior = everywhere / everywhere.sum(1, keepdims=True)
                for votes_at, pull in ((sites, SITE_PULL), (hosts, HOST_PULL)):
                    others = np.maximum(votes_at - own, 0)
                    prior = (others + pull * prior) / (others.sum(1, keepdims=True) + pull)
                total = evidence.copy()
                total[:, :-1] += np.log(prior * (1 - NO_LANGUAGE_PRIOR))
                total[:, -1] += np.log(NO_LANGUAGE_PRIOR)
                for where, right in zip(said, (DECLARED_RIGHT, ADDRESS_RIGHT)):
                    named = np.flatnonzero(where >= 0)
                    miss = np.log((1 - right) / max(1, classes))
                    total[named] += miss
                    total[named, where[named]] += np.log(right) - miss
                best = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                posterior = odds[np.arange(size), best] / odds.sum(1)
                lettered = ~rest[0].is_null().to_numpy(zero_copy_only=False)
                names = np.array([*languages, NO_LANGUAGE], object)
                accepted = lettered & (best < classes) & (posterior >= LEAST_POSTERIOR)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(keys)], pa.array(np.where(lettered, names[best], NO_LANGUAGE), pa.string()), pa.array(posterior),
                        pa.array(names[evidence.argmax(1)], pa.string(), mask=~lettered), pa.array(accepted),
                    ],
                    [*keys, "language", "posterior", "text_language", "accepted"],
                )

        kept = [f for f in joined.schema.fields if f.name in keys]
        schema = StructType([
            *sorted(kept, key=lambda f: keys.index(f.name)), StructField("language", StringType()), StructField("posterior", DoubleType()),
            StructField("text_language", StringType()), StructField("accepted", BooleanType()),
        ])
        return joined.mapInArrow(T.tidy(fuse), schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id, page_lang, page_address, page_host`` from all pages whose address ends in the number of a document.

    Each is the most frequent one that any of the document's pages has, the first by alphabet among equals.
    """
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    facts = {"page_lang": markup_code(F.col("html")), "page_address": address_code(F.col("url")), "page_host": host_of(F.col("url"))}
    said = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in facts.items()))).alias("x")
    counted = (
        pages.select(F.nullif(number, F.lit("")).cast("long").alias("doc_id"), said)
        .where("doc_id IS NOT NULL AND x.value IS NOT NULL")
        .groupBy("doc_id", "x.kind", "x.value").agg(F.count("*").alias("n"))
    )
    most = {kind: F.min(F.when(F.col("kind") == kind, F.struct(-F.col("n"), "value"))) for kind in facts}
    return counted.groupBy("doc_id").agg(*(m["value"].alias(kind) for kind, m in most.items()))


def document_languages(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Language of every row of ``docs`` (``doc_id, text, lang, source``): ``doc_id, row_key, language, ...``.

    The pages that a document was taken from, if there are any, add their markup, address and host; else the
    document's own ``lang`` is the declaration and ``source`` the host. ``row_key`` is a hash of
    these four columns. Nulls in any column say nothing; other columns are not read. Empty tables give empty results.
    """
    model = LanguageModel.fit(docs)
    own = [F.col("lang").alias("own_lang"), F.col("source").alias("own_host")]

    def described(rows: DataFrame) -> DataFrame:
        if pages is None:
            return rows.withColumns({"declared": F.col("own_lang"), "address": F.lit(None).cast("string"), "host": F.col("own_host")})
        return rows.join(page_evidence(pages), "doc_id", "left").withColumns(
            {
                "declared": F.coalesce("page_lang", "own_lang"), "address": F.col("page_address"),
                "host": F.coalesce("page_host", "own_host"),
            }
        )

    # Texts are scored where they lie; only their likelihoods meet the pages.
    scored = model.likelihoods(docs.select("doc_id", F.xxhash64("doc_id", "text", "lang", "source").alias("row_key"), "text", *own))
    facts = ["declared", "address", "host"]
    return model.identify(
        described(scored).select("doc_id", "row_key", "evidence", *facts), described(docs.select("doc_id", *own)).select(*facts), ["doc_id", "row_key"]
    )
