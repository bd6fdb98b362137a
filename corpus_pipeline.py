"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of ``docs``. A stage sets
the session's limit on the bytes of an Arrow batch where it has Spark's default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsweave.llm import apart, cost_packing, importance, jaccard, language, tiling
from tsweave.session import bound_batches, materialise

KEY = "pipeline_row_key"
#: Near copies of the pipeline; op8's own rule is that of its query.
NEAR = jaccard.Rule(words=5, percent=80)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are as likely under trusted text as trusted documents are.

    Rows with null or empty text go; repeated rows are judged alike.
    """
    model = importance.ImportanceFilter.fit(docs, _table(spark, sf_dir, "labels"))
    judged = model.apply(docs, prefix="quality_rules_")
    return judged.where("quality_rules_kept").select(*(f"`{c}`" for c in docs.columns))


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, with ``lang`` set to it where it was declared otherwise."""
    found = language.document_languages(docs, _table(spark, sf_dir, "pages"))
    key = F.xxhash64("doc_id", "text", "lang", "source")
    declared = docs.select(key.alias("row_key"), F.col("lang").alias("pipeline_declared")).distinct()
    # Only rejected and renamed documents travel to the texts.
    changed = materialise(
        found.select("row_key", "language", "accepted").distinct().join(declared, "row_key")
        .where("NOT accepted OR NOT language <=> pipeline_declared")
        .groupBy("row_key")
        .agg(F.min("language").alias("pipeline_language"), F.min("accepted").alias("pipeline_accepted")),
        "language-changes",
    )
    rest, likely = apart.parted(docs.withColumn(KEY, key), changed.withColumnRenamed("row_key", KEY).select(KEY), KEY)
    met = likely.join(changed.withColumnRenamed("row_key", KEY).hint("merge"), KEY, "left")
    kept = met.where(F.coalesce("pipeline_accepted", F.lit(True))).withColumn("lang", F.coalesce("pipeline_language", "lang"))
    columns = [f"`{c}`" for c in docs.columns]
    return rest.select(*columns).unionByName(kept.select(*columns))


@in_small_batches
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id."""
    linked = materialise(jaccard.jaccard_components(docs, NEAR), "linked")
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    gone = materialise(jaccard.losers(linked).withColumnRenamed("row_key", KEY), "losers")
    kept = apart.without(keyed, gone, KEY)
    # Rows with the same id and text are one document; there are seldom any.
    twice = linked.where("root IS NOT NULL").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1")
    twice = materialise(twice.select(F.col("row_key").alias(KEY)), "repeated")
    columns = [f"`{c}`" for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*columns)
    rest, likely = apart.parted(kept, twice, KEY)
    met = likely.join(twice.withColumn("pipeline_twice", F.lit(True)).hint("merge"), KEY, "left")
    # The one whose columns come first as text stays; equal rows are combined before they travel.
    row = F.struct(*columns)
    one = met.where("pipeline_twice").groupBy(KEY).agg(F.min_by(row, F.to_json(row)).alias("pipeline_row")).select("pipeline_row.*")
    return rest.select(*columns).unionByName(met.where("pipeline_twice IS NULL").select(*columns)).unionByName(one)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item."""
    leaks = tiling.overlaps(docs, _table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias(KEY)).distinct()
    kept = apart.without(docs.withColumn(KEY, F.xxhash64("doc_id", "text")), materialise(leaks, "leaks"), KEY)
    return kept.select(*(f"`{c}`" for c in docs.columns))


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of cost-balanced sequences, ids included."""
    return cost_packing.pack_balanced(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: Fitted models, shingle components and token ids are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
