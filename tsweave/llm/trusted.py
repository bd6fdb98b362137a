"""Trusted documents: all those labelled good and not toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsweave.llm.exact_dedup import bitmap, marked
from tsweave.session import materialise


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` of all good, non-toxic labelled documents.

    Labels with nulls name no trusted document; a document with both good and
    bad labels is not trusted.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
        .where("good")
        .select("doc_id")
    )


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is trusted, written to the shared folder once.

    A bitmap of the trusted ids, of bounded size, is broadcast. Texts it does
    not mark stay where they are; the marked ones, nearly all of them trusted,
    meet the exact ids. The plan is the same at every size.
    """
    ids = materialise(trusted_ids(labels).withColumn("key", F.xxhash64("doc_id")), "trusted-ids")
    bits, size = bitmap(ids, ids.count())
    bit_row, hit = marked("trusted_key", size)
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    likely = (
        named.withColumn("trusted_key", F.xxhash64("doc_id"))
        .withColumn("bit_row", bit_row)
        .join(F.broadcast(bits), "bit_row")
        .where(hit)
        .drop("bit_row", "bit_set", "trusted_key")
    )
    # The ids are distinct. A semi join would be pushed down below the bitmap, and all texts would travel.
    return materialise(likely.join(ids.select("doc_id").hint("merge"), "doc_id"), "trusted-documents")
