"""Exact duplicates by an extendible-hash index in the shared folder.

Texts are equal when they agree byte for byte after lower-casing A-Z. Three
steps, all DataFrame and SQL functions:

*Entries.* One pass over the texts writes an entry for each row to the shared
folder: its hash key, the SHA-256 of its normalised text and a row number. No
text travels.

*Directory.* A bucket is the range of keys that share their first bits. It is
split in two, one bit deeper, while it holds more keys than its capacity; when
the deepest bucket is split the directory doubles. The directory has one slot
for each value of the ``depth`` first bits and names the bucket of each.

*Owners.* Only texts whose key is met more than once are read again and sent
to the owner of their bucket's key range. The key alone does not decide: texts
are grouped by their bytes, so keys that collide give a chain of different
texts. Equal texts are combined before they are sent, one a task. The finished
chains, without texts, are the index on shared files, in the order of the keys.

Rows then look up their chain by key and digest. Rows of one key are dealt by a
salt, so a text that a third of all rows hold is no heavy key.

What is broadcast: the directory, at most ``2 ** MOST_DEPTH`` slots, and a
bitmap of the keys met more than once, at most ``2 ** MOST_BITS`` bits. Both
bounds are fixed. A bitmap that is full lets more texts through, never fewer.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsweave.session import materialise

#: Keys of a bucket before it is split.
CAPACITY = 4096
#: The directory never has more than 2 ** MOST_DEPTH slots; buckets of greater corpora hold more keys.
MOST_DEPTH = 16
#: Bits of the bitmap for each repeated key, and the most bits in all (64 MB).
BITS_A_KEY, MOST_BITS = 16, 29
#: Salts that the rows of one key are dealt to.
SALTS = 64
KEY_BITS = 64
#: Bits of one row of ``bitmap_construct_agg``.
BITMAP = 1 << 15


def normalised(text: str | Column) -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # ``lower`` is the faster one and the same on plain ASCII; elsewhere it would change other letters too.
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def key_of(normal: Column, bits: int = KEY_BITS) -> Column:
    """The first ``bits`` bits of the hash, the others zero."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(normal), 64 - bits), 64 - bits) if bits < 64 else F.xxhash64(normal)


def _prefix(key: str, depth: str | int) -> Column:
    """The first ``depth`` bits of the key as a number."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned({key}, 64 - {depth}) END")


def directory(keys: DataFrame, n_keys: int, capacity: int = CAPACITY) -> DataFrame:
    """Slots of the directory: ``slot``, and the ``bucket`` and ``bucket_depth`` that it points to.

    ``keys`` has each ``key`` once. Bucket counts of every depth come from one
    pass; a bucket is a leaf when it fits and its parent does not.
    """
    capacity = max(capacity, -(-n_keys // (1 << (MOST_DEPTH - 2))))
    deepest = 0 if n_keys <= capacity else min(MOST_DEPTH, 2 + math.ceil(math.log2(n_keys / capacity)))
    fine = keys.groupBy(_prefix("key", deepest).alias("slot")).agg(F.count("*").alias("n"))
    levels = (
        fine.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
        .groupBy("depth", F.expr(f"shiftrightunsigned(slot, {deepest} - depth)").alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .withColumn("over", F.expr(f"n > {capacity} AND depth < {deepest}"))
    )
    # Leaves: they are not split, and everything above them is.
    split = levels.where("over").select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    inner = levels.where("NOT over").withColumn("parent", F.expr("shiftrightunsigned(bucket, 1)"))
    leaves = inner.join(split, ["depth", "parent"], "left_semi").unionByName(inner.where("depth = 0"))
    reached = F.sequence(F.expr(f"shiftleft(bucket, {deepest} - depth)"), F.expr(f"shiftleft(bucket + 1, {deepest} - depth) - 1"))
    return leaves.select(F.explode(reached).alias("slot"), "bucket", F.col("depth").alias("bucket_depth"), F.lit(deepest).alias("depth"))


def bitmap(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Rows of a bitmap in which the key's bit is set, and the number of its bits."""
    size = 1 << min(MOST_BITS, max(15, math.ceil(math.log2(max(1, n_keys) * BITS_A_KEY))))
    bit = F.col("key").bitwiseAND(size - 1)
    rows = keys.groupBy(F.floor(bit / BITMAP).alias("bit_row")).agg(F.bitmap_construct_agg(bit % BITMAP).alias("bit_set"))
    return rows, size


def marked(key: str, size: int) -> tuple[Column, Column]:
    """Row of the bitmap that has the key's bit, and whether ``bit_set`` has it."""
    bit = F.col(key).bitwiseAND(size - 1)
    byte = F.conv(F.hex(F.substring("bit_set", F.floor(bit % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(bit / BITMAP), F.getbit(byte, (bit % 8).cast("int")) == 1


@dataclass(frozen=True)
class ExtendibleIndex:
    """Entries of all rows and chains of all texts that stand there more than once, both in the shared folder.

    ``entries``: ``key, row, salt, doc_id, text_sha256`` by row.
    ``chains``: ``bucket, bucket_depth, key, chain, keep, group_size, text_sha256`` by text, in the order of the keys.
    """

    entries: DataFrame
    chains: DataFrame

    @staticmethod
    def build(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> ExtendibleIndex:
        normal = normalised("text")
        entries = materialise(
            docs.select("doc_id", normal.alias("normal"))
            .select(key_of(F.col("normal"), key_bits).alias("key"), F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("normal", 256).alias("text_sha256"))
            .withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))),
            "dedup-entries",
        )
        keys = materialise(entries.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
        n_keys, n_twice = keys.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
        slots = directory(keys, n_keys, capacity)
        bits, size = bitmap(keys.where("n > 1"), n_twice)
        bit_row, hit = marked("key", size)
        depth = slots.agg(F.max("depth")).first()[0] or 0
        owned = (
            docs.select(normal.alias("normal"))
            .withColumn("key", key_of(F.col("normal"), key_bits))
            .withColumn("bit_row", bit_row)
            .join(F.broadcast(bits), "bit_row")
            .where(hit)
            .withColumn("slot", _prefix("key", depth))
            .join(F.broadcast(slots.drop("depth")), "slot")
        )
        texts = owned.groupBy("bucket_depth", "bucket", "key", "normal").agg(F.count("*").alias("group_size")).where("group_size > 1")
        place = F.row_number().over(Window.partitionBy("key").orderBy("text_sha256"))
        chains = texts.withColumn("text_sha256", F.sha2("normal", 256)).drop("normal").withColumn("chain", place)
        newest = F.max(F.struct("doc_id", "row")).alias("keep")
        # Rows of one key are combined by salt before they meet.
        parts = entries.groupBy("key", "text_sha256", "salt").agg(newest)
        kept = parts.groupBy("key", "text_sha256").agg(F.max("keep").alias("keep"))
        full = chains.join(kept, ["key", "text_sha256"]).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain")
        return ExtendibleIndex(entries, materialise(full, "dedup-chains"))

    def members(self) -> DataFrame:
        """One row for each row of the documents: ``doc_id, keep_id, group_size, kept, text_sha256``."""
        link = ["key", "text_sha256"]
        present = self.entries.groupBy(*link, "salt").agg(F.count("*").alias("n")).drop("n")
        dealt = present.join(self.chains.select(*link, "keep", "group_size"), link)
        out = self.entries.join(dealt, [*link, "salt"], "left")
        return out.select(
            "doc_id",
            F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
            "text_sha256",
        )


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays; of repeated rows
    with that id exactly one. Null texts equal empty ones. A null ``doc_id`` is
    below all others. Other columns are not read. An empty table gives no rows.
    """
    return ExtendibleIndex.build(docs, capacity, key_bits).members()
