"""Token-id matrices packed by best fit, with segment lengths and position resets.

Every task encodes and packs its own documents, shard by shard. Pieces are
taken by falling length; each goes to the fullest sequence that still has room
for it, found by a successor search in a tree over free capacities. A document
longer than a sequence is split into whole sequences and a rest, so that no id
is lost.

A row of the result is a block of up to ``BLOCK`` sequences: a matrix of ids
and what a training loop needs with it. The blocks are binary columns, so
writing them as Parquet is the file format; ``matrix`` reads one back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import packing, text as T, tokens

#: Sequences in one block.
BLOCK = 64
#: Id that fills a sequence up.
PAD_ID = 0

BLOCKS = (
    "shard long, first_sequence long, n_sequences long, length long, ids binary, cu_seqlens array<int>, positions binary, "
    "pieces array<struct<doc_id: long, start: long, doc_tokens: long>>"
)


class _Capacities:
    """Free capacities of the open sequences; each node counts those below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node //= 2

    def successor(self, least: int) -> int | None:
        """The smallest free capacity that is at least ``least``."""
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece of at most ``capacity`` tokens."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(-length, kind="stable")
    whole = order[length[order] == capacity]
    sequence[whole] = np.arange(len(whole))
    free, opened = _Capacities(capacity), len(whole)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for p in order[len(whole) :].tolist():
        n = int(length[p])
        room = free.successor(n)
        if room is None:
            room, s = capacity, opened
            opened += 1
        else:
            s = waiting[room].pop()
            free.add(room, -1)
        sequence[p], offset[p] = s, capacity - room
        if room > n:
            waiting[room - n].append(s)
            free.add(room - n, 1)
    return sequence, offset


def matrices(docs: DataFrame, length: int = packing.LENGTH, tokenizer: str | None = None,
             shard_tokens: int = packing.SHARD_TOKENS) -> DataFrame:
    """Blocks of packed sequences.

    ``ids`` is a matrix of ``n_sequences`` rows of ``length`` little-endian unsigned 32-bit ids, filled up
    with ``PAD_ID``. ``cu_seqlens`` holds where each segment of the flattened matrix begins and, last,
    where the matrix ends; filling is a segment of its own. ``positions`` is a matrix of unsigned
    16-bit numbers that start from 0 with each segment. ``pieces`` names the document of each segment,
    the place in it and its tokens, which are 0 for filling.

    Null and empty texts have the closing id only. Repeated rows are packed each for itself, null ids
    are kept, other columns are not read. An empty table gives no block.
    """
    path = tokenizer or tokens.default_path()
    if length > 1 << 16:
        raise ValueError("positions have 16 bits; a sequence may hold 65,536 tokens at most")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, shard in packing.numbered(batches, path, shard_tokens):
            doc, start, size = shard.cut(length)
            sequence, offset = best_fit_decreasing(size, length)
            order = np.lexsort((offset, sequence))
            doc, start, size, sequence, offset = (a[order] for a in (doc, start, size, sequence, offset))
            ends = np.searchsorted(sequence, np.arange(0, sequence[-1] + 1 + BLOCK, BLOCK))
            for k in range(len(ends) - 1):
                yield block(first, k * BLOCK, shard, *(a[ends[k] : ends[k + 1]] for a in (doc, start, size, sequence, offset)))

    def block(first, row, shard, doc, start, size, sequence, offset) -> pa.RecordBatch:
        rows = int(sequence[-1]) - row + 1
        at = (sequence - row) * length + offset
        ids = np.full(rows * length, PAD_ID, "<u4")
        ids[packing.gathered(np.arange(len(ids)), at, size)] = packing.gathered(shard.ids, shard.place[doc] + start, size)
        # A segment begins with each piece, where a row's filling begins, and nowhere else.
        last = np.append(np.diff(sequence) > 0, True)
        filling = (at + size)[last & (offset + size < length)]
        cuts = np.append(np.sort(np.concatenate([at, filling])), len(ids))
        positions = (np.arange(len(ids)) - np.repeat(cuts[:-1], np.diff(cuts))).astype("<u2")
        owner = np.full(len(cuts) - 1, -1)
        owner[np.searchsorted(cuts, at)] = np.arange(len(at))
        real = owner >= 0
        pieces = pa.StructArray.from_arrays(
            [
                shard.doc_id.take(pa.array(doc[owner], mask=~real)), pa.array(np.where(real, start[owner], 0)),
                pa.array(np.where(real, np.diff(shard.place)[doc[owner]], 0)),
            ],
            ["doc_id", "start", "doc_tokens"],
        )
        one = lambda x: pa.array([x], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                one(first), one(first + row), one(rows), one(length), pa.array([ids.tobytes()], pa.binary()),
                pa.array([cuts.astype(np.int32)], pa.list_(pa.int32())), pa.array([positions.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces),
            ],
            ["shard", "first_sequence", "n_sequences", "length", "ids", "cu_seqlens", "positions", "pieces"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.tidy(pack), BLOCKS)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Write the blocks as Parquet files at ``path``, one set of blocks for each partition of ``docs``."""
    matrices(docs, **options).write.parquet(path)


def matrix(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and positions of a block as matrices, and its segment bounds."""
    shape = (row["n_sequences"], row["length"])
    return np.frombuffer(row["ids"], "<u4").reshape(shape), np.frombuffer(row["positions"], "<u2").reshape(shape), np.array(row["cu_seqlens"])


def pieces(blocks: DataFrame) -> DataFrame:
    """One row for each segment of the blocks that is not filling, read from their matrices and bounds.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts, width = np.array(row["cu_seqlens"], np.int64), row["length"]
                ids, origin = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["positions"], "<u2")
                begin, size = cuts[:-1], np.diff(cuts)
                if not np.array_equal(np.flatnonzero(origin == 0), begin):
                    raise ValueError("positions and segments disagree")
                named = pa.array(row["pieces"], batch.schema.field("pieces").type.value_type)
                own = np.flatnonzero(named.field("doc_tokens").to_numpy() > 0)
                begin, size, named = begin[own], size[own], named.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        named.field("doc_id"), named.field("start"), pa.array(size), pa.array(packing.crc32_of(ids, begin, size)),
                        named.field("doc_tokens"), pa.array(row["first_sequence"] + begin // width), pa.array(begin % width),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return blocks.mapInArrow(T.tidy(read), schema)
