"""Packing of token ids into sequences of one length: what both packers share.

Documents are read and encoded where they lie; nothing is shuffled. Each task
packs what it has read in shards of a bounded number of tokens, so memory does
not grow with the partition. A document longer than a sequence is cut into
whole sequences and a rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from tsweave.llm import text as T, tokens

LENGTH = 2048
#: Tokens that a task holds before it packs them.
SHARD_TOKENS = 4 << 20


@dataclass
class Shard:
    """Ids of some documents and the pieces that they are cut into."""

    doc_id: pa.Array
    ids: np.ndarray
    place: np.ndarray

    def cut(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and length of every piece: whole sequences, then a document's rest."""
        size = np.diff(self.place)
        pieces = -(-size // length)
        doc = np.repeat(np.arange(len(size)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        return doc, start, np.minimum(length, size[doc] - start)


def shards(batches: Iterator[pa.RecordBatch], path: str, most: int = SHARD_TOKENS) -> Iterator[Shard]:
    """The documents of a task in shards of about ``most`` tokens; ``doc_id`` stands first, the text second."""
    kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    held = 0

    def joined() -> Shard:
        begin = np.cumsum([0, *(len(ids) for _, ids, _ in kept)])
        place = np.concatenate([p[:-1] + b for (_, _, p), b in zip(kept, begin)] + [begin[-1:]])
        out = Shard(pa.concat_arrays([d for d, _, _ in kept]), np.concatenate([ids for _, ids, _ in kept]), place)
        kept.clear()
        T.give_back()
        return out

    for part in tokens.documents_of(batches, path):
        kept.append(part)
        held += len(part[1])
        if held >= most:
            yield joined()
            held = 0
    if kept:
        yield joined()


def numbered(batches: Iterator[pa.RecordBatch], path: str, most: int = SHARD_TOKENS) -> Iterator[tuple[int, Shard]]:
    """Shards with the number of their first sequence: the partition above bit 40, sequences counted from there."""
    first = TaskContext.get().partitionId() << 40
    for k, shard in enumerate(shards(batches, path, most)):
        yield first + (k << 28), shard


def gathered(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` from ``begin`` on, end to end."""
    before = np.cumsum(length) - length
    return ids[np.repeat(begin - before, length) + np.arange(length.sum())]


def crc32_of(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's ids as little-endian unsigned 32-bit numbers."""
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.array([zlib.crc32(data[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())], np.int64)

