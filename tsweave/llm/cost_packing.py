"""Packing balanced by cost: pieces go to the cheapest sequence that has room.

A piece of ``n`` tokens costs ``n * (1 + n / quadratic_at)``: linear work, and
attention that equals it at ``quadratic_at`` tokens. Pieces are taken by
falling length; each goes to the sequence of least cost among those with room
for all of it. There are just as many sequences as the tokens of a shard need,
so when none has room for a piece, the piece is cut: the emptiest sequence
takes what it can and the rest is placed in its turn. Padding is thus less
than one sequence a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import packing, text as T, tokens

QUADRATIC_AT = 4096
#: Token ids that leave a worker at once.
BATCH_TOKENS = 1 << 18


class _Room:
    """Sequences by free tokens; finds the cheapest with at least some number free.

    A tree over 0..capacity keeps at each leaf the cheapest of the sequences
    with just so much room, and at each node the cheaper of its children.
    """

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.leaves)
        self.heaps[capacity] = [(0.0, s) for s in range(sequences)]
        self._lift(capacity)

    def _lift(self, room: int) -> None:
        node = room + self.leaves
        self.best[node] = self.heaps[room][0] if self.heaps[room] else None
        while node > 1:
            node //= 2
            a, b = self.best[2 * node], self.best[2 * node + 1]
            self.best[node] = a if b is None or (a is not None and a < b) else b

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._lift(room)

    def take(self, room: int) -> tuple[float, int]:
        out = heapq.heappop(self.heaps[room])
        self._lift(room)
        return out

    def cheapest(self, least: int) -> int | None:
        """Room of the cheapest sequence with ``least`` tokens free."""
        low, high, found, at = least + self.leaves, 2 * self.leaves, None, 0
        while low < high:
            if low & 1:
                if self.best[low] is not None and (found is None or self.best[low] < found):
                    found, at = self.best[low], low
                low += 1
            if high & 1:
                high -= 1
                if self.best[high] is not None and (found is None or self.best[high] < found):
                    found, at = self.best[high], high
            low, high = low // 2, high // 2
        if found is None:
            return None
        while at < self.leaves:
            at = 2 * at if self.best[2 * at] == found else 2 * at + 1
        return at - self.leaves

    def emptiest(self) -> int:
        node = 1
        while node < self.leaves:
            node = 2 * node + 1 if self.best[2 * node + 1] is not None else 2 * node
        return node - self.leaves


def cost_of(n: int, quadratic_at: int) -> float:
    return n * (1 + n / quadratic_at)


def balance(length: np.ndarray, capacity: int, quadratic_at: int = QUADRATIC_AT) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start in it, tokens, sequence, offset)`` for pieces of at most ``capacity`` tokens each."""
    whole = np.flatnonzero(length == capacity).tolist()
    out = [(p, 0, capacity, s, 0) for s, p in enumerate(whole)]
    part = [(-int(length[p]), p, 0) for p in np.flatnonzero((length > 0) & (length < capacity)).tolist()]
    need = -(-sum(-n for n, _, _ in part) // capacity)
    if not need:
        return out
    heapq.heapify(part)
    room = _Room(need, capacity)
    while part:
        n, p, start = heapq.heappop(part)
        n = -n
        at = room.cheapest(n)
        now = n
        if at is None:
            at = room.emptiest()
            now = at
            heapq.heappush(part, (now - n, p, start + now))
        cost, s = room.take(at)
        out.append((p, start, now, len(whole) + s, capacity - at))
        if at > now:
            room.put(at - now, cost + cost_of(now, quadratic_at), s)
    return out


def rows_of(count: np.ndarray) -> Iterator[slice]:
    """Runs of pieces of about ``BATCH_TOKENS`` ids each."""
    ends, begin = np.cumsum(count), 0
    while begin < len(count):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, "right")))
        yield slice(begin, end)
        begin = end


def packed(batches: Iterator[pa.RecordBatch], path: str, length: int, quadratic_at: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's documents, about ``BATCH_TOKENS`` ids at a time."""
    for first, shard in packing.numbered(batches, path, shard_tokens):
        doc, start, size = shard.cut(length)
        placed = np.array(balance(size, length, quadratic_at), np.int64).reshape(-1, 5)
        placed = placed[np.lexsort((placed[:, 4], placed[:, 3]))]
        piece, within, count, sequence, offset = placed.T
        begin = shard.place[doc[piece]] + start[piece] + within
        tokens_of = np.diff(shard.place)
        for some in rows_of(count):
            # Only the ids of one batch are gathered at a time.
            own = packing.gathered(shard.ids, begin[some], count[some]).astype("<u4")
            at = np.concatenate([[0], np.cumsum(count[some])])
            bounds = (at * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    shard.doc_id.take(pa.array(doc[piece[some]])),
                    pa.array(start[piece[some]] + within[some]),
                    pa.array(count[some]),
                    pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(own))]),
                    pa.array(packing.crc32_of(own, at[:-1], count[some])),
                    pa.array(tokens_of[doc[piece[some]]]),
                    pa.array(sequence[some] + first),
                    pa.array(offset[some]),
                ],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )


def pack_balanced(docs: DataFrame, length: int = packing.LENGTH, quadratic_at: int = QUADRATIC_AT,
                  tokenizer: str | None = None, shard_tokens: int = packing.SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents, each with its sequence.

    Returns ``doc_id, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset``. Null and empty texts have the closing id only. Repeated rows are packed each for
    itself, null ids are kept, other columns are not read. Which documents share a sequence depends on
    how the input is partitioned; the ids do not.
    """
    path = tokenizer or tokens.default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(batches, path, length, quadratic_at, shard_tokens)

    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.tidy(pack), schema)
