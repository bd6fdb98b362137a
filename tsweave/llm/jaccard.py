"""Exact Jaccard self-join of word-shingle sets in the Jaccard metric space.

Texts of one corpus mostly share no shingle: all distances between them are 1,
and no pivot text tells them apart. So the join goes in two steps.

*Coarse regions.* Shingles have one global order, the rare ones first: by the
counts of a table of fixed size, then by hash. Two linked sets share one of
their first ``size - ceil(t * size) + 1`` shingles, so only these are dealt out
and met; shingles that only one text can have are not even sent. Sets that
meet on a shingle and are alike enough in size may be linked. Where few meet,
each pair is looked at once more: the counts of the shingles by hash cells, more
cells for larger sets, bound the distance from below. What is left makes the regions, and no link
crosses them. Where many meet on a shingle they are one region without a
further look; each task sends one of them, so a text copied a million times or
a passage in every text is no heavy key. Any order of the shingles gives the
same result; counts that the table blurs only make regions larger. So regions
of many sets are cut once more in the same way, by the counts of their own
shingles, which the table holds apart better than those of the whole corpus.

*Voronoi regions.* Within a region, pivots are drawn among its sets and every
set is measured against them. A set belongs to the cell of its nearest pivot
and is lent to each other cell whose pivot is at most ``2 * eps`` further off
than its own: by the triangle inequality, no linked pair is parted. A set
within ``eps`` of a pivot is linked to it. Such a set is closed, and need not
be compared with other closed sets, if all pivots within ``2 * eps`` of it are
linked among themselves. A closed set of a cell to which open sets are lent is
compared all the same, as those may be closed where they are at home. Cells are joined in the same way again. Regions that
fit a task are joined there; larger ones are split over the cluster, if their
pivots tell the sets apart. Where most sets would be lent to many cells, the
region goes on as pairs of chunks.

The result is the connected components of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import text as T
from tsweave.llm.components import components
from tsweave.llm.exact_dedup import bitmap, marked
from tsweave.session import bound_batches, materialise

#: Buckets of the table of shingle counts (two bytes each), and how it is cut to be summed.
TABLE_BITS, TABLE_PIECE = 22, 1 << 16
#: Ratio of the bounds of a size class.
CLASS_RATIO = 1.07
#: Up to so many sets that meet on a shingle are looked at pair by pair, in the whole corpus and in a region of many sets.
FEW, FEW_AGAIN = 8, 32
#: Hash cells whose counts bound the distance of two sets, at least and at most: one for eight shingles, or chance differences hide those of sets.
CELLS, MOST_CELLS, SET_A_CELL = 64, 1024, 8
#: Salts that rows of one text or component are dealt to.
SALTS = 64
#: Entries that one task sorts.
SHARD_ENTRIES = 500_000
#: Entries that a task holds before it packs them, and the buckets that it packs them in.
HELD_ENTRIES, BUCKETS = 500_000, 1024
#: Sets, and shingles in them, of a region that one task joins.
REGION_SETS, REGION_SHINGLES = 4_000, 4_000_000
PIVOTS, SMALL_CELL, DEPTH = 16, 48, 3
#: Regions of more sets are cut again by their own counts, in so many rounds at most.
AGAIN_SETS, AGAIN_ROUNDS = 500, 3
#: Sets, and shingles in them, that a task measures against pivots; cells that a set may be in on average.
CHUNK_SETS, CHUNK_SHINGLES, LENT = 1_000, 500_000, 2
#: Shingles looked up at once.
LOOKED_UP = 500_000


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when ``100 * common >= percent * united``."""

    words: int = 3
    percent: int = 90

    @property
    def eps(self) -> float:
        return 1 - self.percent / 100 + 1e-9

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def shared_from(self, size: np.ndarray) -> np.ndarray:
        """How many of the first shingles of a set there must be so that linked sets share one of them."""
        return size + (-self.percent * size) // 100 + 1

    @property
    def class_gap(self) -> int:
        """How many size classes two linked sets can be apart."""
        return int(np.log(100 / self.percent) / np.log(CLASS_RATIO)) + 1


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text end to end, and where each text's begin.

    A text with fewer than ``words`` words has one shingle, all of it; one without words has none.
    """
    begin, end, first = T.words_of(raw, at)
    word = T.hashes(T.LOWER[raw], begin, end)
    count = np.diff(first)
    shingle, place = T.grams(word, first, words)
    owner = np.searchsorted(first, place, "right") - 1
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        alone = np.array([np.bitwise_xor.reduce(T.mix(word[first[i] : first[i + 1]] * (2 * np.arange(count[i], dtype=np.uint64) + T.ODD))) for i in short], np.uint64)
        shingle = np.concatenate([shingle, T.mix(alone + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(at)))
    for i in range(len(at) - 1):
        shingle[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(at) - 1))])


def _prints(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    sums = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(T.mix(shingle ^ T.ODD), out=sums[1:])
    size = np.diff(first).astype(np.uint64)
    return T.mix((sums[first[1:]] - sums[first[:-1]]) * T.ODD + size)


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (T.mix(shingle ^ np.uint64(0x5851F42D)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """In how many texts the shingles of each bucket stand, 65,535 at most. The table has a fixed size."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in T.slices(batches):
            yield shingle_sets(*T.laid_out(batch.column(0)), words)[0]

    return _counts(docs.select("text"), shingles)


def _counts(rows: DataFrame, shingles: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """The table of what ``shingles`` gives for the batches of ``rows``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        for shingle in shingles(batches):
            bucket, n = np.unique(_bucket(shingle), return_counts=True)
            table[bucket] += n.astype(np.uint32)
        pieces = np.minimum(table, 65_535).astype("<u2").reshape(-1, TABLE_PIECE)
        full = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([pieces[i].tobytes() for i in full], pa.binary())], ["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u2").astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([np.minimum(total, 65_535).astype("<u2").tobytes()], pa.binary())})

    schema = "piece long, counts binary"
    summed = rows.mapInArrow(T.tidy(count), schema).groupBy("piece").applyInArrow(add, schema).collect()
    out = np.zeros(1 << TABLE_BITS, np.uint16)
    for piece, counts in summed:
        own = np.frombuffer(counts, "<u2")
        out[piece * len(own) : (piece + 1) * len(own)] = own
    return out


def rarest(shingle: np.ndarray, first: np.ndarray, table: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set on which it can meet linked ones, and the set of each."""
    owner, size = T.owners(first), np.diff(first)
    count = table[_bucket(shingle)]
    order = np.lexsort((T.mix(shingle), count, owner))
    rank = np.arange(len(shingle)) - first[owner]
    # Sets of few shingles link with equal ones only, which have the same fingerprint.
    alone = 100 * size < rule.percent * (size + 1)
    equal_only = alone & (100 * (size - 1) < rule.percent * size)
    wanted = np.where(equal_only, 0, rule.shared_from(size))
    picked = order[rank < wanted[owner]]
    picked = picked[count[picked] > 1]
    return shingle[picked], owner[picked]


def size_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(size, 1)) / np.log(CLASS_RATIO) + 1e-9, 255).astype(np.uint8)


def sketches(shingle: np.ndarray, first: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Shingles of each set by hash cell, 255 at most: the sum of differences bounds that of the sets from below."""
    cell = (T.mix(shingle ^ np.uint64(0x2545F491)) % np.uint64(cells)).astype(np.int64)
    n = len(first) - 1
    return np.minimum(np.bincount(T.owners(first) * cells + cell, minlength=n * cells), 255).astype(np.uint8).reshape(n, cells)


def _sketched(shingle: np.ndarray, first: np.ndarray) -> pa.Array:
    """The sketch of each set, of as many cells as its size asks for: a power of two, so that halves can be laid on each other."""
    size = np.diff(first)
    wanted = np.maximum(size // SET_A_CELL, CELLS)
    cells = np.minimum(1 << np.ceil(np.log2(wanted)).astype(np.int64), MOST_CELLS)
    out = np.empty(len(size), object)
    for n in np.unique(cells).tolist():
        some = np.flatnonzero(cells == n)
        length = size[some]
        before = np.cumsum(length) - length
        own = shingle[np.repeat(first[some] - before, length) + np.arange(length.sum())]
        out[some] = [x.tobytes() for x in sketches(own, np.append(before, length.sum()), n)]
    return pa.array(out.tolist(), pa.binary())


def sketch_distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sum of differences of each pair of sketches, the larger one laid together to the cells of the smaller."""
    out = np.zeros(len(a), np.int64)
    left, right = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    for m, n in np.unique(np.stack([left, right], 1), axis=0).tolist():
        some = np.flatnonzero((left == m) & (right == n))
        cells = min(m, n)
        for part in np.array_split(some, -(-len(some) * max(m, n) // (1 << 20))):
            x, y = (
                np.frombuffer(b"".join(side[i] for i in part.tolist()), np.uint8).reshape(len(part), -1, cells).sum(1, dtype=np.int64) for side in (a, b)
            )
            out[part] = np.abs(x - y).sum(1)
    return out


class _Entries:
    """What meets on a shingle: the shingle, a fingerprint, least and greatest size class, and whether it stands for many sets."""

    KINDS = (np.uint64, np.uint64, np.uint8, np.uint8, np.uint8)

    def __init__(self, *columns: np.ndarray):
        order = np.lexsort((columns[1], columns[2], columns[0]))
        sig, own, *rest = (c[order] for c in columns)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]) | rest[2][1:].astype(bool) | rest[2][:-1].astype(bool)
        self.sig, self.own, self.low, self.high, self.many = (c[new] for c in (sig, own, *rest))

    def runs(self, gap: int) -> np.ndarray:
        """Number of the run of each entry: those of one shingle that are alike in size, or are by way of others."""
        if not len(self.sig):
            return np.zeros(0, np.int64)
        group = np.concatenate([[0], np.cumsum(self.sig[1:] != self.sig[:-1])])
        most = np.maximum.accumulate(group * 1024 + self.high)
        cut = np.ones(len(self.sig), bool)
        cut[1:] = group[1:] * 1024 + self.low[1:] > most[:-1] + gap
        return np.cumsum(cut) - 1

    def met(self, gap: int, few: int = FEW) -> tuple[_Entries, np.ndarray, np.ndarray]:
        """Entries in which runs of many sets are one, pairs within such runs, and pairs of few sets to be looked at."""
        run = self.runs(gap)
        size = np.bincount(run)
        large = (size > few) | (np.bincount(run, self.many) > 0)
        least = np.full(len(size), ~np.uint64(0))
        np.minimum.at(least, run, self.own)
        low, high = np.full(len(size), 255, np.uint8), np.zeros(len(size), np.uint8)
        np.minimum.at(low, run, self.low)
        np.maximum.at(high, run, self.high)
        head = np.searchsorted(run, np.arange(len(size)))
        inside = large[run]
        sure = _distinct(self.own[inside], least[run[inside]])
        weak = []
        for k in range(1, few):
            i = np.flatnonzero((run[k:] == run[: max(0, len(run) - k)]) & ~inside[: max(0, len(run) - k)])
            i = i[self.low[i + k].astype(np.int64) - self.high[i] <= gap]
            weak.append((self.own[i], self.own[i + k]))
        lone = ~inside
        whole = np.flatnonzero(large)
        merged = _Entries(
            *(np.concatenate(x) for x in (
                (self.sig[lone], self.sig[head[whole]]), (self.own[lone], least[whole]), (self.low[lone], low[whole]),
                (self.high[lone], high[whole]), (self.many[lone], np.ones(len(whole), np.uint8)),
            ))
        )
        return merged, sure, _distinct(*(np.concatenate(x) for x in zip(*weak)))

    def __getitem__(self, some) -> bytes:
        return b"".join(c[some].astype(k).tobytes() for c, k in zip((self.sig, self.own, self.low, self.high, self.many), self.KINDS))

    @staticmethod
    def of(packed: list[bytes]) -> _Entries:
        columns: list[list[np.ndarray]] = [[] for _ in _Entries.KINDS]
        for data in packed:
            n, at = len(data) // sum(np.dtype(k).itemsize for k in _Entries.KINDS), 0
            for column, kind in zip(columns, _Entries.KINDS):
                column.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
        return _Entries(*(np.concatenate(c) for c in columns))


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs of different fingerprints, the smaller one first, as rows."""
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
    _, one = np.unique(T.mix(pairs[:, 0] * T.ODD + pairs[:, 1]), return_index=True)
    return pairs[one]


def _dealt_out(prints: np.ndarray, shingle: np.ndarray, first: np.ndarray, table: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Columns of the entries of sets, equal sets counted once."""
    size = np.diff(first)
    _, head = np.unique(prints, return_index=True)
    head = head[size[head] > 0]
    length = size[head]
    where = np.repeat(first[head] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    sig, owner = rarest(shingle[where], np.concatenate([[0], np.cumsum(length)]), table, rule)
    kind = size_class(length)[owner]
    return T.mix(sig), prints[head][owner], kind, kind, np.zeros(len(sig), np.uint8)


def _packed(held: list[tuple[np.ndarray, ...]], rule: Rule, few: int) -> list[pa.Array]:
    """``kind, bucket, n, data`` of entries: those of each bucket (kind 1), and the pairs of runs of many sets (2)."""
    met, sure, _ = _Entries(*(np.concatenate(x) for x in zip(*held))).met(rule.class_gap, few)
    cut = np.searchsorted(met.sig, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS.bit_length() + 1))
    cut = np.append(cut, len(met.sig))
    full = np.flatnonzero(np.diff(cut))
    data = [met[cut[i] : cut[i + 1]] for i in full] + [sure.tobytes()]
    kinds, size = [1] * len(full) + [2], [*np.diff(cut)[full].tolist(), len(sure)]
    return [pa.array(kinds, pa.int32()), pa.array([*full.tolist(), 0], pa.int32()), pa.array(size, pa.int64()), pa.array(data, pa.binary())]


def _read(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass over the texts: a row for each document (kind 0), packed entries (1) and pairs of runs of many sets (2)."""
    schema = "doc_id long, row_key long, n_shingles long, print long, sketch binary, salt int, kind int, bucket int, n long, data binary"
    names = ["doc_id", "row_key", "n_shingles", "print", "sketch", "salt", "kind", "bucket", "n", "data"]
    # Read once by each worker.
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, rule.words))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in T.slices(batches):
            shingle, first = shingle_sets(*T.laid_out(batch.column(1)), rule.words)
            prints, size = _prints(shingle, first), np.diff(first)
            rows = batch.num_rows
            sketch = _sketched(shingle, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size), pa.array(prints.view(np.int64)), sketch, pa.array((np.arange(rows) % SALTS).astype(np.int32)), pa.array(np.zeros(rows, np.int32)),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())],
                names,
            )
            held.append(_dealt_out(prints, shingle, first, shared.value, rule))
            count += len(held[-1][0])
            if count >= HELD_ENTRIES:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        columns = _packed(held, rule, FEW)
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(T.tidy(read), schema)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            pairs = np.frombuffer(data, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _coarse(read: DataFrame, prints: DataFrame, rule: Rule, few: int = FEW) -> DataFrame:
    """Pairs of fingerprints that may be linked; every link is within a component of them."""
    entries, near = read.where("kind = 1"), read.where("kind = 2 AND n > 0")
    shards = max(1, -(-(entries.agg(F.sum("n")).first()[0] or 0) // (SHARD_ENTRIES * FEW // few)))
    finer = -(-shards // BUCKETS)

    def finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each bucket's entries cut once more, for inputs that need more shards than buckets."""
        for batch in batches:
            rows = []
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = _Entries.of([data])
                part = (T.mix(own.sig) % np.uint64(finer)).astype(np.int64)
                rows += [(bucket * finer + k, own[part == k]) for k in np.unique(part).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["shard", "data"])

    def meet(table: pa.Table) -> pa.Table:
        _, sure, weak = _Entries.of(table.column("data").to_pylist()).met(rule.class_gap, few)
        pairs = np.concatenate([sure, weak]).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "sure": pa.array(np.arange(len(pairs)) < len(sure))})

    if finer > 1:
        sharded = entries.select("bucket", "data").mapInArrow(T.tidy(finely), "shard long, data binary")
    else:
        sharded = entries.select((F.col("bucket") % shards).cast("long").alias("shard"), "data")
    met = materialise(sharded.groupBy("shard").applyInArrow(T.tidy_group(meet), "a long, b long, sure boolean"), "met")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = sketch_distance(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            size = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            # Shingles of just one of two linked sets: at most (1 - t) / (1 + t) of all of both.
            fits = (100 + rule.percent) * apart <= (100 - rule.percent) * size
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits)) for c in batch.columns[:2]], ["a", "b"])

    side = lambda k: prints.select(F.col("print").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n_shingles").alias(f"size_{k}"))
    weak = met.where("NOT sure").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    weak = weak.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b").mapInArrow(T.tidy(possible), "a long, b long")
    return near.select("data").mapInArrow(T.tidy(_pairs_of), "a long, b long").unionByName(met.where("sure").select("a", "b")).unionByName(weak)


def _dealt(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` (with ``salt``) with one row a key, the rows of a key being dealt by their salt."""
    spread = rows.select(key, "salt").distinct().join(table, key)
    return rows.join(spread, [key, "salt"], "left")


class _Sets:
    """Sets in memory and the forest of links found among them."""

    def __init__(self, rule: Rule, prints: np.ndarray, sets: list[np.ndarray]):
        self.rule, self.prints = rule, prints
        self.size = np.array([len(s) for s in sets], np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.parent = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self, some: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent[some]
            self.parent = up

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def common(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """How many shingles each of ``some`` shares with ``pivot``."""
        own = self.all[self.first[pivot] : self.first[pivot + 1]]
        out = np.zeros(len(some), np.int64)
        ends = np.cumsum(self.size[some])
        begin = 0
        while begin < len(some):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + LOOKED_UP, "right")))
            length = self.size[some[begin:end]]
            before = np.cumsum(length) - length
            there = self.all[np.repeat(self.first[some[begin:end]] - before, length) + np.arange(length.sum())]
            hit = own[np.minimum(np.searchsorted(own, there), len(own) - 1)] == there
            out[begin:end] = T.totals(hit, np.append(before, length.sum()))
            begin = end
        return out

    def measured(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """Distance of each of ``some`` to ``pivot``; links are noted."""
        common = self.common(pivot, some)
        for j in some[self.rule.linked(common, self.size[pivot], self.size[some])].tolist():
            if j != pivot:
                self.link(pivot, j)
        return 1 - common / (self.size[pivot] + self.size[some] - common)

    def sweep(self, home: np.ndarray, lent: np.ndarray) -> None:
        """Every pair of a home set with another set, but for pairs known to be joined or too unlike in size."""
        members = np.concatenate([home, lent])
        percent = self.rule.percent
        for k, i in enumerate(home.tolist()):
            rest = members[k + 1 :]
            small, large = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
            rest = rest[(100 * small >= percent * large) & (self.roots(rest) != self.root(i))]
            if len(rest):
                self.measured(i, rest)

    def join(self, home: np.ndarray, lent: np.ndarray) -> None:
        """Link what can be linked between home sets, and between home and lent sets."""
        if not len(home):
            return
        members = np.concatenate([home, lent])
        if len(members) <= SMALL_CELL:
            return self.sweep(home, lent)
        pivots = home[np.linspace(0, len(home) - 1, min(PIVOTS, len(home))).astype(np.int64)]
        cells = self.cells(pivots, members, np.arange(len(members)) < len(home))
        for own, other in cells:
            if len(own) + len(other) > 0.8 * len(members):
                self.sweep(own, other)
            else:
                self.join(own, other)

    def cells(self, pivots: np.ndarray, members: np.ndarray, at_home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Home and lent sets of each pivot's cell that has open home sets, or home sets and open lent ones."""
        distance = np.stack([self.measured(p, members) for p in pivots], 1)
        nearest, closed, lent = voronoi(distance, self.roots(pivots), self.rule.eps)
        unmeasured = at_home & ~np.isin(members, pivots)
        out = []
        for q in range(len(pivots)):
            own = unmeasured & (nearest == q)
            # In the cell where such a lent set is at home it may be closed, and these sets open and lent.
            if not (lent[:, q] & ~at_home & ~closed).any():
                own &= ~closed
            if own.any():
                out.append((members[own], members[lent[:, q] & ~own]))
        return out

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.links, np.int64).reshape(-1, 2)
        return self.prints[pairs[:, 0]], self.prints[pairs[:, 1]]


def voronoi(distance: np.ndarray, joined: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot of each set, whether the set is closed, and the cells it is lent to.

    ``distance`` has a row for each set and a column for each pivot, ``joined`` the component of each pivot.
    """
    nearest = distance.argmin(1)
    close = distance <= 2 * eps
    own = joined[nearest]
    closed = (distance.min(1) <= eps) & ~(close & (joined[None, :] != own[:, None])).any(1)
    return nearest, closed, distance <= distance.min(1)[:, None] + 2 * eps


def _joined_here(regions: DataFrame, rule: Rule) -> DataFrame:
    """Links within regions that fit a task; ``regions`` has ``region, print, shingles, home``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, rows = None, []
        for batch in batches:
            for key, own, data, home in zip(*(c.to_pylist() for c in batch.columns)):
                if key != region:
                    yield from links(rows)
                    region, rows = key, []
                rows.append((own, data, home))
        yield from links(rows)

    def links(rows) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[bytes, bool]] = {}
        for own, data, home in rows:  # equal sets come from copies
            best[own] = (data, home or best.get(own, (b"", False))[1])
        if len(best) < 2:
            return
        order = sorted(best)
        here = _Sets(rule, np.array(order, np.int64), [np.frombuffer(best[p][0], np.uint64) for p in order])
        at_home = np.array([best[p][1] for p in order])
        here.join(np.flatnonzero(at_home), np.flatnonzero(~at_home))
        a, b = here.forest()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return (
        regions.select("region", "print", "shingles", "home")
        .repartition("region")
        .sortWithinPartitions("region")
        .mapInArrow(T.tidy(join), "a long, b long")
    )


def _read_sets(regions: DataFrame, rule: Rule) -> DataFrame:
    """As ``_read``, for sets of regions: a row for each set, packed entries and pairs. Shingles of two regions are different ones."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for whole in batches:
            for batch in _slices(whole, "shingles"):
                data = batch.column(2).to_pylist()
                size = np.array([len(x) // 8 for x in data], np.int64)
                region = T.mix(batch.column(0).to_numpy().view(np.uint64) * T.ODD)
                yield batch, T.mix(np.frombuffer(b"".join(data), np.uint64) ^ np.repeat(region, size)), np.concatenate([[0], np.cumsum(size)])

    sets = regions.select("region", "print", "shingles")
    shared = regions.sparkSession.sparkContext.broadcast(_counts(sets, lambda batches: (shingle for _, shingle, _ in keyed(batches))))
    names = ["print", "n_shingles", "sketch", "kind", "bucket", "n", "data"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch, shingle, first in keyed(batches):
            rows = batch.num_rows
            sketch = _sketched(shingle, first)
            nothing = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first)), sketch, pa.array(np.zeros(rows, np.int32)), *nothing], names)
            held.append(_dealt_out(batch.column(1).to_numpy().view(np.uint64), shingle, first, shared.value, rule))
            count += len(held[-1][0])
            if count >= HELD_ENTRIES * FEW // FEW_AGAIN:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        columns = _packed(held, rule, FEW_AGAIN)
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 2 + [pa.nulls(n, pa.binary()), *columns], names)

    return sets.mapInArrow(T.tidy(read), "print long, n_shingles long, sketch binary, kind int, bucket int, n long, data binary")


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of some ``T.SLICE_BYTES`` of a binary column, or one longer value."""
    ends = np.cumsum([len(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + T.SLICE_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _cut_again(regions: DataFrame, rule: Rule) -> DataFrame:
    """The regions that are left of regions when their own shingles' counts give the order; sets that meet no other are left out."""
    read = materialise(_read_sets(regions, rule), "again")
    parts = components(_coarse(read, read.where("kind = 0").select("print", "n_shingles", "sketch"), rule, FEW_AGAIN))
    parts = parts.select(F.col("node").alias("print"), F.col("component").alias("part"))
    return materialise(regions.join(parts, "print").select(F.col("part").alias("region"), "print", "shingles", "home"), "sets")


def _split(regions: DataFrame, rule: Rule, trial: bool = False) -> DataFrame:
    """One round of pivots over large regions: cells, and links to pivots.

    Rows with a null ``region`` are links: ``print`` and ``other``. The rest are sets of new regions,
    ``closed`` by the pivots or not, and ``foreign`` where they were lent to the old region.
    A trial measures one chunk of each region and gives ``region, rate``, the cells that a set is in on average.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("region").orderBy(F.xxhash64("print"), "print")
    pivots = regions.where("home").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum(F.length("shingles") / 8) / CHUNK_SHINGLES)).cast("int")
    counts = regions.groupBy("region").agg(chunks.alias("salts"))
    salted = regions.join(counts, "region").withColumn("salt", F.pmod(F.xxhash64("print"), F.col("salts")))
    salts = F.array(F.lit(0).cast("long")) if trial else F.sequence(F.lit(0), F.col("salts") - 1).cast("array<bigint>")
    lent = pivots.join(counts, "region").withColumn("salt", F.explode(salts))
    salted = salted.where("salt = 0") if trial else salted
    schema = "region long, rate double" if trial else "region long, print long, shingles binary, home boolean, closed boolean, foreign boolean, other long"
    fields = [("region", pa.int64()), ("print", pa.int64()), ("shingles", pa.binary()), ("home", pa.bool_())]
    fields += [("closed", pa.bool_()), ("foreign", pa.bool_()), ("other", pa.int64())]

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {p: (s, h) for p, s, h in zip(*(left.column(c).to_pylist() for c in ("print", "shingles", "home")))}
        heads = dict(sorted(zip(*(right.column(c).to_pylist() for c in ("pivot_print", "pivot_shingles")))))
        if not left.num_rows:
            return pa.Table.from_pylist([], pa.schema([("region", pa.int64()), ("rate", pa.float64())] if trial else fields))
        names = [*heads, *(p for p in rows if p not in heads)]
        here = _Sets(rule, np.array(names, np.int64), [np.frombuffer(heads.get(p) or rows[p][0], np.uint64) for p in names])
        every, region = np.arange(len(names)), left.column("region")[0].as_py()
        distance = np.stack([here.measured(p, every) for p in range(len(heads))], 1)
        # Only links among pivots may close a set, so that every chunk of the region decides alike.
        common = _Sets(rule, here.prints[: len(heads)], [np.frombuffer(s, np.uint64) for s in heads.values()])
        for p in range(len(heads)):
            common.measured(p, np.arange(len(heads)))
        nearest, closed, near = voronoi(distance, common.roots(np.arange(len(heads))), rule.eps)
        if trial:
            return pa.table({"region": [region], "rate": [float(near.sum(1).mean())]})
        out = []
        for i, p in enumerate(names):
            if p not in rows:
                continue
            is_home = rows[p][1] and p not in heads
            for q in np.flatnonzero(near[i]).tolist():
                out.append((_cell(region, names[q]), p, rows[p][0], bool(is_home and q == nearest[i]), bool(closed[i]), not rows[p][1], None))
        a, b = here.forest()
        out += [(None, x, None, None, None, None, y) for x, y in zip(a.tolist(), b.tolist())]
        columns = list(zip(*out)) if out else [[]] * len(fields)
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return (
        salted.select("region", "salt", "print", "shingles", "home")
        .groupBy("region", "salt")
        .cogroup(lent.select(*(F.col(c).alias(f"pivot_{c}") for c in ("region", "salt", "print", "shingles"))).groupBy("pivot_region", "pivot_salt"))
        .applyInArrow(measure, schema)
    )


def _opened(cells: DataFrame) -> DataFrame:
    """Sets of new regions; closed ones are at home only where open sets were lent, as in ``_Sets.cells``."""
    lent = cells.where("foreign AND NOT closed").select("region").distinct().withColumn("mixed", F.lit(True))
    home = F.col("home") & (~F.col("closed") | F.coalesce("mixed", F.lit(False)))
    return cells.join(lent, "region", "left").select("region", "print", "shingles", home.alias("home"))


def _cell(region: int, pivot: int) -> int:
    mixed = T.mix(np.array([region, pivot], np.int64).view(np.uint64) * T.ODD)
    return int(T.mix(mixed[:1] * T.ODD + mixed[1:]).view(np.int64)[0])


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(
        F.count("*").alias("sets"), F.sum(F.length("shingles") / 8).alias("shingle_count"), F.max("home").alias("open")
    ).where("open")


def _blocks(regions: DataFrame) -> DataFrame:
    """Regions that pivots do not split, as pairs of chunks of their sets: each pair is a region of its own."""
    half = REGION_SETS // 4
    sizes = regions.groupBy("region").agg(
        F.greatest(F.ceil(F.count("*") / half), F.ceil(F.sum(F.length("shingles") / 8) / (REGION_SHINGLES // 4))).cast("int").alias("chunks")
    )
    chunked = regions.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    partner = chunked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return partner.select(
        F.xxhash64("region", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("region"), "print", "shingles", "home"
    ).dropDuplicates(["region", "print", "home"])


def _links(regions: DataFrame, rule: Rule) -> list[DataFrame]:
    """Links of all regions, whatever their size."""
    out, depth, before = [], 0, None
    for _ in range(AGAIN_ROUNDS):
        wide = materialise(_sizes(regions).where(F.col("sets") > AGAIN_SETS).select("region", "sets"), "wide")
        now = wide.agg(F.sum("sets")).first()[0]
        if not now or before and now > 0.9 * before:
            break
        out.append(_joined_here(regions.join(wide, "region", "left_anti"), rule))
        regions, before = _cut_again(regions.join(wide, "region", "left_semi"), rule), now
    fits = (F.col("sets") <= REGION_SETS) & (F.col("shingle_count") <= REGION_SHINGLES)
    while True:
        large = materialise(_sizes(regions).where(~fits).select("region"), "regions")
        if large.isEmpty():
            return [*out, _joined_here(regions, rule)]
        out.append(_joined_here(regions.join(large, "region", "left_anti"), rule))
        rest = regions.join(large, "region", "left_semi")
        if depth == DEPTH:
            return [*out, _joined_here(_blocks(rest), rule)]
        apart = materialise(_split(rest, rule, trial=True).where(F.col("rate") <= LENT).select("region"), "apart")
        out.append(_joined_here(_blocks(rest.join(apart, "region", "left_anti")), rule))
        if apart.isEmpty():
            return out
        rest = rest.join(apart, "region", "left_semi")
        cells = materialise(_split(rest, rule), "cells")
        out.append(cells.where("region IS NULL").select(F.col("print").alias("a"), F.col("other").alias("b")))
        regions = _opened(cells.where("region IS NOT NULL"))
        depth += 1


def _named_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The text of each ``row_key`` of ``named``; others are left out by a bitmap before they would travel."""
    keys = named.select("row_key").withColumn("key", F.xxhash64("row_key"))
    bits, size = bitmap(keys, named.count())
    bit_row, hit = marked("key", size)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").withColumn("key", F.xxhash64("row_key")).withColumn("bit_row", bit_row)
    likely = rows.join(F.broadcast(bits), "bit_row").where(hit).select("row_key", "text")
    # Rows of the same id and text travel once.
    return likely.dropDuplicates(["row_key"]).join(named.hint("merge"), "row_key")


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id``, ``row_key`` and ``root`` for every row of ``docs``.

    ``row_key`` is a hash of id and text; ``root`` is equal within a component and null without shingles.
    ``component_id`` is the smallest ``doc_id`` that links reach, the document itself included. Null and
    empty texts have no shingle and link with nothing. A row with a null ``doc_id`` passes links on, and
    its ``component_id`` is the smallest of the others, or null. Rows that repeat a text form one set;
    a ``doc_id`` on several texts is in one component for each. Other columns are not read. The session's
    limit on the bytes of an Arrow batch is lowered where it has Spark's default.
    """
    bound_batches(docs.sparkSession)
    read = materialise(_read(docs, rule), "shingles")
    rows = read.where("kind = 0").select("doc_id", "row_key", "n_shingles", "print", "salt")
    texts_of = read.where("kind = 0 AND n_shingles > 0").groupBy("print").agg(F.min("row_key").alias("row_key"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    prints = materialise(texts_of, "prints")
    coarse = components(_coarse(read, prints, rule))
    named = materialise(prints.select("row_key", "print").join(coarse, prints["print"] == coarse["node"]).select("component", "print", "row_key"), "named")
    texts = _named_texts(docs, named).select("component", "print", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            shingle, first = shingle_sets(*T.laid_out(batch.column(2)), rule.words)
            packed = pa.array([shingle[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed, pa.array(np.ones(batch.num_rows, bool))], ["region", "print", "shingles", "home"]
            )

    regions = materialise(texts.mapInArrow(T.tidy(sets), "region long, print long, shingles binary, home boolean"), "sets")
    links = None
    for some in _links(regions, rule):
        links = some if links is None else links.unionByName(some)
    group = components(links).select(F.col("node").alias("print"), F.col("component").alias("root"))
    rooted = _dealt(rows, group, "print").select(
        "doc_id", "n_shingles", "row_key", F.when(F.col("n_shingles") > 0, F.coalesce("root", "print")).alias("root"), "salt"
    )
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return _dealt(rooted, least, "root").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "root"
    )


def losers(linked: DataFrame) -> DataFrame:
    """``row_key`` of the rows of a result of ``jaccard_components`` that give way to their component's first document.

    The first has the smallest id, nulls last; rows with the same id and text share a ``row_key`` and stay together.
    """
    rows = linked.where("root IS NOT NULL").select("root", "row_key", "doc_id")
    rank = F.struct(F.isnull("doc_id"), "doc_id", "row_key")
    first = rows.groupBy("root").agg(F.min_by("row_key", rank).alias("first"))
    return rows.join(first, "root").where("row_key <> first").select("row_key").distinct()
