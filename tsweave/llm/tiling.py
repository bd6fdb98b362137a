"""Benchmark decontamination by greedy string tiling.

1. Every run of ``min_match`` words of a benchmark item is a seed. A bitmap of
   fixed size over all seeds tells, while documents are read once, which of
   their words can lie in a match; the rest of a text never leaves its task.
2. The surviving runs meet the items in a join on the seed.
3. A tile of ``n`` words holds ``n - min_match + 1`` seeds of the item, at least
   one for each ``min_match`` words, so a pair with fewer shared seeds than the
   coverage needs is left out. The others are tiled: the longest common runs that do not
   overlap are marked again and again, found by rolling (Karp-Rabin) hashes of
   falling length, until none of ``min_match`` words is left. What a longer
   tile leaves of a match waits for its turn by length. The share of an item's
   words that lie in tiles is its coverage, whatever their order.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import text as T
from tsweave.session import materialise

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the seed bitmap; a fuller bitmap lets more words pass to the join and loses none.
BITMAP_BITS = 1 << 23

_ROLL = 0x100000001B3
_WRAP = (1 << 64) - 1


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, first = T.spans(raw, at, T.NOT_ALNUM)
    # 0 stands between runs, so no word may hash to it.
    return np.maximum(T.hashes(T.LOWER[raw], begin, end), np.uint64(1)), first


def _rolling(tokens: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Place and hash of every unmarked run of ``size`` tokens."""
    top = pow(_ROLL, size - 1, 1 << 64)
    value = length = 0
    for i, token in enumerate(tokens):
        if marked[i] or not token:
            value = length = 0
            continue
        if length == size:
            value = (value - tokens[i - size] * top) & _WRAP
        else:
            length += 1
        value = (value * _ROLL + token) & _WRAP
        if length == size:
            yield i - size + 1, value


def tiles(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(place in item, place in text, length)``, longest first; 0 in ``text`` matches nothing."""
    taken_item, taken_text = [False] * len(item), [False] * len(text)
    found: list[tuple[int, int, int]] = []

    def reach(i: int, j: int) -> int:
        n = 0
        while (
            i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
            and not taken_item[i + n] and not taken_text[j + n]
        ):
            n += 1
        return n

    def rest(n: int, i: int, j: int) -> Iterator[tuple[int, int, int]]:
        """The unmarked parts of a match, as heap entries: longest first, then by place."""
        begin = None
        for k in range(n + 1):
            free = k < n and not taken_item[i + k] and not taken_text[j + k]
            if free and begin is None:
                begin = k
            elif not free and begin is not None:
                yield begin - k, i + begin, j + begin
                begin = None

    size = max(min_match, min(len(item), 4 * min_match))
    while True:
        places = defaultdict(list)
        for i, value in _rolling(item, taken_item, size):
            places[value].append(i)
        matches = []
        for j, value in _rolling(text, taken_text, size):
            for i in places.get(value, ()):
                # A match that could begin earlier was met there.
                if i and j and item[i - 1] == text[j - 1] and not taken_item[i - 1] and not taken_text[j - 1]:
                    continue
                if (n := reach(i, j)) >= size:
                    matches.append((-n, i, j))
        heapq.heapify(matches)
        while matches:
            n, i, j = heapq.heappop(matches)
            parts = list(rest(-n, i, j))
            if parts == [(n, i, j)]:
                taken_item[i : i - n] = taken_text[j : j - n] = [True] * -n
                found.append((i, j, -n))
                continue
            # What longer tiles left of it waits for its turn by length; parts below this size are met in a later pass.
            for part in parts:
                if -part[0] >= size:
                    heapq.heappush(matches, part)
        if size == min_match:
            return found
        size = max(min_match, size // 2)


def _items(benchmark: DataFrame, min_match: int) -> DataFrame:
    """Each distinct item with its words, their number, and its distinct seeds and how often each stands there.

    Items too short for a seed are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            word, first = _words(*T.laid_out(batch.column(1)))
            rows = []
            for i in range(batch.num_rows):
                own = word[first[i] : first[i + 1]]
                if len(own) >= min_match:
                    seeds, _ = T.grams(own, np.array([0, len(own)]), min_match)
                    seeds, times = np.unique(seeds, return_counts=True)
                    rows.append((i, own.tobytes(), len(own), seeds.view(np.int64), times))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4)),
                ],
                ["item_id", "item", "words", "seeds", "times"],
            )

    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    return items.mapInArrow(T.tidy(read), "item_id long, item binary, words long, seeds array<long>, times array<long>").withColumn("item_key", F.xxhash64("item_id", "item"))


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bits of all seeds, gathered as at most ``bits / 64`` numbers."""
    bit = F.pmod("seed", F.lit(bits))
    rows = (
        seeds.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(seed, {bits}) % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"]] = rows["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _runs(docs: DataFrame, bitmap: np.ndarray, min_match: int) -> DataFrame:
    """Documents with words that the bitmap lets pass: those words in runs parted by 0, and the seeds."""

    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in T.slices(batches):
            word, first = _words(*T.laid_out(batch.column(1)))
            seeds, place = T.grams(word, first, min_match)
            hit = bitmap[(seeds % np.uint64(len(bitmap))).astype(np.int64)]
            seeds, place = seeds[hit], place[hit]
            doc = np.searchsorted(first, place, "right") - 1
            rows = []
            for i in np.unique(doc):
                own = slice(*np.searchsorted(doc, [i, i + 1]))
                # Words in any seed; runs of seeds end where the next begins after their last word.
                cover = np.unique((place[own][:, None] + np.arange(min_match)).ravel())
                gap = np.flatnonzero(np.diff(cover) > 1) + 1
                rows.append((i, np.insert(word[cover], gap, 0).tobytes(), np.unique(seeds[own]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in (0, 2)),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ],
                ["doc_id", "row_key", "runs", "seeds"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(T.tidy(read), "doc_id long, row_key long, runs binary, seeds array<long>")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
             bits: int = BITMAP_BITS) -> DataFrame:
    """Pairs whose tiles cover at least ``coverage`` of the item.

    Returns ``doc_id, row_key (hash of id and text), item_id, item_words, matched_words, n_tiles, longest_tile, coverage``. Null ids
    are kept as null; null and empty texts match nothing; items shorter than ``min_match`` words are
    never reported. Repeated rows of either table give one row per distinct id and text. Other
    columns are not read.
    """
    items = materialise(_items(benchmark, min_match), "benchmark-items")
    seeds = items.select("item_key", "words", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("times").alias("times"))))
    hits = materialise(_runs(docs, _bitmap(seeds, bits), min_match), "benchmark-runs").dropDuplicates(["row_key"])
    shared = (
        hits.select("row_key", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("row_key", "item_key")
        .agg(F.sum("times").alias("n"), F.max("words").alias("words"))
        # Exact: tiles that cover enough words hold at least so many places of seeds.
        .where(F.col("n") * min_match >= F.floor(F.col("words") * coverage))
    )
    pairs = (
        shared.select("row_key", "item_key")
        .join(hits.select("row_key", "doc_id", "runs"), "row_key")
        .join(items.select("item_key", "item_id", "item"), "item_key")
        .select("doc_id", "row_key", "item_id", "runs", "item")
    )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for runs, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                own = np.frombuffer(item, np.uint64).tolist()
                found = tiles(own, np.frombuffer(runs, np.uint64).tolist(), min_match)
                rows.append((len(own), sum(n for *_, n in found), len(found), max((n for *_, n in found), default=0)))
            new = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(new[:, k]) for k in range(4))],
                ["doc_id", "row_key", "item_id", "item_words", "matched_words", "n_tiles", "longest_tile"],
            )

    schema = "doc_id long, row_key long, item_id long, item_words long, matched_words long, n_tiles long, longest_tile long"
    covered = pairs.mapInArrow(T.tidy(tile), schema).withColumn("coverage", F.col("matched_words") / F.col("item_words"))
    return covered.where(F.col("coverage") >= coverage)
