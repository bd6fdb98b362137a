"""Ranked lexical search by groups of documents that match the same terms.

Queries are the items of a table, answered against all documents:

*Blocks.* One pass over the texts writes, for each block of documents, how
many terms each one has and the postings of the queries' terms: document and
frequency. Nothing else of the texts is kept. Sums over the blocks give the
counts of the whole corpus.

*Masks.* In a block every item sets one bit a term in the mask of each document
that has it, and documents of equal masks form a group. The highest score of
any posting of a term in the block bounds what the term can give, so a mask's
bound is the sum over its terms. Groups are scored in descending order of
their bounds. The item is finished in the block when it has its full number of
documents and the next bound lies below the last of them; documents of equal
scores are thus always seen. What the blocks hand on, at most ten documents an
item, is ranked once more over all blocks.

Queries are worked off in batches of bounded size, so that neither the terms
that travel to the tasks nor a block's postings grow with the query table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tsweave.llm import text as T
from tsweave.session import materialise

TOP = 10
#: Documents and postings of a block.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 16_384, 1_000_000
#: Text of the items of a batch; a longer item is a batch of its own.
BATCH_BYTES = 4 << 20

BLOCKS = "ids array<bigint>, lengths array<bigint>, term array<int>, df array<int>, freq binary, place binary, matched bigint, n_terms bigint"


def terms_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, A-Z in lower case, and where each text's terms begin."""
    begin, end, first = T.spans(raw, at, T.NOT_ALNUM)
    return T.hashes(T.LOWER[raw], begin, end), first


@dataclass(frozen=True)
class Batch:
    """Items and their terms: numbers into ``vocabulary``, the sorted hashes of all terms."""

    items: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Batch:
        hashed, first = terms_of(*T.laid_out(pa.array([text for _, text in rows], pa.string())))
        own: dict[int | None, list[np.ndarray]] = {}
        for k, (item, _) in enumerate(rows):
            own.setdefault(item, []).append(hashed[first[k] : first[k + 1]])
        vocabulary = np.unique(hashed)
        return Batch(list(own), vocabulary, [np.searchsorted(vocabulary, np.unique(np.concatenate(x))) for x in own.values()])


def batches(items: DataFrame, most: int = BATCH_BYTES) -> Iterator[Batch]:
    """The items by id, read to the driver one batch at a time. Rows of one id are one item with all their terms."""
    rows, size, last = [], 0, None
    for item, text in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if rows and size > most and item != last:
            yield Batch.of(rows)
            rows, size = [], 0
        rows.append((item, text))
        size, last = size + len(text or ""), item
    if rows:
        yield Batch.of(rows)


def blocks(docs: DataFrame, vocabulary: np.ndarray, most: int = BLOCK_DOCUMENTS) -> DataFrame:
    """Postings of the vocabulary in blocks of documents, cut as the texts are read."""

    def pack(ids, counts, matched, n_terms, doc, term, freq) -> pa.RecordBatch:
        doc, term, freq = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, term, freq))
        order = np.argsort(term, kind="stable")
        present, df = np.unique(term, return_counts=True)
        has, place = np.unique(doc, return_inverse=True)
        row = {
            "ids": [ids[k] for k in has.tolist()],
            "lengths": [int(counts[k]) for k in has.tolist()],
            "term": present.tolist(),
            "df": df.tolist(),
            "freq": freq[order].astype("<i4").tobytes(),
            "place": place[order].astype("<i4").tobytes(),
            "matched": matched,
            "n_terms": n_terms,
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, kept = [], [], ([], [], [])
        matched = n_terms = postings = 0
        for batch in T.slices(rows, "text"):
            hashed, first = terms_of(*T.laid_out(batch.column(1)))
            n = np.diff(first)
            matched, n_terms = matched + int((n > 0).sum()), n_terms + int(n.sum())
            if len(vocabulary):
                number = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                known = vocabulary[number] == hashed
                pair = T.owners(first)[known] * len(vocabulary) + number[known]
                pair, freq = np.unique(pair, return_counts=True)
                for store, part in zip(kept, (pair // len(vocabulary) + len(ids), pair % len(vocabulary), freq)):
                    store.append(part)
                postings += len(pair)
            ids += batch.column(0).to_pylist()
            counts += n.tolist()
            if len(ids) >= most or postings >= BLOCK_POSTINGS:
                yield pack(ids, counts, matched, n_terms, *kept)
                ids, counts, kept = [], [], ([], [], [])
                matched = n_terms = postings = 0
        if ids:
            yield pack(ids, counts, matched, n_terms, *kept)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, BLOCKS)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK = pa.schema(
    [("ids", _LONGS), ("lengths", _LONGS), ("term", _INTS), ("df", _INTS), ("freq", pa.binary()), ("place", pa.binary())]
    + [("matched", pa.int64()), ("n_terms", pa.int64())]
)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, terms with repeats, and the weight of each term of the vocabulary."""

    matched: int
    n_terms: int
    weight: np.ndarray

    @staticmethod
    def of(packed: DataFrame, size: int) -> Corpus:
        matched, n_terms = packed.agg(F.sum("matched"), F.sum("n_terms")).first()
        pair = F.explode(F.arrays_zip("term", "df")).alias("x")
        # One row for each term of the batch at most.
        rows = packed.select(pair).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()
        weight = np.zeros(size, np.int64)
        for term, df in rows:
            weight[term] = math.floor(1000 * math.log((2 * matched + 2) / (2 * df + 1)))
        return Corpus(matched or 0, n_terms or 0, weight)


def impacts(weight: np.ndarray, freq: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What each posting adds to a score."""
    m = 100 - 90 + (90 * length * corpus.matched) // corpus.n_terms
    return weight * ((1_000_000_000 * freq) // (1000 * freq + 8 * m))


def scores(rows: np.ndarray, terms: list[int], postings: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Score of each of some documents, by ascending place."""
    sums = np.zeros(len(rows), np.int64)
    for t in terms:
        at, adds, _ = postings[t]
        there = np.minimum(np.searchsorted(at, rows), len(at) - 1)
        sums += np.where(at[there] == rows, adds[there], 0)
    return sums


def best_of_block(terms: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, size: int, top: int) -> list[tuple[int, int]]:
    """``(place, score)`` of the item's best documents in a block, and of all that tie with the last.

    ``postings`` has, for each term, the places of its documents, what it adds to each, and the most of these.
    """
    held = [t for t in terms.tolist() if t in postings]
    if not held:
        return []
    mask = np.zeros((size, -(-len(held) // 64)), np.uint64)
    for bit, t in enumerate(held):
        mask[postings[t][0], bit // 64] |= np.uint64(1 << (bit % 64))
    some = np.flatnonzero(mask.any(1))
    if mask.shape[1] == 1:
        masks, group = np.unique(mask[some, 0], return_inverse=True)
        masks = masks[:, None]
    else:
        masks, group = np.unique(mask[some], axis=0, return_inverse=True)
    group = group.reshape(-1)
    bound = np.zeros(len(masks), np.int64)
    for bit, t in enumerate(held):
        bound += postings[t][2] * ((masks[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64)
    by_group = np.argsort(group, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(masks)))])
    score = np.zeros(0, np.int64)
    place = np.zeros(0, np.int64)
    queue = np.argsort(-bound, kind="stable")
    sizes = np.concatenate([[0], np.cumsum(np.diff(edge)[queue])])
    done = 0
    while done < len(queue):
        least = np.sort(score)[-top] if len(score) >= top else 0
        if bound[queue[done]] < max(least, 1):
            break
        # Some masks at once: as many documents as have been scored before, and no mask whose bound is too low already.
        upto = int(np.searchsorted(sizes, sizes[done] + max(top, sizes[done])))
        step = queue[done : max(upto, done + 1)]
        step = step[bound[step] >= max(least, 1)]
        done += len(step)
        rows = np.sort(some[np.concatenate([by_group[edge[g] : edge[g + 1]] for g in step])])
        score, place = np.concatenate([score, scores(rows, held, postings)]), np.concatenate([place, rows])
        if len(score) > top:
            keep = score >= np.sort(score)[-top]
            score, place = score[keep], place[keep]
    above = score > 0
    score, place = score[above], place[above]
    # Ties beyond the last place are settled by id, here and between blocks.
    order = np.lexsort((ids[place], -score))[:top]
    return list(zip(place[order].tolist(), score[order].tolist()))


def _search(packed: DataFrame, batch: Batch, corpus: Corpus, top: int) -> DataFrame:
    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for row in rb.to_pylist():
                length = np.asarray(row["lengths"], np.int64)
                freq, place = np.frombuffer(row["freq"], "<i4").astype(np.int64), np.frombuffer(row["place"], "<i4").astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(np.asarray(row["df"], np.int64))])
                adds = impacts(np.repeat(corpus.weight[row["term"]], row["df"]), freq, length[place], corpus)
                postings = {t: (place[a:b], adds[a:b], int(adds[a:b].max())) for t, a, b in zip(row["term"], edge[:-1].tolist(), edge[1:].tolist())}
                ids = np.array([np.iinfo(np.int64).max if x is None else x for x in row["ids"]], np.int64)
                out = []
                for item, terms in zip(batch.items, batch.terms):
                    out += [(item, row["ids"][k], score) for k, score in best_of_block(terms, postings, ids, len(ids), top)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["item_id", "doc_id", "score"])

    # A block is one row of packed arrays, so a task holds few at a time.
    return packed.drop("matched", "n_terms").mapInArrow(scan, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents with the highest score above 0 for each item: ``item_id, rank, doc_id, score``.

    Equal scores are ranked by ascending ``doc_id``, null ids last. Repeated
    rows of ``docs`` are documents of their own; rows of ``items`` with the same id
    are one item with the terms of all. Items without a term that any document
    has, documents without terms, and empty tables give no rows. Other columns
    are not read.
    """
    found = []
    for batch in batches(items):
        packed = materialise(blocks(docs, batch.vocabulary), "lexical-blocks")
        corpus = Corpus.of(packed, len(batch.vocabulary))
        if corpus.n_terms:
            found.append(_search(packed, batch, corpus, top))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

