"""Periodic runs of words, by a suffix automaton with link-cut access.

The suffix automaton of a stretch of words has a tree of suffix links. The
prefix that ends at word ``i`` is a node of it, and the nodes above are its
suffixes. Access to that node recolours the path to the root with ``i``, the
last end of all those suffixes. The path falls into segments of one earlier
colour ``e``: their words ended at ``e`` before. A segment of length ``L`` and
distance ``p = i - e <= L`` shows a square of period ``p`` that ends at ``i``,
and its length gives the whole extent to the left, so that the squares of one
run are joined by their start and period. For lengths of at least twice the
period the last occurrence is exactly one smallest period away, so no multiple
of a period is ever reported.

The tree is finished before the first access, so the preferred paths need no
splay trees: each heavy path keeps a stack of its coloured segments, and access
takes those above the node off it. Access costs O(log n) segments on average.

Only words that can lie in a run get there. A run of at least 24 words and
three periods is covered by windows of 16 words that stand twice in it. So
words that no repeated window covers are cut out, again and again within each
stretch that is left. This leaves out no run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsweave.llm import text as T

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Every run is covered by windows of this many words that stand in it twice: 24 - 8, or two periods from 9 words on.
WINDOW = 16
#: Rounds of cutting; what is left then may hold words of no run, and is searched all the same.
ROUNDS = 12
#: Text handled at once. Long texts are a slice of their own.
SLICE_BYTES = 2 << 20

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>"
)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of all states, and the state of each prefix."""
    link, length, prefix = [-1], [0], []
    # One dictionary for all transitions; words are numbered densely.
    base = max(words, default=0) + 1
    edges: dict[int, int] = {}
    out: list[list[int]] = [[]]
    last = 0
    for word in words:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        out.append([])
        prefix.append(new)
        at = last
        while at >= 0 and at * base + word not in edges:
            edges[at * base + word] = new
            out[at].append(word)
            at = link[at]
        if at >= 0:
            target = edges[at * base + word]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(link)
                link.append(link[target])
                length.append(length[at] + 1)
                out.append(list(out[target]))
                for w in out[copy]:
                    edges[copy * base + w] = edges[target * base + w]
                while at >= 0 and edges.get(at * base + word) == target:
                    edges[at * base + word] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return link, length, prefix


class LastEnds:
    """Colours of a rooted tree's paths: access gives the segments of earlier colours and recolours them."""

    def __init__(self, link: list[int], length: list[int]):
        size = len(link)
        order = np.argsort(np.asarray(length), kind="stable").tolist()
        weight, heavy = [1] * size, [-1] * size
        for v in reversed(order):
            up = link[v]
            if up >= 0:
                weight[up] += weight[v]
                if heavy[up] < 0 or weight[v] > weight[heavy[up]]:
                    heavy[up] = v
        head = list(range(size))
        for v in order:
            if heavy[v] >= 0:
                head[heavy[v]] = head[v]
        self.link, self.length, self.head = link, length, head
        #: For each head: coloured segments of its path as (length of the deepest node, colour), topmost last.
        self.stacks: dict[int, list[tuple[int, int]]] = {}

    def access(self, node: int, colour: int, least: int) -> dict[int, int]:
        """Earlier colours on the path above ``node``, each with the longest length there; the path gets ``colour``.

        Nodes of fewer than ``least`` words are not told apart.
        """
        found: dict[int, int] = {}
        link, length, head, stacks = self.link, self.length, self.head, self.stacks
        while node >= 0 and length[node] >= least:
            top, deep = head[node], length[node]
            stack = stacks.setdefault(top, [])
            while stack:
                end, old = stack[-1]
                shared = end if end < deep else deep
                if found.get(old, 0) < shared:
                    found[old] = shared
                if end > deep:
                    # What lies below the node keeps its colour.
                    break
                stack.pop()
                if end == deep:
                    break
            stack.append((deep, colour))
            node = link[top]
        return found


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs in a sequence of word numbers."""
    _, dense = np.unique(words, return_inverse=True)
    link, length, prefix = automaton(dense.tolist())
    ends = LastEnds(link, length)
    found: dict[tuple[int, int], int] = {}
    for i, node in enumerate(prefix):
        for before, common in ends.access(node, i, WINDOW).items():
            period = i - before
            if common >= (LEAST_PERIODS - 1) * period and common + period >= LEAST_WORDS:
                found[i - common - period + 1, period] = i
    return [(start, end - start + 1, period) for (start, period), end in found.items()]


def stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that may hold runs, within the texts that ``first`` parts."""
    begin, end = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    for _ in range(ROUNDS):
        long = end - begin >= LEAST_WORDS
        begin, end = begin[long], end[long]
        if not len(begin):
            break
        size = end - begin
        local = np.concatenate([[0], np.cumsum(size)])
        picked = np.repeat(begin - local[:-1], size) + np.arange(local[-1])
        windows, place = T.grams(words[picked], local, WINDOW)
        owner = T.owners(local)
        twice = place[T.repeated(T.mix(windows ^ T.mix((owner[place] + 1).astype(np.uint64) * T.ODD)))]
        edges = np.zeros(local[-1] + 1, np.int64)
        np.add.at(edges, twice, 1)
        np.add.at(edges, twice + WINDOW, -1)
        covered = np.cumsum(edges[:-1]) > 0
        # Stretches end with their text, too.
        starts = covered.copy()
        starts[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
        stops = covered.copy()
        stops[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
        new_begin, new_end = picked[np.flatnonzero(starts)], picked[np.flatnonzero(stops)] + 1
        if covered.all() and len(new_begin) == len(begin):
            break
        begin, end = new_begin, new_end
    return begin, end


def reordered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word of the text stands at each place, or none if the text stays as it is.

    Texts whose id's CRC ends in 0 go on periodically from some word; those
    with a null id stay as they are.
    """
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and digests of a batch of ``doc_id, text``."""
    for batch in T.slices(batches, "text", SLICE_BYTES):
        raw, at = T.laid_out(batch.column(1))
        begin, end, first = T.words_of(raw, at)
        words = T.hashes(raw, begin, end)
        ids = batch.column(0).to_pylist()
        moved = {}
        for k, doc_id in enumerate(ids):
            index = reordered(doc_id, int(first[k + 1] - first[k]))
            if index is not None:
                moved[k] = index
                words[first[k] : first[k + 1]] = words[first[k] + index]
        found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        for b, e in zip(*stretches(words, first)):
            k = int(np.searchsorted(first, b, "right")) - 1
            found[k] += [(int(b - first[k]) + s, n, p) for s, n, p in runs_of(words[b:e])]
        rows = []
        for k, doc_id in enumerate(ids):
            runs = sorted(found[k], key=lambda r: (r[0], r[2]))
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            tokens = raw[at[k] : at[k + 1]].tobytes().split()
            if k in moved:
                tokens = [tokens[j] for j in moved[k].tolist()]
            if runs:
                edges = np.zeros(len(tokens) + 1, np.int64)
                for start, length, period in runs:
                    edges[start + period] += 1
                    edges[start + length] -= 1
                tokens = [tokens[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            rows.append(
                {
                    "doc_id": doc_id,
                    "n_runs": len(runs),
                    "start": best and best[0],
                    "length": best and best[1],
                    "period": best and best[2],
                    "exponent_milli": best and 1000 * best[1] // best[2],
                    "runs_sha256": _digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()),
                    "collapsed_sha256": _digest(b" ".join(tokens)),
                    "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, ROWS)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
    + [("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(_RUN))]
)


def document_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the runs of its words, the strongest one, and digests.

    ``start, length, period, exponent_milli`` are of the run with the greatest
    length / period and null without runs. ``collapsed_sha256`` is of the text
    with every run cut to its first period. Null and empty texts have no words
    and no runs. Rows are judged one by one: repeated rows alike, other columns
    not read. Texts stay where they are read; one text is one task's work, and
    the automaton takes some 500 bytes for each word of a stretch that repeats.
    """
    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)
