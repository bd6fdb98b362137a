"""Whole texts as numpy arrays: words, lines and n-grams of a batch at once.

Every function takes the bytes of many texts laid end to end with their
offsets, so that no Python code runs per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text handled at once. Arrays of a slice take some thirty times as much.
SLICE_BYTES = 2 << 20
#: Spans longer than this are hashed one by one.
LONG_SPAN = 4096

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters, digits and bytes of other characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def worker_cache() -> dict:
    """What a Python worker keeps between tasks, such as loaded tokenizers."""
    return sys.modules.setdefault("tsweave_worker_cache", types.ModuleType("tsweave_worker_cache")).__dict__


def give_back() -> None:
    """Hand free memory back to the system: workers outlive their tasks, and keep what the largest slice took."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, a function on a task's batches, after which the worker hands back all free memory, Arrow's too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        give_back()

    return run


def tidy_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function on one large group."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        del table
        pa.default_memory_pool().release_unused()
        give_back()
        return out

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = laid_out(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
            give_back()
        pa.default_memory_pool().release_unused()


def spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without separators, and where each text's runs begin."""
    inside = ~separator[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    cuts = at[1:-1][at[1:-1] < len(raw)]
    left = before[:-1].copy()
    left[cuts] = False
    begin = np.flatnonzero(inside & ~left)
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    right = after[1:].copy()
    if len(cuts):
        right[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~right) + 1
    return begin, end, np.searchsorted(begin, at)


def words_of(raw: np.ndarray, at: np.ndarray):
    """Spans of ``[^\\x20\\x09-\\x0D]+``."""
    return spans(raw, at, SPACE)


def lines_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every line of every text, empty lines too, and each text's first line."""
    breaks = np.flatnonzero(raw == 10)
    lines = 1 + np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    first = np.concatenate([[0], np.cumsum(lines)])
    later = np.ones(first[-1], bool)
    later[first[:-1]] = False
    begin = np.empty(first[-1], np.int64)
    begin[first[:-1]] = at[:-1]
    begin[later] = breaks + 1
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    end[first[1:] - 1] = at[1:]
    return begin, end, first


def hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    length = end - begin
    out = mix(length.astype(np.uint64) * ODD + np.uint64(1))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    long = np.flatnonzero(length > LONG_SPAN)
    left = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    step = 0
    while len(left):
        part = eights[begin[left] + step] & _MASK[np.minimum(length[left] - step, 8)]
        out[left] = mix(out[left] * ODD + part)
        step += 8
        left = left[length[left] > step]
    for i in long:
        digest = hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to, from where each text's words begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and the words where such a run fits its text."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(word) - n + 1
    out = mix(word[:size] + ODD)
    for k in range(1, n):
        out = mix(out * ODD + word[k : k + size])
    last = np.repeat(first[1:], np.diff(first))[:size]
    at = np.flatnonzero(np.arange(size) + n <= last)
    return out[at], at


def totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys
