"""An n-gram trie in Elias-Fano form, built and queried on arrays.

Level one holds the contexts, level two the words that followed each. All
sequences are monotone and stored by the Elias-Fano rule: low bits as they
are, here in whole bytes, high bits as gaps in unary. Words of a context are
stored relative to the word before its range, which makes the whole level
monotone; pointers say where each range begins. Beside the words lie their
probabilities as 16-bit codes on a logarithmic scale. ``save`` writes each
array to a file of its own and ``open`` maps the files into memory.
"""

from __future__ import annotations

import os

import numpy as np

#: Logarithms to base 10 from ``LEAST`` to 0 are told apart in 65,534 steps; code 0 means absent.
LEAST, STEPS = -12.0, 65_534


def encode_log(value: np.ndarray) -> np.ndarray:
    return (1 + np.round((1 - np.maximum(value, LEAST) / LEAST) * STEPS)).astype(np.uint16)


def decode(code: np.ndarray) -> np.ndarray:
    """Probability of each code; 0 for absent ones."""
    return np.where(code == 0, 0.0, 10.0 ** ((1 - (code.astype(float) - 1) / STEPS) * LEAST))


class EliasFano:
    """A monotone sequence of unsigned 64-bit numbers."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, size: int):
        self.low, self.high, self.ones, self.size = low, high, ones, size

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        size = len(values)
        top = int(values[-1]) if size else 0
        bits = max(0, (top // max(size, 1)).bit_length())
        width = next(w for w in (1, 2, 4, 8) if 8 * w >= bits)
        if width == 8:
            low, high = values.astype(np.uint64), np.zeros(size, np.int64)
        else:
            low = (values & np.uint64((1 << 8 * width) - 1)).astype(f"u{width}")
            high = (values >> np.uint64(8 * width)).astype(np.int64)
        place = high + np.arange(size)
        words = np.zeros((int(place[-1]) // 64 + 1 if size else 0), np.uint64)
        np.bitwise_or.at(words, place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return EliasFano(low, words, ones, size)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at ``index``: the low part, and the place of the index-th one among the high bits."""
        word = np.searchsorted(self.ones, index, "right") - 1
        rest, bits, place = (index - self.ones[word]).astype(np.uint64), self.high[word], word * 64
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.uint64)
            on = rest >= count
            rest = np.where(on, rest - count, rest)
            bits = np.where(on, bits >> np.uint64(step), bits)
            place = place + np.where(on, step, 0)
        high = (place - index).astype(np.uint64)
        width = self.low.dtype.itemsize
        return self.low[index].astype(np.uint64) if width == 8 else (high << np.uint64(8 * width)) | self.low[index].astype(np.uint64)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}


def _successor(sequence: EliasFano, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First place in ``[low, high)`` whose value is at least ``value``, or ``high``."""
    low, high = low.copy(), high.copy()
    while len(active := np.flatnonzero(low < high)):
        middle = (low[active] + high[active]) // 2
        less = sequence[middle] < value[active]
        low[active] = np.where(less, middle + 1, low[active])
        high[active] = np.where(less, high[active], middle)
    return low


class Trie:
    """Two levels: contexts, and the words after each with their probability codes."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.words, self.codes = contexts, pointers, words, codes

    @staticmethod
    def of(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> Trie:
        """From distinct pairs in rising order of context, then word."""
        head = np.ones(len(context), bool)
        head[1:] = context[1:] != context[:-1]
        begin = np.flatnonzero(head)
        last = word[np.append(begin[1:], len(word)) - 1] if len(word) else word
        # Each range stands on the last value of the one before.
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]]) if len(last) else last
        level = word + np.repeat(base, np.diff(np.append(begin, len(word))))
        pointers = np.append(begin, len(word)).astype(np.uint64)
        return Trie(EliasFano.of(context[head]), EliasFano.of(pointers), EliasFano.of(level), code)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 for absent ones. Contexts in rising order are searched once each."""
        out = np.zeros(len(word), np.uint16)
        if not self.contexts.size or not len(word):
            return out
        head = np.ones(len(context), bool)
        head[1:] = context[1:] != context[:-1]
        distinct = context[head]
        place = _successor(self.contexts, np.zeros(len(distinct), np.int64), np.full(len(distinct), self.contexts.size), distinct)
        known = place < self.contexts.size
        known[known] = self.contexts[place[known]] == distinct[known]
        at = np.where(known, place, 0)
        low, high = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
        base = np.where(low > 0, self.words[np.maximum(low - 1, 0)], 0)
        of = np.cumsum(head) - 1
        asked = np.flatnonzero(known[of])
        of = of[asked]
        value = word[asked] + base[of]
        found = _successor(self.words, low[of], high[of], value)
        there = found < high[of]
        there[there] = self.words[found[there]] == value[there]
        out[asked[there]] = self.codes[found[there]]
        return out

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        sizes = []
        for name in ("contexts", "pointers", "words"):
            level = getattr(self, name)
            sizes.append(level.size)
            for part, array in level.arrays().items():
                np.save(os.path.join(folder, f"{name}.{part}.npy"), array)
        np.save(os.path.join(folder, "codes.npy"), self.codes)
        np.save(os.path.join(folder, "sizes.npy"), np.array(sizes))

    @staticmethod
    def open(folder: str) -> Trie:
        def mapped(name: str) -> np.ndarray:
            path = os.path.join(folder, name + ".npy")
            return np.load(path, mmap_mode="r")

        sizes = np.load(os.path.join(folder, "sizes.npy"))
        levels = [
            EliasFano(mapped(f"{n}.low"), mapped(f"{n}.high"), mapped(f"{n}.ones"), int(s)) for n, s in zip(("contexts", "pointers", "words"), sizes)
        ]
        return Trie(*levels, mapped("codes"))
