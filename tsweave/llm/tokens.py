"""Token ids of whole texts with a public byte-level BPE vocabulary.

Ids are those of the ``tokenizers`` library for the given file. Texts are cut
before every space that stands alone, where this vocabulary's pattern always
cuts, and only the distinct pieces of a batch are encoded, by a faster encoder
set up from the same file. Texts with other uses of white space, or with one of
the vocabulary's added tokens, go to ``tokenizers`` whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tsweave.llm import text as T

#: Encoding pays for distinct pieces only, so larger slices are cheaper; a slice takes some twenty times as much memory.
SLICE_BYTES = 2 << 20
END_ID = 1
#: Fixed pattern of the vocabulary's family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, then the rest in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Encoder:
    """Encodes the texts of a slice at once."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path) as f:
            file = json.load(f)
        model = file["model"]
        #: Texts that hold one of these are left to the library.
        self.added = [t["content"] for t in file.get("added_tokens", []) if t["content"]]
        vocabulary, letters = model["vocab"], _byte_of_letter()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks stand for merges only if each merge made the next id.
        ids = [vocabulary[a + b] for a, b in merges]
        self.ranked = ids == list(range(256, 256 + len(ids)))
        ranks = {
            bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if all(c in letters for c in piece) and i < 256 + len(ids)
        }
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def of(path: str) -> Encoder:
        kept = T.worker_cache().setdefault("encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
            T.give_back()
        return kept[path]

    def _unusual(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts with white space beside a space, or white space outside ASCII."""
        if not len(raw):
            return np.zeros(len(at) - 1, bool)
        ascii_space, b = _ASCII_SPACE[raw], np.concatenate([raw, np.zeros(2, np.uint8)])
        odd = np.zeros(len(raw), bool)
        odd[1:] = ascii_space[1:] & ascii_space[:-1] & ((raw[1:] == 32) | (raw[:-1] == 32))
        second, third = b[1:-1], b[2:]
        odd |= (raw == 0xC2) & ((second == 0x85) | (second == 0xA0))
        odd |= (raw == 0xE1) & (second == 0x9A)
        odd |= (raw == 0xE2) & (second == 0x80) & ((third <= 0x8A) | ((third >= 0xA8) & (third <= 0xAF)))
        odd |= (raw == 0xE2) & (second == 0x81) & (third == 0x9F)
        odd |= (raw == 0xE3) & (second == 0x80) & (third == 0x80)
        return T.totals(odd, at) > 0

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and how many each has."""
        raw, at = T.laid_out(pieces)
        length = np.diff(at)
        spaced = np.zeros(len(length), bool)
        spaced[length > 0] = raw[at[:-1][length > 0]] == 32
        count = np.zeros(len(length), np.int64)
        plain = np.flatnonzero(~spaced)
        single = [np.array(self.fast.encode_ordinary(bytes(raw[at[i] : at[i + 1]]).decode()), np.uint32) for i in plain]
        count[plain] = [len(s) for s in single]
        joined = raw[np.repeat(spaced, length)]
        ids = self.fast.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()).astype(np.uint32)
        ends = np.cumsum(self.size[ids])
        cut = np.searchsorted(ends, np.cumsum(length[spaced]))
        if len(cut) and not np.array_equal(ends[cut], np.cumsum(length[spaced])):
            raise ValueError("a token crosses a space that stands alone; this vocabulary needs another pattern")
        count[spaced] = np.diff(np.concatenate([[-1], cut]))
        out = np.empty(count.sum(), np.uint32)
        where = np.repeat(spaced, count)
        out[where] = ids
        if single:
            out[~where] = np.concatenate(single)
        return out, count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more at the end)."""
        raw, at = T.laid_out(column)
        texts = len(at) - 1
        unusual = self._unusual(raw, at) if self.ranked else np.ones(texts, bool)
        for token in self.added:
            unusual |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        cut = np.zeros(len(raw), bool)
        cut[raw == 32] = True
        cut[at[:-1][np.diff(at) > 0]] = True
        begin = np.append(np.flatnonzero(cut), len(raw)).astype(np.int64)
        first = np.searchsorted(begin[:-1], at)
        if unusual.any():
            usual = np.repeat(~unusual, np.diff(at))
            raw, length = raw[usual], np.diff(at) * ~unusual
            at = np.concatenate([[0], np.cumsum(length)])
            cut = cut[usual]
            begin = np.append(np.flatnonzero(cut), len(raw)).astype(np.int64)
            first = np.searchsorted(begin[:-1], at)
        pieces = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pieces.dictionary_encode()
        pool, count = self._pieces(coded.dictionary)
        index = coded.indices.to_numpy()
        length = count[index]
        start = (np.cumsum(count) - count)[index]
        before = np.cumsum(length) - length
        ids = pool[np.repeat(start - before, length) + np.arange(length.sum())]
        place = np.append(before, length.sum())[first]
        if unusual.any():
            chosen = np.flatnonzero(unusual)
            parts = [ids[place[i] : place[i + 1]] for i in range(texts)]
            # The library's answers take a hundred bytes a token: only the ids of a text are kept.
            for i in chosen:
                parts[i] = np.array(self.whole.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            place = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, place


def documents_of(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = END_ID) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``doc_id``, ids and where each document's ids begin, slice by slice; ``end_id`` closes every document."""
    encoder = Encoder.of(path)
    for batch in T.slices(batches, most=SLICE_BYTES):
        ids, place = encoder.encode(batch.column(1).fill_null(""))
        if end_id is not None:
            ids = np.insert(ids, place[1:], end_id)
            place = place + np.arange(len(place))
        yield batch.column(0), ids, place
