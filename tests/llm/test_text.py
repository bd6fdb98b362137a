import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tsweave.llm import text as T

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t|語", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_lines(values):
    raw, at = T.laid_out(pa.array(values, pa.string()))
    begin, end, first = T.words_of(raw, at)
    got = [[bytes(raw[b:e]).decode() for b, e in zip(begin[i:j], end[i:j])] for i, j in zip(first, first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", v or "") for v in values]
    begin, end, first = T.lines_of(raw, at)
    got = [[bytes(raw[b:e]).decode() for b, e in zip(begin[i:j], end[i:j])] for i, j in zip(first, first[1:])]
    assert got == [(v or "").split("\n") for v in values]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_equal_spans_hash_alike(values):
    raw, at = T.laid_out(pa.array(values, pa.string()))
    begin, end, _ = T.words_of(raw, at)
    words, found = [bytes(raw[b:e]) for b, e in zip(begin, end)], T.hashes(raw, begin, end)
    assert len(set(words)) == len(set(found.tolist())) == len({(w, h) for w, h in zip(words, found.tolist())})


def test_long_spans():
    a, b = "x" * 5000, "x" * 4999 + "y"
    raw, at = T.laid_out(pa.array([a, b, a]))
    begin, end, _ = T.words_of(raw, at)
    h = T.hashes(raw, begin, end)
    assert h[0] == h[2] != h[1]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(T.slices(iter([batch]), most=20))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 1


def test_grams_stay_in_their_text():
    word, first = np.arange(6, dtype=np.uint64), np.array([0, 2, 2, 6])
    _, place = T.grams(word, first, 3)
    assert place.tolist() == [2, 3]
