import json
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tsweave.llm import cost_packing, packing, text as T, token_matrix, tokens


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["", None, " a", "a ", "a  b", "a   b\n\n c", "\n", "foo's it's 12'34 don't", "a\tb \tc", "é\u00a0 x", "<|endoftext|> hi", "   ", "b c\n\nd\u2003e"]


def test_ids_equal_the_library(reference, small):
    texts = ODD + [r.text for r in small("documents").select("text").collect()]
    ids, place = tokens.Encoder(tokens.default_path()).encode(pa.array(texts, pa.string()).fill_null(""))
    assert all([*ids[place[i] : place[i + 1]].tolist(), 1] == reference(t) for i, t in enumerate(texts))


def test_added_tokens_are_one_id(reference):
    ids, place = tokens.Encoder.of(tokens.default_path()).encode(pa.array(["<|endoftext|> hi", "a<|endoftext|>", "hi"]))
    assert ids[place[0] : place[1]].tolist() == [50256, 23105] and len(ids[place[1] : place[2]]) == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' 1\n\té.", max_size=25), min_size=1, max_size=5))
def test_any_text(texts):
    encoder = tokens.Encoder.of(tokens.default_path())
    ids, place = encoder.encode(pa.array(texts))
    assert [ids[place[i] : place[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]


def held(rows, docs, reference, length):
    """Every id of every document lies in just one piece, and sequences are gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    crcs = lambda ids, own: all(
        zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own
    )
    expected = {}
    for d in docs:
        expected.setdefault((d.doc_id, len(reference(d.text))), []).append(reference(d.text))
    assert set(expected) == set(by_doc)
    for key, own in by_doc.items():
        assert sum(r.length for r in own) == key[1] * len(expected[key])
        if len(expected[key]) == 1:
            assert crcs(expected[key][0], own)
    return by_sequence


def test_both_packers(spark, odd_docs, reference):
    docs = odd_docs.select("doc_id", "text").collect()
    for shard in (1, 4 << 20):
        blocks = token_matrix.matrices(odd_docs, length=512, shard_tokens=shard)
        held(token_matrix.pieces(blocks).collect(), docs, reference, 512)
        held(cost_packing.pack_balanced(odd_docs, length=512, shard_tokens=shard).collect(), docs, reference, 512)


def test_little_padding(spark, small, reference):
    docs = small("documents").coalesce(1)
    for rows, share in ((cost_packing.pack_balanced(docs), 0.01), (token_matrix.pieces(token_matrix.matrices(docs)), 0.02)):
        rows = rows.collect()
        sequences = held(rows, docs.select("doc_id", "text").collect(), reference, 2048)
        assert 1 - sum(r.length for r in rows) / (2048 * len(sequences)) < share


def test_a_shard_is_gathered_piece_by_piece(monkeypatch):
    """A full shard leaves its worker in small batches, and takes less memory than its ids do."""
    ids = np.arange(4 << 20, dtype=np.uint32)
    place = np.append(np.arange(0, len(ids), 3000), len(ids))
    shard = packing.Shard(pa.array(np.arange(len(place) - 1)), ids, place)
    monkeypatch.setattr(packing, "numbered", lambda *_: iter([(0, shard)]))
    found, largest = 0, 0
    tracemalloc.start()
    for batch in cost_packing.packed(iter([]), "", 2048, cost_packing.QUADRATIC_AT, 4 << 20):
        found += sum(batch.column(2).to_pylist())
        largest = max(largest, batch.column(3).nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(ids) and largest < 8 * cost_packing.BATCH_TOKENS and peak < ids.nbytes


def test_matrix_round_trip(spark, small, tmp_path, reference):
    path = f"file:{tmp_path}/blocks"
    token_matrix.write_matrices(small("documents"), path, length=256)
    texts = {r.doc_id: reference(r.text) for r in small("documents").collect()}
    found = {k: {} for k in texts}
    for row in spark.read.parquet(path).collect():
        ids, positions, cuts = token_matrix.matrix(row)
        assert cuts[0] == 0 and cuts[-1] == ids.size and np.array_equal(np.flatnonzero(positions.ravel() == 0), cuts[:-1])
        assert (np.diff(cuts) <= 256).all() and all(b // 256 == (e - 1) // 256 for b, e in zip(cuts, cuts[1:]))
        for b, e, p in zip(cuts, cuts[1:], row.pieces):
            if p.doc_tokens:
                found[p.doc_id][p.start] = ids.ravel()[b:e].tolist()
            else:
                assert (ids.ravel()[b:e] == token_matrix.PAD_ID).all()
    assert {k: [i for s in sorted(v) for i in v[s]] for k, v in found.items()} == texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    lengths = np.array(lengths, np.int64)
    sequence, offset = token_matrix.best_fit_decreasing(lengths, 64)
    free, where = [], {}
    for p in np.argsort(-lengths, kind="stable"):
        fits = [i for i, f in enumerate(free) if f >= lengths[p]]
        best = min(fits, key=lambda i: free[i]) if fits else len(free)
        if best == len(free):
            free.append(64)
        where[p] = free[best]
        free[best] -= lengths[p]
    assert len(set(sequence.tolist())) == len(free) and sorted(64 - np.bincount(sequence, lengths, len(free)).astype(int)) == sorted(free)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=50))
def test_balance_takes_the_cheapest(lengths):
    lengths = np.array(lengths, np.int64)
    placed = cost_packing.balance(lengths, 32, 16)
    need = -(-int(lengths[lengths < 32].sum()) // 32)
    assert len({s for *_, s, _ in placed}) == need + int((lengths == 32).sum())
    got = np.zeros(len(lengths), int)
    cost, free = {}, {}
    whole = int((lengths == 32).sum())
    for p, start, n, s, offset in placed:
        assert start == got[p] and (s < whole or offset == 32 - free.get(s, 32))
        got[p] += n
        if s >= whole and start == 0 and n == lengths[p]:
            open_to = [cost.get(k, 0.0) for k in range(whole, whole + need) if free.get(k, 32) >= n]
            assert cost.get(s, 0.0) == min(open_to)
        if s >= whole:
            cost[s], free[s] = cost.get(s, 0.0) + cost_packing.cost_of(n, 16), free.get(s, 32) - n
    assert np.array_equal(got, lengths)


def test_no_documents(make_docs):
    none = make_docs([]).where("false")
    assert cost_packing.pack_balanced(none).count() == token_matrix.matrices(none).count() == 0


def test_vocabulary_merges_are_ranked():
    with open(tokens.default_path()) as f:
        assert len(json.load(f)["model"]["vocab"]) >= 50256
    assert tokens.Encoder.of(tokens.default_path()).ranked


def test_workers_hand_back_arrow_memory(monkeypatch):
    """A worker that waits for its next task holds no free memory of the last one."""
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    monkeypatch.setattr(T.pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])
    assert list(T.tidy(lambda rows: rows)(iter([batch]))) == [batch] and len(released) == 1
    assert T.tidy_group(lambda table: table)(batch) is batch and len(released) == 2
    assert len(list(T.slices(iter([batch])))) == 1 and len(released) == 3


def test_the_library_is_loaded_when_needed():
    encoder = tokens.Encoder(tokens.default_path())
    encoder.encode(pa.array(["plain words"]))
    assert "whole" not in vars(encoder)
    encoder.encode(pa.array(["two  spaces"]))
    assert "whole" in vars(encoder)
