"""Operators 11 to 13: periodic runs, lexical search, exact duplicates."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tsweave.llm import exact_dedup, lexical, runs


def brute_runs(w):
    """All runs from the definition, period by period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                smaller = any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (text, kept)))


def run_rows(docs):
    return sorted((tuple(r)[:8] for r in runs.document_runs(docs).collect()), key=str)


def periodic(seed, period, length, before=5, after=7):
    unit = prose(seed, period).split()
    return " ".join(prose(seed + 1, before).split() + [unit[i % period] for i in range(length)] + prose(seed + 2, after).split())


def test_runs_against_brute_force(make_docs, odd_docs):
    texts = [periodic(3 * k, p, n) for k, (p, n) in enumerate([(1, 23), (1, 24), (2, 24), (8, 24), (8, 23), (9, 27), (9, 26), (40, 120), (40, 121), (40, 119), (13, 200)])]
    texts += [" ".join([periodic(1, 4, 30), periodic(1, 4, 30), periodic(5, 11, 50)]), "a " * 200 + "b " * 100 + "a " * 200, "a b a a b " * 40, prose(4, 300)]
    rows = [(i, t) for i, t in enumerate(texts * 12)]
    for docs in (make_docs(rows), odd_docs):
        want = sorted((brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text is None or len(r.text) < 50_000), key=str)
        got = [r for r in run_rows(docs) if r[0] != 5 or len(rows) > 12 and docs is not odd_docs]
        assert got == want


def test_runs_of_a_long_text(make_docs):
    # 5 keeps its text: its CRC does not end in 0.
    assert zlib.crc32(b"5") % 10
    (row,) = runs.document_runs(make_docs([(5, "x " * 60_000 + periodic(2, 5000, 30_000))])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 1), (60_005, 30_000, 5000)]
    assert (row.start, row.length, row.period) == (0, 60_000, 1)


def test_runs_of_an_empty_table(make_docs):
    assert runs.document_runs(make_docs([(1, "a")]).where("doc_id > 1")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=12), st.integers(2, 30), st.lists(st.integers(0, 2), max_size=60), st.booleans())
def test_runs_of_small_alphabets(unit, times, rest, front):
    w = rest + unit * times + rest if front else unit * times + rest + unit * (times // 2)
    words = np.array(w, np.uint64)
    found = []
    for b, e in zip(*runs.stretches(words, np.array([0, len(words)]))):
        found += [(int(b) + s, n, p) for s, n, p in runs.runs_of(words[b:e])]
    assert sorted(found, key=lambda r: (r[0], r[2])) == brute_runs(w)


def brute_search(docs, items, top=10):
    """Every item scored against every document."""

    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for d, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in query if t in b)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "item_id long, text string, doc_id int, score int")


@pytest.mark.parametrize("block", [3, 16_384])
def test_search_against_brute_force(make_docs, make_items, odd_docs, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", block)
    rows = [(i, prose(i % 37, 5 + i % 90)) for i in range(300)] + [(1000 + i, "Same words, same score!") for i in range(30)]
    rows += [(None, "same words"), (None, "same"), (7, None), (8, ""), (9, "... --- ..."), (2000, "ÉCOLE école École x"), (2001, prose(1, 20_000))]
    items = [(k, prose(k, 4 + 9 * k)) for k in range(12)] + [(20, "same"), (21, None), (22, ""), (23, "nowhere"), (24, "école x"), (3, "same words"), (3, "same words"), (None, "SCORE")]
    items += [(30, " ".join(prose(s, 40) for s in range(5)))]
    got = lexical.search(make_docs(rows), make_items(items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, items)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = lexical.search(odd_docs, make_items(items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(odd, items)


def test_search_in_batches(make_docs, make_items, monkeypatch):
    rows, items = [(i, prose(i, 40)) for i in range(40)], [(k % 9, prose(k, 6)) for k in range(18)]
    monkeypatch.setattr(lexical.batches, "__defaults__", (60,))
    assert len(list(lexical.batches(make_items(items)))) > 3
    assert sorted((tuple(r) for r in lexical.search(make_docs(rows), make_items(items)).collect()), key=str) == brute_search(rows, items)


def test_search_of_empty_tables(make_docs, make_items):
    docs, items = make_docs([(1, "a b")]), make_items([(1, "a")])
    for d, i in ((docs.where("doc_id > 1"), items), (docs, items.where("item_id > 1")), (make_docs([(1, None)]), items)):
        assert lexical.search(d, i).collect() == []


def test_masks_stop_early(monkeypatch):
    """Groups whose bound is below the last of the best are not scored."""
    seen = []
    place = np.arange(1000)
    adds = np.where(place < 20, 50, 1)
    postings = {0: (place[:20], adds[:20], 50), 1: (place, np.ones(1000, np.int64), 1)}
    plain = lexical.scores
    monkeypatch.setattr(lexical, "scores", lambda rows, *a: (seen.append(len(rows)), plain(rows, *a))[1])
    best = lexical.best_of_block(np.array([0, 1]), postings, place, 1000, 10)
    assert best == [(k, 51) for k in range(10)]
    # Of 1000 documents only those of the mask of both terms.
    assert seen == [20]


def brute_groups(rows):
    groups = defaultdict(list)
    normal = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    for (d, _), t in zip(rows, normal):
        groups[t].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, normal)), key=str)


@pytest.mark.parametrize("capacity, bits", [(4096, 64), (4, 64), (1, 6), (4, 3)])
def test_exact_duplicates_against_brute_force(make_docs, odd_docs, capacity, bits):
    rows = [(i, prose(i % 60, 30)) for i in range(150)] + [(500 + i, "Hot TEXT" if i % 2 else "hot text") for i in range(200)]
    rows += [(1, None), (2, ""), (3, "É"), (4, "é"), (None, "hot text"), (None, "alone"), (None, "twins"), (None, "twins"), (900, "same row"), (900, "same row"), (5, prose(1, 30_000)), (6, prose(1, 30_000).upper())]
    for docs in (make_docs(rows), odd_docs):
        plain = [(r.doc_id, r.text) for r in docs.collect()]
        got = exact_dedup.exact_duplicates(docs, capacity, bits).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_groups(plain)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_directory_doubles(spark):
    keys = spark.range(0, 4000).select(F.xxhash64("id").alias("key"))
    slots = exact_dedup.directory(keys, 4000, 64).collect()
    depth = slots[0].depth
    assert sorted(s.slot for s in slots) == list(range(1 << depth))
    held = Counter((k.key & (1 << 64) - 1) >> (64 - depth) for k in keys.collect())
    buckets = defaultdict(int)
    for s in slots:
        assert s.slot >> (depth - s.bucket_depth) == s.bucket
        buckets[s.bucket_depth, s.bucket] += held[s.slot]
    assert max(buckets.values()) <= 64 and sum(buckets.values()) == 4000
    assert len({d for d, _ in buckets}) > 1


def test_chains_of_colliding_keys(make_docs):
    index = exact_dedup.ExtendibleIndex.build(make_docs([(i, f"text {i % 20}") for i in range(60)]), key_bits=2)
    chains = index.chains.collect()
    assert len(chains) == 20 and len({(c.key, c.chain) for c in chains}) == 20 and max(c.chain for c in chains) > 2
    assert all(c.group_size == 3 for c in chains)


def test_exact_duplicates_of_an_empty_table(make_docs):
    assert exact_dedup.exact_duplicates(make_docs([(1, "a")]).where("doc_id > 1")).collect() == []
