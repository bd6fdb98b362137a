import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tsweave.llm import jaccard, lm_score, text as T
from tsweave.llm.components import _forest, components
from tsweave.llm.trie import EliasFano, Trie


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    """Component of each row by comparing every pair of sets."""
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=str)


def edited(seed, size, places):
    words = prose(seed, size).split()
    for p in places:
        words[p % size] = f"edit{p}"
    return " ".join(words)


def near_copies():
    rows = [(i, edited(1, 120, [7 * k for k in range(i % 7)])) for i in range(40)]
    rows += [(100 + i, edited(2, 30, [i] if i % 3 else [])) for i in range(25)]
    rows += [(200 + i, edited(3, 400, [11 * k + i for k in range(i)])) for i in range(20)]
    rows += [(300 + i, " ".join(prose(4, 12).split()[: 3 + i % 10])) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "  "), (403, "one two"), (404, "One two"), (405, "two one"), (406, "a"), (None, prose(1, 120)), (7, prose(9, 50))]
    return rows


def test_jaccard_against_brute_force(make_docs):
    rows = near_copies()
    got = jaccard.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_jaccard_splits_large_regions(make_docs, monkeypatch):
    for name, value in {"REGION_SETS": 8, "PIVOTS": 3, "SMALL_CELL": 4, "SHARD_ENTRIES": 200, "HELD_ENTRIES": 100, "BUCKETS": 4, "DEPTH": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    got = jaccard.jaccard_components(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def sliding(n, step=25, width=600, seed=0):
    """Texts that are windows moving over a long one: each linked to its neighbours only."""
    words = np.random.default_rng(seed).integers(0, 1 << 40, n * step + width)
    return [" ".join(f"w{w}" for w in words[i * step : i * step + width]) for i in range(n)]


def chain_pieces(n, seed):
    """Components that ``_Sets.join`` leaves of a chain whose sets come in random order."""
    shingle, first = jaccard.shingle_sets(*T.laid_out(pa.array(sliding(n, seed=seed))), 3)
    order = np.random.default_rng(seed + 100).permutation(n)
    here = jaccard._Sets(jaccard.Rule(), np.arange(n), [shingle[first[i] : first[i + 1]] for i in order])
    here.join(np.arange(n), np.zeros(0, np.int64))
    return len({here.root(i) for i in range(n)})


def test_jaccard_keeps_links_between_closed_sets_of_two_cells():
    assert [chain_pieces(600, seed) for seed in range(2)] == [1] * 2


def test_jaccard_keeps_chains_over_split_regions(make_docs, monkeypatch):
    for name, value in {"REGION_SETS": 40, "PIVOTS": 6, "SMALL_CELL": 8}.items():
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.jaccard_components(make_docs(list(enumerate(sliding(300))))).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_common_shingles_are_looked_up_in_bounded_pieces(monkeypatch):
    shingle, first = jaccard.shingle_sets(*T.laid_out(pa.array(sliding(60))), 3)
    here = jaccard._Sets(jaccard.Rule(), np.arange(60), [shingle[first[i] : first[i + 1]] for i in range(60)])
    most, found = [], np.searchsorted
    monkeypatch.setattr(jaccard, "LOOKED_UP", 2_000, raising=False)
    monkeypatch.setattr(jaccard.np, "searchsorted", lambda a, v, *x: most.append(np.size(v)) or found(a, v, *x))
    got = here.common(7, np.arange(60))
    monkeypatch.undo()
    assert got.tolist() == [len(np.intersect1d(shingle[first[7] : first[8]], shingle[first[i] : first[i + 1]])) for i in range(60)]
    assert max(most) <= 2_000


def test_jaccard_bounds_arrow_batches(spark, make_docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, "67108864b")
    spark.conf.set(name, "67108864b")
    try:
        jaccard.jaccard_components(make_docs([(1, "one two three four")]))
        assert spark.conf.get(name) == "8m"
    finally:
        spark.conf.set(name, before)


def test_jaccard_of_nothing(make_docs):
    assert jaccard.jaccard_components(make_docs([]).where("false")).count() == 0
    assert jaccard.jaccard_components(make_docs([(1, None), (1, None)])).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 30), st.integers(-9, 30)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=60))
def test_thinned_edges_keep_components(edges):
    a, b = np.array(edges, np.int64).T
    least = {n: n for n in {*a.tolist(), *b.tolist()}}
    for _ in least:
        for x, y in edges:
            least[x] = least[y] = min(least[x], least[y])
    got = dict(zip(*(c.tolist() for c in _forest(a, b))))
    assert got == {n: c for n, c in least.items() if n != c}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 101), (7, 7), (60, 61), (61, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50, 60: 60, 61: 60}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    assert np.array_equal(EliasFano.of(values)[np.arange(len(values))], values)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1) | st.integers(0, 5), st.integers(0, 2**40 - 1) | st.integers(0, 5)), max_size=60), st.integers(0, 3))
def test_trie(tmp_path_factory, pairs, every):
    pairs = sorted(pairs)
    context, word = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    kept = np.arange(len(pairs)) % 4 >= every
    code = np.arange(1, len(pairs) + 1).astype(np.uint16)
    folder = str(tmp_path_factory.mktemp("trie"))
    Trie.of(context[kept], word[kept], code[kept]).save(folder)
    assert np.array_equal(Trie.open(folder).lookup(context, word), np.where(kept, code, 0))


@pytest.mark.parametrize("block, shard", [(1_500_000, 2_000_000), (3_000, 1_000)])
def test_scores_against_brute_force(odd_docs, small, block, shard):
    for docs in (odd_docs, small("documents")):
        texts = [(r.doc_id, [*lowered(r.text), None]) for r in docs.select("doc_id", "text").collect()]
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
        one, two = Counter(), Counter()
        for i, t in texts:
            if not held[i]:
                one.update(t)
                two.update(zip([None, *t[:-1]], t))
        n, v, k = sum(one.values()), len(one), lm_score.SMOOTHING
        single = lambda w: (one[w] + 1) / (n + v + 1)
        want = []
        for i, t in texts:
            base = sum(math.log10(single(w)) for w in t)
            score = sum(math.log10((two[a, w] + k * single(w)) / (one[a] + k)) for a, w in zip([None, *t[:-1]], t))
            want.append((str(i), held[i], len(t), sum(one[w] > 0 for w in t), n, base, score))
        got = lm_score.score_documents(docs, block_tokens=block, shard_tokens=shard).collect()
        for g, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.base_score)), sorted(want, key=lambda r: (r[0], r[5])), strict=True):
            assert (str(g.doc_id), *g[1:5]) == w[:5] and g.base_score == pytest.approx(w[5]) and abs(g.score - w[6]) < 2e-4 * w[2]


def test_held_out_texts_gain(small):
    got = lm_score.score_documents(small("documents")).where("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_scores_of_nothing(make_docs):
    assert lm_score.score_documents(make_docs([]).where("false")).count() == 0


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({c for _, _, c in brute_components(rows)}) == len(rows)
    kept = {i for i, _ in rows}
    assert kept == {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}


def test_pipeline_drops_near_copies_by_five_words(spark, make_docs, folder):
    """Copies with one edited word in about fifty: 0.8 or more of five-word shingles, under 0.9 of three-word ones."""
    rows = [(10 * i + k, edited(i + 1, 220, [25 + 53 * j + k for j in range(4)] if k else [])) for i in range(5) for k in range(2)]
    rows += [(100 + k, edited(50, 220, [5 + 25 * j for j in range(8)] if k else [])) for k in range(2)]  # too far apart
    assert len({c for _, _, c in brute_components(rows)}) == len(rows)
    kept = corpus_pipeline.jaccard_join(spark, make_docs(rows), folder).collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 20, 30, 40, 100, 101]


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90)])
@pytest.mark.parametrize("buckets", [1, 300, 1 << 20])
def test_linked_sets_meet_whatever_the_order(words, percent, buckets):
    """Pairs just alike enough, all with the shingles of a common passage, under any table of counts."""
    rng, rule = np.random.default_rng(3), jaccard.Rule(words, percent)
    passage = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    sets = []
    for size in (4, 5, 9, 10, 11, 20, 100, 150, 700):
        for _ in range(40):
            one = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            if size > 20:
                one[:12] = passage
            most = next(k for k in range(size, -1, -1) if not rule.linked(size - k, size, size) and k or rule.linked(size - k, size, size))
            gone = int(rng.integers(0, most + 1))
            new = next(k for k in range(size, -1, -1) if rule.linked(size - gone, size, size - gone + k) or k == 0)
            gone = gone if rule.linked(size - gone, size, size - gone + new) else 0
            other = np.concatenate([rng.permutation(one)[gone:], rng.integers(0, 1 << 63, new if gone else 0, dtype=np.uint64)])
            assert rule.linked(size - gone, size, len(other))
            sets += [np.sort(one), np.sort(other)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    shingle = np.concatenate(sets)
    table = np.zeros(1 << jaccard.TABLE_BITS, np.int64)
    place = jaccard._bucket(shingle)
    counts = np.bincount(place % buckets, minlength=buckets)
    table[place] = counts[place % buckets]
    sig, owner = jaccard.rarest(shingle, first, table, rule)
    size = np.diff(first)
    kind = jaccard.size_class(size)[owner]
    entries = jaccard._Entries(sig, owner.astype(np.uint64), kind, kind, np.zeros(len(sig), np.uint8))
    assert jaccard._Entries.of([entries[:100], entries[100:]]).sig.tolist() == entries.sig.tolist()
    sketch = jaccard.sketches(shingle, first).astype(int)
    # In one go, and by way of blocks whose large runs have become one.
    half = np.arange(len(entries.sig)) % 2 == 0
    parts = [jaccard._Entries.of([entries[half]]).met(rule.class_gap), jaccard._Entries.of([entries[~half]]).met(rule.class_gap)]
    both = jaccard._Entries.of([m[:] for m, _, _ in parts]).met(rule.class_gap)
    for sure, weak in ([entries.met(rule.class_gap)[1:], (np.concatenate([parts[0][1], parts[1][1], both[1]]), both[2])]):
        root = np.arange(len(sets))
        apart = np.abs(sketch[weak[:, 0].astype(int)] - sketch[weak[:, 1].astype(int)]).sum(1)
        fits = (100 + percent) * apart <= (100 - percent) * size[weak.astype(int)].sum(1)
        for a, b in np.concatenate([sure, weak[fits]]).astype(int).tolist():
            root[root == root[a]] = root[b]
        assert all(root[i] == root[i + 1] or np.array_equal(sets[i], sets[i + 1]) for i in range(0, len(sets), 2))


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80)])
def test_jaccard_with_a_common_line(make_docs, rule):
    """One line stands in every text: groups stay apart, and no link is lost."""
    line = prose(99, 14)
    rows = [(i, f"{edited(i // 6, 100, [13 * k for k in range(i % 6)])} {line}") for i in range(60)]
    sets = [jaccard.shingle_sets(*T.laid_out(pa.array([t])), rule.words)[0] for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    want = [(i, min(j for j in range(60) if root[j] == root[i])) for i in range(60)]
    got = jaccard.jaccard_components(make_docs(rows), rule).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == want and len({c for _, c in want}) >= 10


@pytest.mark.parametrize("size", [40, 700, 5_000, 20_000])
@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80)])
def test_sketches_tell_sets_of_any_size_apart(size, rule):
    """Sets without a common shingle are never taken for linked ones; sets just alike enough always are."""
    rng = np.random.default_rng(size)
    sets = [rng.integers(0, 1 << 63, size + k, dtype=np.uint64) for k in range(8)]
    gone = size * (100 - rule.percent) // 100
    sets += [x[gone:] for x in sets]
    shingle, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sketch = jaccard._sketched(shingle, first).to_pylist()
    fits = lambda i, j: (100 + rule.percent) * jaccard.sketch_distance([sketch[i]], [sketch[j]])[0] <= (100 - rule.percent) * (len(sets[i]) + len(sets[j]))
    assert [[fits(i, 8 + j) for j in range(8)] for i in range(8)] == np.eye(8, dtype=bool).tolist()


def blurred_corpus(alike):
    """Texts of random words, the first ``alike`` of which each have lines that some others have too."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{w}" for w in rng.integers(0, 1 << 40, n))
    lines = [word(14) for _ in range(alike // 4)]
    rows = [(i, "\n".join([word(100), *(lines[k] for k in rng.integers(0, len(lines), 3))])) for i in range(alike)]
    copies = [(alike + i, text + " end") for i, (_, text) in enumerate(rows[:40])]
    return rows + copies + [(10_000 + i, word(100)) for i in range(4_000)], dict((alike + i, i) for i in range(40))


def test_jaccard_cuts_wide_regions_by_their_own_counts(make_docs, monkeypatch):
    """In a table that the corpus blurs, common lines pass for rare; the regions that they make are not joined as they are."""
    for name, value in {"TABLE_BITS": 12, "TABLE_PIECE": 1 << 12, "AGAIN_SETS": 20}.items():
        monkeypatch.setattr(jaccard, name, value, raising=False)
    sizes, joined = [], jaccard._joined_here
    monkeypatch.setattr(jaccard, "_joined_here", lambda regions, rule: sizes.append(regions.groupBy("region").count().agg(F.max("count")).first()[0] or 0) or joined(regions, rule))
    rows, copy_of = blurred_corpus(300)
    got = jaccard.jaccard_components(make_docs(rows), jaccard.Rule(5, 80)).select("doc_id", "component_id").collect()
    assert dict(map(tuple, got)) == {i: copy_of.get(i, i) for i, _ in rows}
    assert max(sizes) <= 20


def test_jaccard_does_not_lend_sets_to_many_cells(make_docs, monkeypatch):
    """Texts of one template, all as far from each other: pivots cannot tell them apart."""
    for name, value in {"REGION_SETS": 40, "CHUNK_SETS": 40}.items():
        monkeypatch.setattr(jaccard, name, value, raising=False)
    cells, write = [], jaccard.materialise

    def watched(df, name):
        out = write(df, name)
        cells.append(out.count() if name == "cells" else 0)
        return out

    monkeypatch.setattr(jaccard, "materialise", watched)
    pool = [prose(100 + k, 8) for k in range(12)]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([prose(99, 60), *(pool[k] for k in sorted(rng.permutation(12)[:6]))])) for i in range(200)]
    sets = [jaccard.shingle_sets(*T.laid_out(pa.array([t])), 3)[0] for _, t in rows]
    root = list(range(200))
    for i in range(200):
        for j in range(i):
            if jaccard.Rule().linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    got = jaccard.jaccard_components(make_docs(rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, min(j for j in range(200) if root[j] == root[i])) for i in range(200)]
    assert sum(cells) <= 3 * 200


def test_pipeline_of_odd_rows(spark, odd_docs, folder):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == odd_docs.columns
        docs.count()
    once = corpus_pipeline.jaccard_join(spark, odd_docs, folder)
    # Equal rows are one document; texts without words all stay.
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "1", "2", "3", "4", "5", "6", "7"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0
    assert [s(spark, odd_docs.where("false"), folder).count() for _, s in corpus_pipeline.STAGES[:-1]] == [0, 0, 0, 0]
