import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tsweave.llm import importance, kneser_ney, language, licences, quantiles, text as T, tiling, trusted, url_model


def base_counts(text):
    """The base counts from their definition, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts_and_verdict(spark, small, odd_docs, labels):
    model = importance.ImportanceFilter.fit(small("documents"), small("labels"))
    for docs in (small("documents"), odd_docs):
        texts = docs.select("doc_id", "text").collect()
        rows = model.apply(docs.select("doc_id", "text", F.lit("x").alias("n_words"))).collect()
        assert sorted(map(str, ([d.doc_id, *base_counts(d.text)] for d in texts))) == sorted(map(str, ([r.doc_id, *(r[c] for c in importance.COUNTS)] for r in rows)))
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.score >= model.threshold)


def test_importance_against_brute_force(spark, make_docs):
    good, bad = [(i, prose(i, 40)) for i in range(30)], [(100 + i, "spam " * 30 + prose(i, 5)) for i in range(10)]
    docs = make_docs(good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = importance.ImportanceFilter.fit(docs, labels, buckets=64)

    def grams(text):
        raw, at = T.laid_out(pa.array([text]))
        return importance.buckets_of(raw, at, 64)[0].tolist()

    raw, target = Counter(), Counter()
    for i, t in good + bad:
        raw.update(grams(t))
        if i < 20:
            target.update(grams(t))
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
    for r in model.apply(docs.select("doc_id", "text")).collect():
        keys = grams(dict(good + bad)[r.doc_id])
        assert r.score == pytest.approx(sum(map(ratio, keys)) / len(keys))


def test_without_trusted_documents(spark, odd_docs, labels):
    none = labels.where("false")
    model = importance.ImportanceFilter.fit(odd_docs, none)
    assert {(r.base_failed, r.kept) for r in model.apply(odd_docs.select("doc_id", "text")).collect()} <= {(True, False), (False, True)}
    assert importance.ImportanceFilter.fit(odd_docs.where("false"), labels).apply(odd_docs.select("text")).count() == 10
    classifier = kneser_ney.PerplexityFilter.fit(odd_docs, none)
    assert {r.doc_id for r in classifier.classify(odd_docs).where("NOT kept").collect()} == {2, 3}


def test_kneser_ney_is_a_distribution(spark, small):
    model = kneser_ney.PerplexityFilter.fit(small("documents"), small("labels"))
    for table in model.tables.values():
        shares = np.exp(table.astype(float)).reshape(-1, kneser_ney.CLASSES)
        assert np.allclose(shares.sum(1), 1, atol=1e-4)


def test_kneser_ney_against_brute_force(spark):
    counts = Counter()
    for text in ("abab abc", "abca cab"):
        key, _ = kneser_ney._grams(*T.laid_out(pa.array([text])))
        counts.update(key.tolist())
    rows = spark.createDataFrame([("en", g, n) for g, n in counts.items()], "language string, gram long, n long")
    table = np.exp(kneser_ney._tables(rows)["en"].astype(float))
    levels = {4: counts}
    for k in (3, 2, 1):
        levels[k] = Counter(g & (1 << 5 * k) - 1 for g in levels[k + 1])

    def discount(k, n):
        of = Counter(levels[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0
        i = min(n, 3)
        value = i - (i + 1) * y * of[i + 1] / of[i] if of[1] and of[i] else 0
        return min(value, i) if value > 0 else i / 2

    def p(k, g):
        if not k:
            return 1 / 32
        after = {x: n for x, n in levels[k].items() if x >> 5 == g >> 5}
        total, lower = sum(after.values()), p(k - 1, g & (1 << 5 * (k - 1)) - 1)
        if not total:
            return lower
        n = after.get(g, 0)
        return ((n - discount(k, n) if n else 0) + sum(discount(k, x) for x in after.values()) * lower) / total

    for g in [*counts, 0, 12345]:
        assert table[g] == pytest.approx(p(4, g), rel=1e-4)


def test_perplexity_of_odd_texts(spark, small, odd_docs):
    model = kneser_ney.PerplexityFilter.fit(small("documents"), small("labels"))
    rows = model.classify(odd_docs).collect()
    assert len(rows) == 10 and all((r.perplexity is None) == (r.n_chars_scored == 0) for r in rows)
    assert all(not r.kept for r in rows if r.perplexity is None)


def _perplexity(training, text):
    """Perplexity by recursion over whole characters, with the classes' probabilities from their own brute-force counts."""
    pad = lambda t: "\0" * 4 + t
    levels = {5: Counter(pad(t)[i : i + 5] for t in training for i in range(len(t)))}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    keys = Counter(k for t in training for k in kneser_ney._grams(*T.laid_out(pa.array([t])))[0].tolist())
    classes = {4: keys}
    for k in (3, 2, 1):
        classes[k] = Counter(g & (1 << 5 * k) - 1 for g in classes[k + 1])

    def discount(level, n):
        of = Counter(level.values())
        i = min(n, 3)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        value = i - (i + 1) * y * of[i + 1] / of[i] if of[1] and of[i] else 0
        return min(value, i) if value > 0 else i / 2

    def share(level, own, after, lower):
        total = sum(after)
        if not total:
            return lower
        n = level.get(own, 0)
        return ((n - discount(level, n) if n else 0) + sum(discount(level, x) for x in after) * lower) / total

    def of_class(k, g):
        if not k:
            return 1 / 32
        return share(classes[k], g, [n for x, n in classes[k].items() if x >> 5 == g >> 5], of_class(k - 1, g & (1 << 5 * (k - 1)) - 1))

    def p(gram, base):
        if not gram:
            return base
        level = levels[len(gram)]
        return share(level, gram, [n for x, n in level.items() if x[:-1] == gram[:-1]], p(gram[1:], base))

    total = 0
    for i, g in enumerate(kneser_ney._grams(*T.laid_out(pa.array([text])))[0].tolist()):
        base = of_class(4, g) / (1 - of_class(4, g & ~31)) / int(kneser_ney._SIZE[g & 31])
        total += math.log(p(pad(text)[i : i + 5], base))
    return math.exp(-total / len(text))


def test_whole_characters_against_brute_force(spark, make_docs, monkeypatch):
    """Counts of all blocks and shards meet; unseen characters and contexts back off; null ids and repeated rows are kept."""
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 60)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 200)
    training = ["мама мыла раму", "мама мыла Милу", "abab abc \U0001F600", "", "语言 语言模型"]
    asked = ["мама раму мыла", "ямам алым умар", "语模言", "ab\U0001F601ж", "q"]
    docs = make_docs([*enumerate(training), *((10 + k, t) for k, t in enumerate(asked)), (None, asked[0]), (10, asked[0]), (30, None)]).repartition(3)
    labels = spark.range(5).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    for column in (docs, kneser_ney.stored(docs)):
        rows = kneser_ney.PerplexityFilter.fit(column, labels).classify(column).collect()
        assert len(rows) == 13 and sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, 0, 1, 2, 3, 4, 10, 10, 11, 12, 13, 14, 30]
        found = {r.doc_id: r for r in rows}
        for k, text in [*enumerate(training), *((10 + k, t) for k, t in enumerate(asked)), (None, asked[0])]:
            if text:
                assert found[k].n_chars_scored == len(text) and found[k].perplexity == pytest.approx(_perplexity(training, text), rel=1e-4)
        assert found[3].perplexity is None and not found[3].kept and not found[30].kept
        # All of these letters were one class before, and both texts the same to it.
        assert found[11].perplexity > 2 * found[10].perplexity


def test_gibberish_of_another_script_is_rejected(spark, make_docs):
    """All letters here are one class: only whole characters tell words from the same letters turned round."""
    other = str.maketrans({chr(97 + k): chr(0x430 + k) for k in range(26)})
    words = [prose(k, 60).translate(other) for k in range(80)]
    turned = [" ".join(w[::-1] for w in t.split()) for t in words[60:]]
    docs = make_docs([(k, t, "ru") for k, t in enumerate(words + turned)])
    labels = spark.range(60).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    kept = {r.doc_id for r in kneser_ney.PerplexityFilter.fit(docs, labels).classify(docs).where("kept").collect()}
    assert not kept & set(range(80, 100)) and len(kept & set(range(60, 80))) >= 18


def test_lists_of_ngrams_are_whole_and_short(spark, make_docs, monkeypatch):
    """Packed lists hold every n-gram and class with its count; a context lies in one shard, and its rest is sent back once."""
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 60)
    said = ["мама мыла раму", "abab abc \U0001F600\U0010FFFF", "", "语言 语言模型", "abca\0cab abab", None]
    texts = kneser_ney.stored(make_docs(list(enumerate(said))).repartition(3))
    named = kneser_ney._places(texts).select("block", "place", F.lit("xx").alias("model"))
    rows = kneser_ney._lists(texts, named, 5, True).collect()
    assert len({r.block for r in rows}) > 1
    found, shards, classes = Counter(), {}, Counter()
    for r in rows:
        a, b = kneser_ney._unpacked(r.grams)
        n = kneser_ney._unpack(r.n, "<u4")
        for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
            if x == kneser_ney.OF_CLASSES:
                classes[y] += k
            else:
                gram = [x >> 21, x & 0x1FFFFF, y >> 42, y >> 21 & 0x1FFFFF, y & 0x1FFFFF]
                found["".join("^" if c == 0 else chr(c - 1) for c in gram)] += k
                shards.setdefault((x, y >> 21), set()).add(r.shard)
    assert found == Counter(("^^^^" + t)[i : i + 5] for t in said if t for i in range(len(t)))
    assert classes == Counter(k for t in said if t for k in kneser_ney._grams(*T.laid_out(pa.array([t])))[0].tolist())
    assert all(len(x) == 1 for x in shards.values()) and len({r.shard for r in rows}) > 1
    sums = {(r.a, r.b): r.n for r in kneser_ney._sums(spark.createDataFrame(rows, "block long, model string, shard long, grams binary, n binary")).collect()}
    assert sum(sums.values()) == 2 * sum(found.values()) and len(sums) == len(found) + len(classes)

    a, b, _ = kneser_ney._distinct(*T.laid_out(pa.array([prose(1, 4000)])))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    contexts = len({(x, y >> 21) for x, y in zip(a.tolist(), b.tolist())})
    asked = pa.Table.from_pylist([{"shard": 0, "block": 7, "model": "xx", "grams": kneser_ney._packed(a, b)}])
    known = pa.table({"language": ["xx"] * len(a), "a": a, "b": b, "own": np.full(len(a), 0.5, np.float32), "rest": np.full(len(a), 0.25, np.float32)})
    answer = kneser_ney._answer(asked, known).to_pylist()[0]
    assert len(kneser_ney._unpack(answer["own"], "<f4")) == len(a) > 2 * contexts
    assert len(kneser_ney._unpack(answer["rest"], "<f4")) == contexts
    assert len(asked.column("grams")[0].as_py()) < 1.5 * len(a)


def test_bounds_are_quantiles(spark, small):
    docs, labels = small("documents"), small("labels")
    model = kneser_ney.PerplexityFilter.fit(docs, labels)
    rows = model.classify(docs).collect()
    trusted_rows = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    for name, (low, high) in model.bounds.items():
        values = [r.perplexity for r in rows if r.doc_id in trusted_rows and r.model == name and r.perplexity is not None]
        if name != kneser_ney.ANY:
            assert low == pytest.approx(np.quantile(values, 0.001, method="lower") / 1.03) and high == pytest.approx(np.quantile(values, 0.999, method="higher") * 1.03)
    for r in rows:
        stray = math.exp(1.5 / math.sqrt(max(1, r.n_chars_scored)))
        low, high = model.bounds[r.model]
        assert r.kept == (r.perplexity is not None and low / stray <= r.perplexity <= high * stray)


def test_one_pass_gives_the_same(spark, small, monkeypatch):
    """Scoring all documents once, and what is done where some have no language of their own, against fit and classify."""
    docs, labels = small("documents"), small("labels")
    rows = lambda df: sorted((r.doc_id, r.model, r.kept, round(r.perplexity or 0, 6), round(r.low, 6), round(r.high, 6)) for r in df.collect())
    known = docs.withColumn("lang", F.lit("en"))
    plain = rows(kneser_ney.PerplexityFilter.fit(known, labels).classify(known))
    full = kneser_ney.PerplexityFilter.fit
    monkeypatch.setattr(kneser_ney.PerplexityFilter, "fit", None)
    assert rows(kneser_ney.filtered(known, labels)) == plain
    monkeypatch.setattr(kneser_ney.PerplexityFilter, "fit", full)
    some = known.withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang")))
    got = kneser_ney.filtered(some, labels)
    assert got.count() == known.count() and got.where("model = '*'").count() == known.where("doc_id % 9 = 0").count()


def test_quality_labels_are_met(spark, small):
    got = kneser_ney.PerplexityFilter.fit(small("documents"), small("labels")).classify(small("documents"))
    good = got.join(small("labels").where("quality = 1 AND toxic = 0"), "doc_id")
    assert good.where("kept").count() >= 0.97 * good.count()


def test_tiles_catch_reordered_passages(spark, make_docs):
    item = prose(77, 40)
    words = item.split()
    moved = " ".join([*words[20:], "between", *words[:20]])
    docs = make_docs([(1, prose(1, 300)), (2, prose(2, 50) + " " + item.upper() + " " + prose(3, 50)), (3, prose(4, 20) + " " + moved), (4, None), (5, ""), (2, None),
                      (6, " ".join(words[:4])), (None, item), (7, " ".join(words[:19]))])
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short one"), (13, prose(99, 30)), (10, item)], "item_id long, text string")
    rows = tiling.overlaps(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.n_tiles) for r in rows) == [(0, 10, 1), (2, 10, 1), (3, 10, 2)]
    assert tiling.overlaps(docs, bench.where("false")).count() == tiling.overlaps(docs.where("false"), bench).count() == 0
    tight = {(r.doc_id, r.item_id, r.matched_words) for r in tiling.overlaps(docs, bench, bits=64).collect()}
    assert tight == {(r.doc_id, r.item_id, r.matched_words) for r in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=20))
def test_tiling_against_brute_force(item, text):
    found = tiling.tiles(item, text, 3)
    used_item, used_text = [False] * len(item), [False] * len(text)
    for i, j, n in found:
        assert item[i : i + n] == text[j : j + n] and not any(used_item[i : i + n]) and not any(used_text[j : j + n])
        used_item[i : i + n] = used_text[j : j + n] = [True] * n
    for i in range(len(item) - 2):  # nothing of three words is left over
        for j in range(len(text) - 2):
            assert item[i : i + 3] != text[j : j + 3] or any(used_item[i : i + 3]) or any(used_text[j : j + 3])


def _longest_first(item, text, least):
    """Plain tiling: of all unmarked common runs the longest is marked, ties by place, until none is left."""
    used_item, used_text, found = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_item[i + n] and not used_text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return found
        used_item[i : i + n] = used_text[j : j + n] = [True] * n
        found.append((i, j, n))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=30), st.lists(st.integers(1, 3), max_size=40))
def test_tiling_is_longest_first(item, text):
    assert tiling.tiles(item, text, 3) == _longest_first(item, text, 3)


def test_seed_bound_loses_no_pair(spark, make_docs):
    words = prose(5, 30).split()
    fives = [w for k in range(0, 20, 5) for w in [*words[k : k + 5], f"cut{k}"]]
    same = "again " * 12
    docs = make_docs([(1, " ".join(fives[:18])), (2, " ".join(fives[:12])), (3, same[:36]), (4, "again again again again again")])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, same)], "item_id long, text string").withColumn("words", F.lit("x")).withColumn("seeds", F.lit(0))
    rows = tiling.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words) for r in rows) == [(1, 1, 15), (3, 2, 6)]


def test_url_rules(spark):
    urls = [None, "", "a.b/c", "http://A.NET", "http://A.NET/", "http://x.example.net/en/1", "http://q.net?x", "http://notnet/", "http://org/fr/x",
            "https://m.example.com/de/9#t", "https://m.example.com/dex", "http://a.net:80/", "x://y://org/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in url_model.judge(pages.unionByName(pages)).collect()}

    def plain(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    for i, u in enumerate(urls):
        host, path = plain(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule[0])
        assert rows[i].verdict == rule[1] if fits else rows[i].verdict in ("allow", "block")
    assert rows[0].verdict == rows[1].verdict == "allow"
    assert url_model.judge(pages.where("false")).count() == 0


def test_url_models_learn(spark, small):
    urls = [f"http://{w}{i}.{'good' if i % 2 else 'bad'}-site.xx/{i}" for i in range(300) for w in ("a", "b")]
    rules = [("allow", f"{w}{i}.good-site.xx", "/") for i in range(1, 200, 2) for w in "ab"] + [("block", f"{w}{i}.bad-site.xx", "/") for i in range(0, 200, 2) for w in "ab"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_model.judge(pages, rules[:120] + rules[-120:]).where("rule IS NULL").collect()
    assert np.mean([(r.verdict == "allow") == ("good" in r.host) for r in rows]) > 0.95


def test_witten_bell_sums_to_one():
    counts = np.zeros(url_model.CLASSES**url_model.ORDER)
    counts[np.random.default_rng(1).integers(0, len(counts), 500)] += 1
    assert np.allclose(np.exp(url_model._log_probability(counts)).reshape(-1, url_model.CLASSES).sum(1), 1)


def test_languages_are_found(spark, small, odd_docs):
    docs = small("documents")
    rows = language.document_languages(docs, small("pages")).join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.where("language = lang").count() >= 0.98 * docs.count()
    # Wrong declarations are overruled by the text.
    lied = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "en").otherwise(F.col("lang")))
    rows = language.document_languages(lied).join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.where("language = lang").count() >= 0.97 * docs.count()
    rows = language.document_languages(odd_docs).collect()
    assert len(rows) == 10 and all(not r.accepted for r in rows if r.doc_id in (2, 3, 4))
    assert language.document_languages(docs.where("false")).count() == 0
    nothing = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert language.document_languages(nothing).where("accepted").count() == 0


def test_evidence_columns(spark):
    url = F.lit("https://www.Site.example.de/fr/12?x")
    row = spark.range(1).select(language.address_code(url), language.host_of(url), language.site_of(F.lit("a.b.c")), language.code_of(F.lit("EN-us")),
                                language.markup_code(F.lit("<html class=a lang='pt-BR'>")), language.address_code(F.lit("http://x.de/long/"))).first()
    assert tuple(row) == ("fr", "www.site.example.de", "b.c", "en", "pt", "de")


@pytest.fixture(scope="module")
def scanner(small):
    return licences.LicenceScanner.fit(small("documents"))


def test_licences(spark, scanner, make_docs, small):
    rows = [(1, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 50)), (2, prose(3, 200)), (3, None), (4, ""),
            (5, prose(4, 80) + " Licensed under the Apache License, Version 2.0. " + prose(5, 80)), (None, licences.TEMPLATES["gpl"][1]), (6, "license to drive a car in the city")]
    found = {(r.doc_id, r.family, r.paragraph) for r in scanner.scan(make_docs(rows)).where("confirmed").collect()}
    assert found == {(1, "mit", 1), (5, "apache", 0), (None, "gpl", 0)}
    docs = small("documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    true = lines.where("line rlike '^(Released under the MIT License|Licensed under (CC BY-NC|the Apache License)|This work is licensed under the GNU)'")
    got = scanner.scan(docs).where("confirmed")
    assert true.join(got, ["doc_id", "paragraph"], "left_anti").count() == got.join(true, ["doc_id", "paragraph"], "left_anti").count() == 0


def test_licences_finds_every_notice(scanner, make_docs):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"{mit} {apache}"), (2, " ".join([prose(1, 100), apache, prose(2, 150), apache, prose(3, 90)])),
            (3, f"{mit} {prose(6, 12)} {mit}"), (4, licences.TEMPLATES["agpl"][1])]
    got = scanner.scan(make_docs(rows)).where("confirmed").collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(1, "apache"), (1, "mit"), (2, "apache"), (2, "apache"), (3, "mit"), (3, "mit"), (4, "agpl")]
    assert sorted(r.first_word for r in got if r.doc_id == 2) == [100, 258]  # eight words without marks


def test_all_trusted_labels_count(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30_000, "good").otherwise("raw").alias("text"))
    rows = trusted.trusted_documents(docs, labels)
    assert sorted(r.doc_id for r in rows.collect()) == list(range(30_000))
    assert importance.bucket_counts(rows, 64).sum() == 30_000 and importance.bucket_counts(docs, 64).sum() == 40_000
    bound = kneser_ney.PerplexityFilter.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 60, "fi").otherwise("en")), labels).bounds
    assert set(bound) == {"*", "en", "fi"}  # 60 trusted documents are enough, whatever the others' number


@pytest.mark.parametrize("threshold", ["-1", "100m"])
def test_trusted_documents_are_exact(spark, odd_docs, labels, threshold, monkeypatch):
    """Whatever Spark would broadcast, and however full the bitmap is."""
    from tsweave.llm import exact_dedup

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 15)
    many = labels.select("doc_id", "quality", "toxic").unionByName(spark.range(1000, 40_000, 2).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    docs = odd_docs.select("doc_id", "text").unionByName(spark.range(1000, 9000).selectExpr("id AS doc_id", "'t' AS text"))
    try:
        got = trusted.trusted_documents(docs, many).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in got) == [1, 1, 1, *range(1000, 9000, 2)]


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0, 1e300, -1e300], 500), "c": [7.0], "d": np.exp(rng.normal(size=500) * 30)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("e", None), ("a", float("nan"))]
    found = quantiles.order_statistics(spark.createDataFrame(rows, "group string, value double"), [0.001, 0.3, 0.5, 0.999])
    assert set(found) == set(groups)
    for g, values in groups.items():
        kinds = ("lower", "lower", "lower", "higher")
        assert found[g] == (len(values), [np.quantile(values, q, method=k) for q, k in zip([0.001, 0.3, 0.5, 0.999], kinds)])


def test_all_pages_of_a_document_count(spark):
    page = lambda url, lang: (url, f"<html lang='{lang}'>" if lang else "<html>")
    rows = [page("http://a.org/x/1", None), page("http://b.net/fr/1", "fr"), page("http://b.net/fr/1.html", "fr"), page("http://c.com/de/1?q", "de"),
            page("http://z.com/2", "de"), page("http://y.com/2", "en"), page("http://x.com/none", "it"), (None, None), ("http://q.com/3", None)]
    pages = spark.createDataFrame([(k, u, h, 0, "v") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, n int, value string")
    got = {r.doc_id: tuple(r)[1:] for r in language.page_evidence(pages).collect()}
    assert got == {1: ("fr", "fr", "b.net"), 2: ("de", None, "y.com"), 3: (None, None, "q.com")}


def test_classes_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_CLASSES", 2)
    docs = spark.createDataFrame([("abc def", c) for c in ("aa", "bb", "bb", "cc", "cc", "dd", None)], "text string, lang string")
    assert language.LanguageModel.fit(docs).languages == ["bb", "cc"]
