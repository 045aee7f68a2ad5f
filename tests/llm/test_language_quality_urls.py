import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, language_id, quality, url_filter

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and the river", "de": "der schnelle braune fuchs springt über den faulen hund und den fluss", "fr": "le renard brun rapide saute par dessus le chien paresseux et la rivière"}


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(list(TEXTS))
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(12)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.is_held_out(F.col("doc_id")))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect())
    found = language_id.predict(docs, language_id.learn(docs.where("not held_out"))).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(spark, docs, no_docs):
    protos = language_id.learn(docs)
    got = language_id.predict(docs, protos)
    assert got.count() == docs.count()
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.predict(no_docs, protos).collect() == []
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(no_docs)).collect()} == {"und"}


def test_language_gram_counts_do_not_depend_on_the_batch():
    texts = ["Hello  world", "", "a", "Ünder-way 12 x", "中文字", "ab\x00cd"]
    together, _ = language_id.encode(texts)
    alone = np.concatenate([language_id.encode([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def brute_vector(text, dims=language_id.DIMENSIONS):
    """Letter by letter: neighbours and itself, bound and bundled."""
    text, out = text.lower(), np.zeros(dims)
    units = []
    for c in text:
        if c.isalpha():
            units.append(c)
        elif units and units[-1]:
            units.append("")
    units = ["", *units, ""]
    vector = lambda c: language_id.letter_vector(ord(c) if c else 0, dims).astype(float)
    for k in range(1, len(units) - 1):
        if units[k]:
            out += np.roll(vector(units[k - 1]), 2) * np.roll(vector(units[k]), 1) * vector(units[k + 1])
    return out / (np.linalg.norm(out) or 1)


def test_language_matches_brute_force(docs, rows):
    """Prototypes, predictions and scores of the whole table, letter by letter."""
    some = [r for r in rows if r[0] != 5000]
    held_out = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    langs = lambda i: "ab"[(i or 0) % 2]
    table = docs.where("doc_id is null or doc_id <> 5000").select("doc_id", "text", F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, "a").otherwise("b").alias("lang"), language_id.is_held_out(F.col("doc_id")).alias("held_out"))
    protos = language_id.learn(table.where("not held_out").select("text", "lang"))
    sums = {}
    for i, t in some:
        if not held_out(i):
            sums[langs(i)] = sums.get(langs(i), 0) + brute_vector(t or "")
    want_protos = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    assert list(protos) == sorted(want_protos) and all(np.allclose(protos[k], v, atol=1e-4) for k, v in want_protos.items())
    got = sorted(((r.doc_id, r.held_out, r.score) for r in language_id.predict(table, protos).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = sorted(((i, held_out(i), max(0.0, *(float(v @ brute_vector(t or "")) for v in want_protos.values()))) for i, t in some), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_language_of_cut_and_long_texts(monkeypatch):
    """Cut anywhere, a text has the vector it has whole; many scripts need little memory."""
    texts = ["".join(random.Random(k).choices("abc é中ß\u0130 .\n", k=900)) for k in range(4)]
    whole, has = language_id.encode(texts)
    monkeypatch.setattr(language_id, "PIECE", 50)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    cut, has_too = language_id.encode(texts)
    assert np.allclose(whole, cut, atol=1e-5) and has.tolist() == has_too.tolist() == [True] * 4
    assert np.allclose(whole[0], brute_vector(texts[0]), atol=1e-4)


def test_language_of_many_han_letters_in_bounded_memory():
    import tracemalloc

    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(350_000))
    language_id.encode(["warm up"])
    tracemalloc.start()
    language_id.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit, seen, dup = [False] * len(words), set(), 0
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            hit[k : k + 5] = [True] * 5
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(hit)


def test_quality_base_columns(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.judge(docs, model).collect()
    want = []
    for i, t in rows:
        n, chars, symbols, dup, repeat = brute_statistics(t)
        want.append((i, n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judge(no_docs, model).collect() == []
    keep_all = quality.learn(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.judge(docs, keep_all).collect())


def test_quality_verdicts_match_brute_force(spark, docs):
    """Each document's score by walking every tree node by node from its own statistics."""
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    assert len(model.roots)
    scores = {}
    for r in docs.select("doc_id", "text").collect():
        x, total = quality.statistics([(r.text or "").encode()])[1][0], model.bias
        for at in model.roots.tolist():
            while model.left[at] != at:
                at = int(model.left[at] if x[model.feature[at]] <= model.cut[at] else model.right[at])
            total += model.value[at]
        scores.setdefault(r.doc_id, []).append(1 / (1 + np.exp(-total)))
    for r in quality.judge(docs, model).collect():
        assert any(abs(r.score - s) < 1e-9 for s in scores[r.doc_id]) and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_on_labels_not_learned_from(spark):
    """Junk is told from prose it has not seen."""
    rng = random.Random(4)
    prose, junk = TEXTS["en"].split(), "BUY #### now!!! $$$ 99 CLICK *** &&& win |||".split()
    rows = [(k, " ".join(rng.choice(prose if k % 2 else junk) for _ in range(40))) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = quality.judge(table.where("doc_id >= 200"), quality.learn(table, labels)).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == bool(r.doc_id % 2) for r in got]) > 0.97


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    flip = rng.random(2000) < 0.1
    model = quality.fit(x, np.where(flip, 1 - y, y), np.array([1, -1, 0]), trees=30)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9
    probe = rng.random((200, 3))
    for f, sign in ((0, 1), (1, -1)):
        steps = []
        for v in np.linspace(0, 1, 40):
            p = probe.copy()
            p[:, f] = v
            steps.append(model.score(p))
        assert (sign * np.diff(np.array(steps), axis=0) >= -1e-12).all()


PAGES = [
    (1, "http://A.Example.com/en/1?x#y", ""),
    (2, "https://www.example.com/en/2", None),
    (3, "ftp://m.site.net/es/3", ""),
    (4, "http://site.org/a", '<link rel="canonical" href="http://site.net/fr/9">'),
    (5, "http://other.org/b", '<META http-equiv=refresh content="0; url=http://site.org/a">'),
    (6, "http://third.org/c", '<link href="http://site.net/fr/9" rel=canonical><link rel=canonical href="//x.com/">'),
    (7, "http://fourth.org/d", '<link rel=canonical href="/a">'),
    (8, None, "<link rel=canonical href='http://q.org/'>"),
    (9, "no url", ""),
    (10, "http://com", ""),
    (10, "http://site.org/a", ""),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[1, PAGES[0][1]] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2, PAGES[1][1]][2:] == ("www.example.com/en/", "allow")
    assert got[3, PAGES[2][1]][2:] == ("net/es/", "block")
    # 4, 5 and 6 are aliases of a blocked target, but 6 also of an allowed one, and allow precedes.
    assert got[4, PAGES[3][1]] == ("site.org", "/a", None, "allow")
    assert got[7, PAGES[6][1]][3] == "allow" and got[8, None] == ("", "", None, "allow") and got[9, "no url"][3] == "allow"
    assert got[10, "http://com"] == ("com", "", None, "allow")
    blocked = url_filter.filter_urls(pages.where("page_id not in (6)"))
    verdicts = {r.page_id: r.verdict for r in blocked.where("url like '%.org%'").collect()}
    assert verdicts == {4: "block", 5: "block", 7: "allow", 10: "block"}
    log = spark.createDataFrame([("http://fourth.org/d", "http://site.net/es/"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, redirects=log).collect()}[7] == "block"
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 3), (3, 5), (9, 9), (8, 7), (7, 6), (6, 1)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
