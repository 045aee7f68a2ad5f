import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import line_dedup
from foliospark.llm.line_dedup import dedup_lines, jaccard, normal, shingle_codes


def brute(rows, threshold):
    """Kept texts when the first of equal or similar lines stays, by doc_id, then as the rows stand."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]) if r[0] is not None else (True, 0))
    nodes = {}
    for _, t in rows:
        for line in (t or "").split("\n"):
            if normal(line):
                nodes.setdefault(normal(line), len(nodes))
    lines, parent = list(nodes), list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            if jaccard(a, lines[j]) >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    seen, out = set(), []
    for i, t in rows:
        kept, n, gone = [], 0, 0
        for line in (t or "").split("\n"):
            x = normal(line)
            if not x:
                kept.append(line)
                continue
            n += 1
            if find(nodes[x]) == nodes[x] and x not in seen:
                seen.add(x)
                kept.append(line)
            else:
                gone += 1
        out.append((i, "\n".join(kept), n, gone))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = dedup_lines(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute(rows, 0.8)


def test_order_does_not_depend_on_the_partitions(spark, rows):
    """The first by doc_id stays, however the rows are dealt (repeated rows aside, which are alike)."""
    unlike = [r for k, r in enumerate(rows) if r[0] is not None and r not in rows[:k]]
    docs = spark.createDataFrame(unlike[::-1], "doc_id long, text string").repartition(5)
    got = dedup_lines(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute(unlike, 0.8)
    keyed = docs.select(F.struct(F.lit("x").alias("c"), "doc_id").alias("doc_id"), "text")
    again = dedup_lines(keyed, order=F.col("doc_id.doc_id")).collect()
    assert sorted(((r.doc_id.doc_id, r.text, r.n_lines, r.n_removed) for r in again), key=repr) == brute(unlike, 0.8)


def band_rows(key, node, pieces, n=1):
    parts = zip(np.array_split(np.array(key, np.uint64), pieces), np.array_split(np.array(node, np.int64), pieces), strict=True)
    return (batch for p in parts for batch in line_dedup.deal(iter([p]), n))


@pytest.mark.parametrize("held", [None, 1, 50])
def test_bands_pass_crowds_on_and_pair_the_rest(held):
    """A band of 200 nodes over twenty rows passes on whole, also where a bucket holds few entries."""
    rng = random.Random(3)
    entries = [(7, i) for i in range(200)] + [(100 + k, 1000 + 10 * k + j) for k in range(60) for j in range(k % 5)]
    rng.shuffle(entries)
    out = [r for b in line_dedup._band_pairs(band_rows(*zip(*entries, strict=True), 20), held) for r in b.to_pylist()]
    members = [(r["key"], r["b"]) for r in out if r["key"] is not None]
    assert sorted(members) == [(7, i) for i in range(200)]
    want = {(1000 + 10 * k + i, 1000 + 10 * k + j) for k in range(60) for j in range(k % 5) for i in range(j)}
    assert sorted((r["a"], r["b"]) for r in out if r["key"] is None) == sorted(want)


def test_crowds_give_a_forest():
    """A crowd of near copies beside unlike lines: as few links as connect them, whoever asks."""
    rng = random.Random(14)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(300))
    lines = [base[:k] + "#" + base[k + 1 :] for k in range(0, 200, 4)] + ["".join(rng.choice("qrstuvw") for _ in range(90)) for _ in range(20)]
    lines += [x + "!" for x in lines[-3:]]
    rng.shuffle(lines)
    links = list(line_dedup._crowd(list(range(len(lines))), lines, 0.8, 5))
    assert len(links) == 49 + 3 and all(jaccard(lines[a], lines[b]) >= 0.8 for a, b in links)


def test_first_of_each_digest_holds_little(monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 3)
    rng = random.Random(4)
    rows = [(rng.randrange(40), 0, rng.randrange(5), k) for k in range(300)]
    parts = (tuple(np.array(c, t) for c, t in zip(zip(*rows[k : k + 30], strict=True), (np.uint64, np.uint64, np.int64, np.int64), strict=True)) for k in range(0, 300, 30))
    dealt = (batch for p in parts for batch in line_dedup.deal(iter([p]), 1))
    found = [r for b in line_dedup._first_of_each(dealt) for r in b.to_pylist()]
    got = sorted(k for r in found for k in np.frombuffer(r["part"], np.int32).tolist())
    assert got == sorted(min((o, i) for h, _, o, i in rows if h == d)[1] for d in {r[0] for r in rows})


def test_recall_at_the_threshold(spark):
    """Isolated pairs at 0.80 to 0.82, where bands find 0.997 of them."""
    rng = random.Random(21)
    rows = []
    while len(rows) < 600:
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(140)]
        other = base.copy()
        for at in rng.sample(range(4, 136), 3):
            other[at] = "#"
        if 0.8 <= jaccard("".join(base), "".join(other)) <= 0.82:
            rows += [(len(rows), "".join(base)), (len(rows) + 1, "".join(other))]
    removed = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").count()
    assert removed >= 0.98 * 300


def test_large_bands_lose_no_link(spark):
    """A crowd of near copies, more than a band compares in pairs."""
    rng = random.Random(6)
    base = [rng.choice("abcdefghij klmnop") for _ in range(200)]
    rows = []
    for i in range(70):
        line = base.copy()
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(200)] = rng.choice("xyz")
        rows.append((i, "".join(line)))
    rows += [(100 + i, "".join(rng.choice("abcdefghij klmnop") for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = dedup_lines(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute(rows, 0.8)


@pytest.mark.parametrize("limit", [4, 16, 4096])
def test_crowds_lose_no_link(spark, limit):
    """A chain of lines each like the next, in one band, with a limit that splits it or not."""
    lines = ["".join(chr(97 + (k * 7 + k // 26) % 26) for k in range(120))]
    for s in range(1, 25):
        lines.append(lines[-1][:-1][2:] + "QR" + chr(65 + s))
    sketch = [x.tobytes() for x in line_dedup.signatures(lines).astype("uint32")]
    members = spark.createDataFrame([(1, k) for k in range(len(lines))], "key long, id long")
    table = spark.createDataFrame(list(zip(range(len(lines)), lines, sketch, strict=True)), "id long, line string, sketch binary")
    links = line_dedup._large_band_links(members, table, line_dedup.BANDS, 0.8, 5, limit).collect()
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert jaccard(lines[r.a], lines[r.b]) >= 0.8
        parent[find(r.a)] = find(r.b)
    for i, a in enumerate(lines):
        for j in range(i):
            if jaccard(a, lines[j]) >= 0.8:
                assert find(i) == find(j)


@pytest.fixture(scope="module")
def one_band_pair():
    """Two similar lines that meet in one band alone."""
    rng = random.Random(8)
    while True:
        base = [rng.choice("abcdefghij klmnop") for _ in range(200)]
        lines = ["".join(base)]
        for _ in range(300):
            line = base.copy()
            for at in rng.sample(range(2, 198), 5):
                line[at] = "z"
            lines.append("".join(line))
        keys = line_dedup.signatures(lines)
        for i in range(1, len(lines)):
            if (keys[i] == keys[0]).sum() == 1 and jaccard(lines[0], lines[i]) >= 0.8:
                return lines[0], lines[i]


def test_one_band_is_enough(spark, one_band_pair):
    docs = spark.createDataFrame(list(enumerate(one_band_pair)), "doc_id long, text string").coalesce(1)
    got = dedup_lines(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 1)]


def crowd_links(spark, lines, **limits):
    """The links of one large band that holds all lines."""
    sketch = [x.tobytes() for x in line_dedup.signatures(lines).astype("uint32")]
    members = spark.createDataFrame([(1, k) for k in range(len(lines))], "key long, id long")
    table = spark.createDataFrame(list(zip(range(len(lines)), lines, sketch, strict=True)), "id long, line string, sketch binary")
    return line_dedup._large_band_links(members, table, line_dedup.BANDS, 0.8, 5, **limits).collect()


def test_one_band_is_enough_in_a_crowd(spark, one_band_pair):
    rng = random.Random(9)
    others = ["".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(1, 90))) for _ in range(30)]
    links = crowd_links(spark, [one_band_pair[0], *others, one_band_pair[1]])
    assert {frozenset((r.a, r.b)) for r in links} == {frozenset((0, 31))}


def test_a_node_like_another_keeps_its_links(spark):
    """a and b have equal sketches, and only b is similar to c; the band is over the limit."""
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    while True:
        b = draw(2004)
        a = b[:1000] + "!" + b[1001:]
        keys = line_dedup.signatures([a, b])
        if (keys[0] == keys[1]).all():
            break
    c = b + "".join(rng.choice("qrstuvwxyz") for _ in range(len(line_dedup.shingle_set(b)) // 4))
    assert jaccard(a, b) >= 0.8 and jaccard(b, c) >= 0.8 > jaccard(a, c)
    found = {frozenset((r.a, r.b)) for r in crowd_links(spark, [a, b, c, draw(50), draw(60)], limit=2)}
    assert found == {frozenset((0, 1)), frozenset((1, 2))}


def test_cut_by_characters_loses_no_link(spark):
    """Pairs far from each other in a band of long lines."""
    rng = random.Random(13)
    heads = ["".join(rng.choice("abcdefghijklmnop") for _ in range(100)) for _ in range(9)]
    found = {frozenset((r.a, r.b)) for r in crowd_links(spark, heads + [x + "!" for x in heads], chars=250)}
    assert found == {frozenset((k, 9 + k)) for k in range(9)}


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_shingle_numbers_are_exact(size):
    rng = random.Random(10)
    lines = ["".join(rng.choice("abcÜ😀") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    numbers, starts = line_dedup.shingle_numbers(lines, size)
    sets = [line_dedup.shingle_set(x, size) for x in lines]
    mine = [set(numbers[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
    assert [len(x) for x in mine] == [len(x) for x in sets] == (starts[1:] - starts[:-1]).tolist()
    assert all(len(mine[i] & mine[j]) == len(sets[i] & sets[j]) for i in range(40) for j in range(i))


def test_shingles_stay_within_their_line():
    a, starts = shingle_codes(["abcdef", "x", "bcdef"])
    assert starts.tolist() == [0, 2, 3]
    assert a[1] == a[3] and a[2] not in (a[0], a[1])


def test_key_of_any_type_and_empty_tables(spark, docs, no_docs):
    keyed = docs.select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    assert dedup_lines(keyed).select("doc_id.lang").count() == docs.count()
    assert dedup_lines(no_docs).collect() == []


@pytest.mark.parametrize(("a", "b", "want"), [("abcdef", "abcdef", 1.0), ("ab", "ab", 1.0), ("abcdef", "ghijkl", 0.0)])
def test_jaccard(a, b, want):
    assert jaccard(a, b) == want
