import re

import pytest

from foliospark.llm.decontaminate import clean_rows, decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ITEMS = [(1, "alpha beta"), (2, None), (3, "!!!"), (4, "A b, c d e f g h i"), (4, "Ünïcödé text"), (None, "zzz"), (10, "alpha beta"), (7, "river stone light river")]


def brute(rows, items, window):
    found = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w, ids = words_of(t), set()
        hit = [False] * len(w)
        for pattern, owners in found.items():
            for k in range(len(w) - len(pattern) + 1):
                if tuple(w[k : k + len(pattern)]) == pattern:
                    ids |= owners - {None}
                    hit[k : k + len(pattern)] = [True] * len(pattern)
        out.append((i, len(w), sum(hit), sorted(ids), len(ids) >= 2))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 8])
def test_matches_brute_force(spark, docs, rows, slice_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(docs, items, slice_bytes=slice_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got), key=repr) == brute(rows, ITEMS, 8)


def test_spans_are_offsets_of_the_original(spark):
    text = "Say: Alpha,  BETA! or ümlaut"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "ÜMLAUT"), (3, "ümlaut")], "item_id long, text string")
    (row,) = decontaminate(docs, items).collect()
    assert [text.encode()[s.start : s.end].decode() for s in row.spans] == ["Alpha,  BETA", "ümlaut"]
    assert row.item_ids == ["1", "3"]


def test_clean_rows_drop_full_windows_and_keep_short_chance_hits(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {item[:39]} y"), (2, "one two three"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "one two")], "item_id long, text string")
    assert [r.doc_id for r in clean_rows(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_ten_megabytes_in_one_text(spark):
    text = "filler word " * 900_000 + "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "One two three four, five six seven eight")], "item_id long, text string")
    (row,) = decontaminate(docs, items).select("n_words", "n_hit", "item_ids", "spans").collect()
    assert (row.n_words, row.n_hit, row.item_ids) == (1_800_008, 8, ["5"]) and row.spans[0].end == len(text)


def test_empty_tables(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in decontaminate(docs, none).collect()} == {(0, False)}
    assert decontaminate(no_docs, none).collect() == []
