import numpy as np
import pytest

from foliospark.llm import repeats
from foliospark.llm.repeats import difference_cover, remove_repeats


@pytest.mark.parametrize("length", [10, 12, 40, 120, 400])
def test_cover_reaches_every_pair_of_positions(length):
    v, cover = difference_cover(length)
    assert v <= 0.7 * length
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in data:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((i, len(t), np.frombuffer(t, np.uint8)[~gone].tobytes(), spans))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "block", "bucket"), [(40, 1 << 20, 1 << 20), (40, 2000, 500), (400, 4000, 1000)])
def test_matches_brute_force(spark, docs, rows, length, block, bucket):
    got = remove_repeats(docs, length, block, bucket).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in got), key=repr) == brute(rows, length)


def test_equal_fingerprints_of_unequal_strings_do_not_tie():
    """The second fingerprint tells them apart, within a block and in a bucket."""
    key, a, b = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 3], np.uint32), np.array([2, 7, 8, 3], np.uint32)
    rows = []
    for block, check in enumerate((a, b)):
        ((bucket, keys, checks, twice),) = repeats.send((key, check), 1, 0, 1)
        n = len(keys) // 8
        rows.append((block, np.frombuffer(keys, np.uint64), np.frombuffer(checks, np.uint32), repeats._flags(twice, n)))
    answers = {block: [{"bucket": 0, "bits": bits}] for block, bits in repeats._tie(rows)}
    assert repeats.receive((key, a), 1, answers[0]).tolist() == [True, True, True, True]
    assert repeats.receive((key, b), 1, answers[1]).tolist() == [True, False, False, True]


def test_long_texts_of_one_letter_and_a_pattern(spark):
    rows = [(1, "a" * 3000), (2, "ab" * 1000), (3, "x" * 399), (4, None), (5, "q" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = remove_repeats(docs, 400, 1000, 300).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in got), key=repr) == brute(rows, 400)


def test_blocks_grow_with_the_input(spark, docs):
    assert repeats.scaled(docs) == (repeats.BLOCK_BYTES, repeats.BUCKET)


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).collect() == []
