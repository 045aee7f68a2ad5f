import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import simhash


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(fps, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_matches_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f, least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_masks_cover_every_pair_in_the_radius(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(3)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(flip & m == 0 for m in masks)
        fine = simhash.finer_masks(masks[0], radius)
        free = [b for b in range(64) if not masks[0] >> b & 1]
        flip = sum(1 << b for b in rng.sample(free, radius))
        assert any(flip & m == 0 for m in fine)


@pytest.mark.parametrize("radius", [2, 3])
def test_crowded_buckets_lose_no_link(spark, radius):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(150)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    links = [(r.a % 2**64, r.b % 2**64) for part in simhash.fingerprint_links(df, radius, bucket=16) for r in part.where("mask is null").collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    want = components(fps, radius)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = lambda key: sorted(sorted(f for f in fps if key(f) == r) for r in {key(f) for f in fps})
    assert groups(find) == groups(want.get)


def test_one_of_each_keeps_the_least_of_every_component(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(ids) == len(want) and set(ids) == want


def test_helper_names_may_be_taken(spark, docs):
    wide = docs.select("*", *[F.lit(c).alias(c) for c in ("_fp", "_row", "row", "mask", "masked")])
    kept = simhash.one_of_each(wide)
    assert kept.dtypes == wide.dtypes and kept.count() == simhash.one_of_each(docs).count()
    assert {(r._fp, r._row, r.row) for r in kept.collect()} == {("_fp", "_row", "row")}


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.one_of_each(no_docs).collect() == []


def test_long_text_in_parts():
    text = " ".join(f"w{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert np.uint64(simhash.fingerprint(b"")) == 0
