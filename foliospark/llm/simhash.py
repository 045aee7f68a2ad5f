"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has bit b set if it is set in over half of its shingles' XXH64 values
(seed 42). Covering: every bit position gets a code word of radius + 1 bits; table v (each
non-zero v of radius + 1 bits) keeps the positions whose code word has odd inner product with
v. Any radius positions leave some v orthogonal to all of their code words, so every pair
within the radius agrees on all kept bits of that table: candidates are complete.

Distinct fingerprints are the nodes, so exact copies never meet in a bucket. A bucket of more
than `bucket` fingerprints is dealt anew: the bits it has not fixed are cut into radius + 1
blocks, and any pair within the radius agrees on one block. Each round fixes more bits, and a
bucket with f free bits has at most 2**f members, so this ends with bounded buckets and loses
no pair. Buckets emit a pair only if it is within the radius, and for large ones only a
spanning forest. Components come from distributed contraction.

Null and empty texts have fingerprint zero and link like any other. A null doc_id belongs to
its fingerprint's component but cannot name it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, documents, free_name, slices, stage, unstage, utf8

RADIUS, BUCKET, SMALL = 3, 16384, 8
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    values = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cache: dict[bytes, int] = {}
            found = np.array([cache[t] if t in cache else cache.setdefault(t, fingerprint(t, shingle)) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks such that any `radius` positions are all outside one of them."""
    codes = [1 + b % (2 ** (radius + 1) - 1) for b in range(bits)]
    return [sum(1 << b for b, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def finer_masks(mask: int, radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The mask with one of radius + 1 blocks of its free bits added to each."""
    free = [b for b in range(bits) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius: breadth first, one row of distances a node."""
    left, a, b = np.arange(1, len(x)), [], []
    queue = [0]
    while True:
        while queue and len(left):
            k = queue.pop()
            near = np.bitwise_count(x[left] ^ x[k]) <= radius
            hit = left[near]
            left = left[~near]
            a.append(np.full(len(hit), x[k]))
            b.append(x[hit])
            queue.extend(hit.tolist())
        if not len(left):
            break
        queue, left = [int(left[0])], left[1:]
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by key, all buckets whole: shifted comparison for small ones."""
    links = []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    few = np.repeat(sizes <= SMALL, sizes)
    for s in range(1, SMALL):
        near = (key[s:] == key[:-s]) & few[s:] & (np.bitwise_count(fp[s:] ^ fp[:-s]) <= radius)
        links.append((fp[:-s][near], fp[s:][near]))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        links.append(_forest(fp[start : start + size], radius))
    return links


def _match(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, masked, fp) sorted by (mask, masked) to links (a, b, null), or (fp, null, finer mask) of too large buckets."""

    def dealt_anew(fp: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        kinds, place = np.unique(mask, return_inverse=True)
        finer = np.array([[_signed(f) for f in finer_masks(int(m) & (2**64 - 1), radius)] for m in kinds.tolist()], np.int64)
        return rows(np.repeat(fp, radius + 1), none(len(fp) * (radius + 1)), finer[place].reshape(-1))

    def rows(a, b, mask):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b if isinstance(b, pa.Array) else pa.array(b.view(np.int64)), mask if isinstance(mask, pa.Array) else pa.array(mask)], names=["a", "b", "mask"])

    def none(n: int) -> pa.Array:
        return pa.nulls(n, pa.int64())

    carry = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    hot = None  # the bucket whose rows pass on
    for batch in _with_end(batches):
        if batch is not None:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            carry = [np.concatenate([c, g if k < 2 else g.view(np.uint64)]) for k, (c, g) in enumerate(zip(carry, got, strict=True))]
        mask, masked, fp = carry
        if hot is not None:
            same = (mask == hot[0]) & (masked == hot[1])
            if same.any():
                yield dealt_anew(fp[same], mask[same])
            carry = [c[~same] for c in carry]
            mask, masked, fp = carry
        if not len(fp):
            continue
        edge = np.concatenate([[True], (mask[1:] != mask[:-1]) | (masked[1:] != masked[:-1])])
        group = np.cumsum(edge)
        sizes = np.bincount(group)[1:]
        over = (sizes > limit) & (np.array([64 - (int(m) & (2**64 - 1)).bit_count() for m in mask[edge]]) > 12)
        big = over[group - 1]
        if big.any():
            yield dealt_anew(fp[big], mask[big])
        last = group == group[-1]
        hot = (mask[-1], masked[-1]) if over[-1] else None
        whole = ~big & (~last if batch is not None else True)
        for a, b in bucket_links(group[whole], fp[whole], radius) if whole.any() else []:
            if len(a):
                yield rows(a, b, none(len(a)))
        rest = ~big & last if batch is not None else np.zeros(len(fp), bool)
        carry = [c[rest] for c in carry]


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> list[DataFrame]:
    """Staged frames of (a, b) links, which connect all pairs of distinct(fp) within the radius and none beyond it."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    todo = distinct.select("fp", F.explode(masks).alias("mask"))
    rounds: list[DataFrame] = []
    while True:
        dealt = todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("masked"), "fp")
        sorted_ = dealt.repartition("mask", "masked").sortWithinPartitions("mask", "masked")
        rounds.append(stage(sorted_.mapInArrow(lambda batches: _match(batches, radius, bucket), "a bigint, b bigint, mask bigint"), "simhash-links"))
        hot = rounds[-1].where("mask is not null")
        if hot.isEmpty():
            return rounds
        todo = hot.select(F.col("a").alias("fp"), "mask").distinct()


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the fingerprints of distinct(fp) that link to another."""
    rounds = fingerprint_links(distinct, radius)
    links = reduce(DataFrame.union, [r.where("mask is null").select("a", "b") for r in rounds])
    roots = connected_components(links)
    unstage(*rounds)
    return roots


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable, itself included) for every row.

    Other columns of docs are not read, whatever their names. Repeated rows each get a row.
    """
    own = stage(fingerprints(docs, shingle), "simhash")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(distinct.select("fp"), radius)
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """The rows of docs with one of each component: that of the least doc_id, else the first read.

    All columns pass through, whatever their names.
    """
    at, fp, row = docs.columns.index("text"), free_name(docs, "fp"), free_name(docs, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, fp])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    own = stage(marked.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    small = own.select(F.col(fp).alias("fp"), "doc_id", F.col(row).alias("row"))
    roots = fingerprint_components(small.select("fp").distinct(), radius)
    first = small.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    best = first.join(roots, first["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first")["row"].alias(row))
    return own.join(best.select(row), row, "left_semi").select(docs.columns)
