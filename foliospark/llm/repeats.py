"""Exact-substring deduplication by blockwise suffix sorting over a difference cover.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else.
Suffixes matter only to that depth, so their order is taken over 96-bit fingerprints of
their first `length` bytes (equal strings, equal places), and work is done in two sorts:

1. Cover sample. D is a difference cover modulo v: for any two positions i and j there is a
   d < v with both i + d and j + d in D. The sample suffixes (about 6 in 100) are sorted by
   their first length - v + 1 bytes; a sample suffix's rank says whether it ties with another.
   Two suffixes that agree on `length` bytes meet in a tied sample pair within v bytes, so a
   suffix with no tied sample there is unique, and most suffixes end here.
2. Suffix buckets. The suffixes whose long ties the cover could not rule out are dealt to
   buckets of the order, of about `bucket` suffixes each, and sorted one bucket at a time.
   Buckets are made in passes, so that what is in flight stays below the text's own size.

Texts travel in blocks of about `block_bytes`. A block sends each bucket its distinct
fingerprints, sorted, with a mark for those it holds twice; the bucket answers with one bit
for each. So a string that fills a third of the corpus costs one entry a block, and no group
is ever gathered. Nothing but counts reaches the driver.

The result is exact but for collisions of a 64-bit and a 32-bit fingerprint, of different bases,
between suffixes that pass step 1: among 10**12 of them some 10**-5 false ties are to be
expected, among 10**14 some 0.06.
Null texts are empty, a text of any length is one entry of its block. Repeated rows remove each
other. A null doc_id is kept as it is. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, stage, unstage, utf8

LENGTH, BLOCK_BYTES, BUCKET = 400, 2 << 20, 1 << 20
_SEGMENT = 1 << 18
#: Odd bases of the fingerprints, by their bits.
_BASES = {64: 0x9E3779B97F4A7C15 | 5, 32: 0xD192ED05}
#: Primitive polynomials over GF(2) by degree.
_PRIMITIVE = {3: 0b1011, 6: 0b1000011, 9: 0b1000010001, 12: 0b1000001010011}


@lru_cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set (Singer) modulo v = q*q + q + 1, the largest with v <= 0.7 length.

    With a primitive element a of GF(q**3), D holds the i < v whose a**i has trace zero over GF(q).
    """
    if length < 10:
        raise ValueError("length must be 10 or more")
    k = max(k for k in (1, 2, 3, 4) if 4**k + 2**k + 1 <= 0.7 * length)
    q, degree = 2**k, 3 * k

    def times(x: int, y: int) -> int:
        out = 0
        while y:
            if y & 1:
                out ^= x
            x, y = x << 1, y >> 1
            if x >> degree:
                x ^= _PRIMITIVE[degree]
        return out

    def power(x: int, n: int) -> int:
        out = 1
        while n:
            if n & 1:
                out = times(out, x)
            x, n = times(x, x), n >> 1
        return out

    v, x, chosen = q * q + q + 1, 1, []
    for i in range(v):
        if x ^ power(x, q) ^ power(x, q * q) == 0:
            chosen.append(i)
        x = times(x, 2)
    return v, tuple(chosen)


@lru_cache(maxsize=4)
def _powers(width: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.dtype(kind).itemsize * 8
    base = _BASES[bits]
    table = np.random.default_rng(base % 2**32).integers(0, 2**bits, 256, kind)
    up, down = np.ones(_SEGMENT + width, kind), np.ones(_SEGMENT, kind)
    up[1:], down[1:] = kind(base), kind(pow(base, -1, 2**bits))
    return table, np.cumprod(up, dtype=kind), np.cumprod(down, dtype=kind)


def _window_sums(data: np.ndarray, at: np.ndarray, width: int, kind: type) -> np.ndarray:
    """A polynomial of data[p:p+width], modulo 2**32 or 2**64, for the ascending positions `at`."""
    table, up, down = _powers(width, kind)
    out = np.empty(len(at), kind)
    for s in range(0, len(data), _SEGMENT):
        a, b = np.searchsorted(at, (s, s + _SEGMENT))
        if a == b:
            continue
        part = data[s : s + _SEGMENT + width]
        total = np.zeros(len(part) + 1, kind)
        np.cumsum(table[part] * up[: len(part)], out=total[1:], dtype=kind)
        p = at[a:b] - s
        out[a:b] = (total[p + width] - total[p]) * down[p]
    return out


def window_keys(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of data[p:p+width], spread over their whole range."""
    out = _window_sums(data, at, width, np.uint64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_checks(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Further 32 bits, of another base and other letters' values."""
    return _window_sums(data, at, width, np.uint32)


def starts_of(sizes: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions from which `width` bytes stay within their text."""
    step = np.zeros(int(sizes.sum()) + 1, np.int32)
    ends = np.cumsum(sizes)
    np.add.at(step, ends - sizes, (sizes >= width).astype(np.int32))
    np.add.at(step, np.maximum(ends - sizes, ends - width + 1), -(sizes >= width).astype(np.int32))
    return np.cumsum(step[:-1]) > 0


class Block:
    """A block's bytes and the two sets of suffixes that get sorted."""

    def __init__(self, blob: bytes, sizes: list[int], length: int):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
        self.sizes, self.length = np.array(sizes, np.int64), length
        self.v, self.cover = difference_cover(length)

    def sample(self) -> np.ndarray:
        in_cover = np.zeros(self.v, bool)
        in_cover[list(self.cover)] = True
        n = len(self.data)
        return np.flatnonzero(np.resize(in_cover, n) & starts_of(self.sizes, self.length - self.v + 1)) if n else np.zeros(0, np.int64)

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Suffixes with a tied sample suffix less than v bytes on."""
        at = self.sample()[tied]
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, np.maximum(at - self.v + 1, 0), 1)
        np.add.at(step, at + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & starts_of(self.sizes, self.length)) if len(at) else np.zeros(0, np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


Keys = tuple[np.ndarray, np.ndarray | None]  # fingerprints, and second ones where ties must be certain


def _ordered(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs, and which of them, so ordered, differ from the one before."""
    order = np.argsort(keys)
    if not len(keys):
        return order, np.zeros(0, bool)
    sorted_ = keys[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    if checks is not None:
        second = checks[order]
        if (~first[1:] & (second[1:] != second[:-1])).any():  # equal fingerprints of unequal strings
            order = np.lexsort((checks, keys))
            sorted_, second = keys[order], checks[order]
            first[1:] = (sorted_[1:] != sorted_[:-1]) | (second[1:] != second[:-1])
    return order, first


def send(found: Keys, n: int, low: int, high: int) -> Iterator[tuple[int, bytes, bytes | None, bytes]]:
    """(bucket, distinct keys, their checks, held-twice bits) for buckets low <= b < high of n."""
    keys, checks = found
    if (low, high) != (0, n):
        bucket = bucket_of(keys, n)
        some = (bucket >= low) & (bucket < high)
        keys, checks = keys[some], None if checks is None else checks[some]
    order, first = _ordered(keys, checks)
    at = np.flatnonzero(first)
    twice = np.diff(np.append(at, len(keys))) > 1
    keys, checks = keys[order[at]], None if checks is None else checks[order[at]]
    bucket = bucket_of(keys, n)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), keys[a:b].tobytes(), None if checks is None else checks[a:b].tobytes(), _bits(twice[a:b])


def receive(found: Keys, n: int, answers: list[dict]) -> np.ndarray:
    """For each key, in the order given, whether its bucket found it twice; keys of other passes: False."""
    keys, checks = found
    order, first = _ordered(keys, checks)
    bucket = bucket_of(keys[order[first]], n)
    flags = np.zeros(len(bucket), bool)
    for answer in answers:
        a, b = np.searchsorted(bucket, (answer["bucket"], answer["bucket"] + 1))
        flags[a:b] = _flags(answer["bits"], b - a)
    out = np.zeros(len(keys), bool)
    out[order] = flags[np.cumsum(first) - 1]
    return out


def _tie(rows: list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """One bucket's sort: which of each block's keys are held twice in all."""
    blocks, keys, checks, twice = zip(*rows, strict=True)
    order, first = _ordered(np.concatenate(keys), None if checks[0] is None else np.concatenate(checks))
    group = np.cumsum(first) - 1
    tied = np.bincount(group) > 1
    tied |= np.bincount(group, np.concatenate(twice)[order]) > 0
    flags = np.zeros(len(order), bool)
    flags[order] = tied[group]
    ends = np.cumsum([len(k) for k in keys])
    for block, end, k in zip(blocks, ends.tolist(), keys, strict=True):
        yield block, _bits(flags[end - len(k) : end])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            got = list(_tie(rows))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got]), pa.array([now] * len(got)), pa.array([x for _, x in got], pa.binary())], names=["block", "bucket", "bits"])

    for batch in batches:
        for bucket, block, keys, checks, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from flush()
                now, rows = bucket, []
            k = np.frombuffer(keys, np.uint64)
            rows.append((block, k, None if checks is None else np.frombuffer(checks, np.uint32), _flags(twice, len(k))))
    yield from flush()


def _sort_buckets(blocks: DataFrame, keys_of: Callable[[dict], Keys], columns: list[str], n: int, low: int, high: int) -> DataFrame:
    """(block, bucket, bits), staged, from one sort of the buckets low <= b < high of n."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent = list(send(keys_of(row), n, low, high))
                bucket, keys, checks, twice = zip(*sent, strict=True) if sent else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([row["block"]] * len(sent), pa.int64()), pa.array(keys, pa.binary()), pa.array(checks, pa.binary()), pa.array(twice, pa.binary())], names=["bucket", "block", "keys", "checks", "twice"])

    dealt = blocks.select(*columns).mapInArrow(deal, "bucket bigint, block bigint, keys binary, checks binary, twice binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "block")
    return stage(ordered.mapInArrow(_answer, "block bigint, bucket bigint, bits binary"), "suffix-ties")


def _gathered(ties: DataFrame) -> DataFrame:
    return ties.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def scaled(docs: DataFrame) -> tuple[int, int]:
    """(block bytes, bucket entries) by the size of the input as the plan knows it.

    A block sends each bucket one row, so both grow with the square root of the input beyond
    about 100 GB, up to what a Python worker sorts in some hundred MB.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    times = min(16.0, max(1.0, (size / 1e11) ** 0.5))
    return int(BLOCK_BYTES * times) if times < 8 else 8 * BLOCK_BYTES, int(BUCKET * times)


def make_blocks(docs: DataFrame, block_bytes: int, order: Column | None = None) -> DataFrame:
    """Rows (block, doc_ids, sizes, blob, n_bytes, orders): texts in blocks, compressed; orders: each document's `order`."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL("block bigint").fields, T.StructField("doc_ids", T.ArrayType(kind)), *T.StructType.fromDDL("sizes array<bigint>, blob binary, n_bytes bigint, orders array<bigint>").fields])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        block, ids, texts, orders = TaskContext.get().partitionId() << 16, [], [], []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary()), pa.array([size], pa.int64()), pa.array([orders], pa.list_(pa.int64()))], names=["block", "doc_ids", "sizes", "blob", "n_bytes", "orders"])
            return out

        for batch in slices(batches, limit=block_bytes):
            id_type = batch.column(0).type
            for doc_id, text, place in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                orders.append(place)
                texts.append(text)
                size += len(text)
                if size >= block_bytes or len(ids) >= 1 << 16:
                    yield flush()
                    block, ids, texts, orders, size = block + 1, [], [], [], 0
        if ids:
            yield flush()

    place = F.lit(0) if order is None else order
    return docs.select("doc_id", "text", place.cast("bigint").alias("order")).mapInArrow(build, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None, bucket: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the remaining bytes), spans (removed [start, end)).

    block_bytes and bucket, by default from scaled(), change cost alone.
    """
    plan_bytes, plan_bucket = scaled(docs.select("doc_id", "text"))
    block_bytes, bucket = block_bytes or plan_bytes, bucket or plan_bucket
    kind = docs.schema["doc_id"].dataType.simpleString()
    v, cover = difference_cover(length)
    blocks = stage(make_blocks(docs, block_bytes).drop("orders"), "suffix-blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0

    def sample_keys(row: dict) -> Keys:
        b = Block(row["blob"], row["sizes"], length)
        return window_keys(b.data, b.sample(), length - v + 1), None  # a false tie only leaves more to sort

    n1 = max(1, ceil(n_bytes * len(cover) / v / bucket))
    ranks = _sort_buckets(blocks, sample_keys, ["block", "sizes", "blob"], n1, 0, n1)

    def keep_tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tied, count = [], []
            for row in batch.select(["sizes", "blob", "answers"]).to_pylist():
                b = Block(row["blob"], row["sizes"], length)
                flags = receive(sample_keys(row), n1, row["answers"] or [])
                tied.append(_bits(flags))
                count.append(len(b.candidates(flags)))
            kept = batch.select(["block", "doc_ids", "sizes", "blob"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tied, pa.binary()), pa.array(count, pa.int64())], names=[*kept.schema.names, "tied", "n_candidates"])

    joined = blocks.drop("n_bytes").join(_gathered(ranks).hint("shuffle_hash"), "block", "left")
    ranked = stage(joined.mapInArrow(keep_tied, f"block bigint, doc_ids array<{kind}>, sizes array<bigint>, blob binary, tied binary, n_candidates bigint"), "suffix-ranked")
    unstage(blocks, ranks)

    def candidates_of(row: dict) -> tuple[Block, np.ndarray]:
        b = Block(row["blob"], row["sizes"], length)
        return b, b.candidates(_flags(row["tied"], len(b.sample())))

    def keys_at(b: Block, at: np.ndarray) -> Keys:
        return window_keys(b.data, at, length), window_checks(b.data, at, length)

    def suffix_keys(row: dict) -> Keys:
        return keys_at(*candidates_of(row))

    total = ranked.agg(F.sum("n_candidates")).first()[0] or 0
    n2 = max(1, ceil(total / bucket))
    passes = min(n2, max(1, ceil(12 * total / max(1, n_bytes))))
    cuts = [n2 * k // passes for k in range(passes + 1)]
    ties = None
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = _sort_buckets(ranked, suffix_keys, ["block", "sizes", "blob", "tied"], n2, low, high)
        ties = part if ties is None else ties.union(part)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(batch.schema.get_field_index("doc_ids")).type.value_type
            for row in batch.to_pylist():
                b, at = candidates_of(row)
                again = at[receive(keys_at(b, at), n2, row["answers"] or [])]
                step = np.zeros(len(b.data) + 1, np.int32)
                np.add.at(step, again, 1)
                np.add.at(step, again + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept, spans = [], []
                end = 0
                for size in row["sizes"]:
                    start, end = end, end + size
                    mask = gone[start:end]
                    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    kept.append(b.data[start:end][~mask].tobytes())
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_type), pa.array(row["sizes"], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["doc_id", "n_bytes", "kept", "spans"])

    final = ranked.drop("n_candidates").join(_gathered(ties).hint("shuffle_hash"), "block", "left")
    return final.mapInArrow(finish, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
