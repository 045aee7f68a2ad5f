"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows.

Normalising lower-cases A-Z and keeps words of ASCII letters, digits and non-ASCII
characters. A window is `window` consecutive words of an item, an item of fewer words is one
window, an item without words has none. All windows go into one automaton; every text is
scanned once, and hits are mapped back to byte offsets of the original text.

Null texts have no words. Items of equal id count once, of other ids each, also if their texts
are equal. An item whose id is null marks words but is not listed. Repeated documents each get
a row. Items are broadcast in slices of at most `slice_bytes` of text (1 MB makes an automaton
of about 360 MB, built once a Python worker), each scanned for by itself, so that a benchmark
of any size needs bounded memory. A text is scanned whole, in memory that follows its length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, stage, unstage, utf8

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Upper case to lower case, every separator to a blank; one byte stays one byte, so offsets hold.
_FOLD = bytes(c if c in _WORD_BYTES else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
SLICE = 1 << 20


def item_windows(text: bytes, window: int) -> set[str]:
    words = text.translate(_FOLD).split()
    last = max(1, len(words) - window + 1) if words else 0
    return {(b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1") for i in range(last)}


def automaton(items: list[tuple[str | None, bytes]], window: int):
    """Automaton whose values are (words in the window, indexes of its items)."""
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in item_windows(text, window):
            owners.setdefault(w, []).append(k)
    machine = ahocorasick.Automaton()
    for w, ks in owners.items():
        machine.add_word(w, (w.count(" ") - 1, tuple(ks)))
    if owners:
        machine.make_automaton()
    return machine if owners else None


_BUILT: dict[str, tuple] = {}


def _built(token: str, items: list[tuple[str | None, bytes]], window: int) -> tuple:
    """(automaton, ids) of a slice; a Python worker keeps the last one."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = automaton(items, window), [i for i, _ in items]
    return _BUILT[token]


def scan(text: bytes, machine, ids: list[str | None]) -> tuple[int, np.ndarray, set[str], int]:
    """Words in the text, the hit words' mask (empty if none is hit), listed item ids, words of the longest window hit."""
    words = text.translate(_FOLD).split()
    if machine is None or not words:
        return len(words), np.zeros(0, bool), set(), 0
    joined = b" " + b" ".join(words) + b" "
    hits = list(machine.iter(joined.decode("latin-1")))
    if not hits:
        return len(words), np.zeros(0, bool), set(), 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    step = np.zeros(len(words) + 1, np.int64)
    found: set[int] = set()
    for end, (n, ks) in hits:
        last = int(np.searchsorted(blanks, end))  # the window ends before this blank
        step[last - n] += 1
        step[last] -= 1
        found.update(ks)
    return len(words), np.cumsum(step[:-1]) > 0, {ids[k] for k in found if ids[k] is not None}, max(n for _, (n, _) in hits)


def _slices_of(items: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in slices of bounded size; the rows come one partition at a time."""
    part: list[tuple[str | None, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        text = (row["text"] or "").encode()
        if part and size + len(text) > slice_bytes:
            yield part
            part, size = [], 0
        part.append((row["item_id"], text))
        size += len(text)
    yield part


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, slice_bytes: int = SLICE) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, item_ids, longest, spans, contaminated.

    item_ids: the sorted ids of items with a window in the text. longest: the words of the
    longest window that occurs. spans: maximal runs of hit
    words as [start, end) byte offsets of the original UTF-8 text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumns({"n_words": F.lit(0).cast("bigint"), "mask": F.lit(b""), "item_ids": F.array().cast("array<string>"), "longest": F.lit(0).cast("bigint")})
    schema = rows.schema
    result = T.StructType([*schema.fields[:3], *T.StructType.fromDDL("n_hit bigint, item_ids array<string>, longest bigint, spans array<struct<start:bigint,end:bigint>>").fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, spans = [], []
            for text, n, mask in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not mask:
                    hits.append(0)
                    spans.append([])
                    continue
                hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=n)
                hits.append(int(hit.sum()))
                at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
                edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hits, pa.int64()), batch.column(4), batch.column(5), pa.array(spans, span_type)], names=result.names)

    parts = _slices_of(items.select(F.col("item_id").cast("string"), "text"), slice_bytes)
    part = next(parts)
    while part is not None:
        after = next(parts, None)
        sent, token = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def mark(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            machine, ids = _built(token, sent.value, window)
            for batch in slices(batches):
                texts = utf8(batch.column(1))
                n, masks, lists, longest = [], [], [], []
                for text, mask, listed, most in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    words, hit, found, now = scan(text, machine, ids)
                    if mask and len(hit):
                        hit = hit | np.unpackbits(np.frombuffer(mask, np.uint8), count=words).astype(bool)
                    n.append(words)
                    masks.append(np.packbits(hit).tobytes() if len(hit) else mask)
                    lists.append(sorted({*listed, *found}))
                    longest.append(max(most, now))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(masks, pa.binary()), pa.array(lists, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=schema.names)

        if after is None:
            rows = rows.mapInArrow(lambda batches, mark=mark: finish(mark(batches)), result)
        else:
            last, rows = rows, stage(rows.mapInArrow(mark, schema), "decontaminate")
            if hasattr(last, "staged_at"):
                unstage(last)
        part = after

    return rows.withColumn("contaminated", F.size("item_ids") >= min_items)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean_rows(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2) -> DataFrame:
    """The rows of docs with no full window of an item and windows of fewer than `min_items` items."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    found = decontaminate(docs.select(rest.alias("doc_id"), "text"), items, window, min_items)
    return found.where((F.col("longest") < window) & ~F.col("contaminated")).select("doc_id.*", "text").select(docs.columns)
