"""Token-id files: documents' ids in ascending doc_id order, range-coded in checked blocks.

The files are Parquet as a container, one row a segment of whole documents (`segment_ids` ids to
twice as many, or all of a smaller shard's; one document at least): shard and the ids before it in the shard, the
documents' ids and lengths, and the coded payload of `range_coder`. Shards follow one another in doc_id
order, so a document's global start is its shard's offset plus its place in it; only one
number a shard reaches the driver.

A null text is empty and has the end id alone. Rows with a null doc_id come first; rows that
repeat a doc_id are ordered by text, and equal rows are written once each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder
from .common import documents, fresh_path, slices
from .tokens import default_path, encoder, with_end

SEGMENT_IDS = 4 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held, id_type = 0, None

        def flush(least: int) -> pa.RecordBatch:
            """A segment of the first documents held that have `least` ids, or of all."""
            nonlocal names, ids, counts, held, before
            lengths, every, start = np.concatenate(counts), np.concatenate(ids), before
            n = min(len(lengths), int(np.searchsorted(np.cumsum(lengths), least)) + 1)
            size = int(lengths[:n].sum())
            values = [[shard], [start], [names[:n]], [lengths[:n].tolist()], [range_coder.encode(every[:size])]]
            names, ids, counts, held, before = names[n:], [every[size:]], [lengths[n:]], held - size, before + size
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["shard", "before", "doc_ids", "lengths", "payload"])

        for batch in slices(batches):
            id_type = batch.column(0).type
            some, n = with_end(*code.encode([t or "" for t in batch.column(1).to_pylist()]), end_id)
            names += batch.column(0).to_pylist()
            ids.append(some)
            counts.append(n)
            held += len(some)
            while held >= 2 * segment_ids:
                yield flush(segment_ids)
        if names:
            yield flush(held)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, f"shard bigint, before bigint, doc_ids array<{kind}>, lengths array<bigint>, payload binary").write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of every document."""
    files = spark.read.parquet(path)
    totals = sorted(files.select("shard", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n")).collect())
    offsets = dict(zip((s for s, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(2).type.value_type
            for row in batch.to_pylist():
                ids = range_coder.decode(row["payload"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if len(ids) != ends[-1]:
                    raise ValueError("the segment's ids do not fit its documents")
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], id_type), pa.array(starts + (offsets[row["shard"]] + row["before"])), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, default_path())
    return read_token_files(spark, path, with_ids=False)
