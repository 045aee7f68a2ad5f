"""Bounded-space online best-fit packing of whole documents into fixed-length sequences.

A document's ids end with `end_id`. Only documents longer than a sequence are cut, into full
pieces after a shorter first one. Full pieces are sequences by themselves. Every other piece
goes to the open bin with the least free space that holds it, found as the lowest set bit of
a bitset keyed by free space; when `open_bins` are open and none fits, the fullest closes.

Packing is online within each input partition, so there is no shuffle: at most `open_bins`
sequences a partition stay unfilled, and many small partitions need more sequences than few
large ones (at 50 MB of text a partition about 1 %). A null text is empty (its end id alone).
Repeated rows are packed once each; a text of any length is encoded whole and cut. Columns
other than doc_id and text are not read. sequence_id is the partition's number in the upper bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices
from .tokens import default_path, encoder, with_end

SEQUENCE, OPEN_BINS = 2048, 1024


class BestFit:
    """Online best-fit over a bounded number of open bins."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.open_bins, self.next, self.open = size, open_bins, first, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free space
        self.free = 0  # bit f is set if a bin with f free is open

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        if length == self.size:
            self.next += 1
            return self.next - 1, 0
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self.bins[space].pop()
            self.open -= 1
            if not self.bins[space]:
                self.free ^= 1 << space
        else:
            if self.open >= self.open_bins:
                fullest = (self.free & -self.free).bit_length() - 1
                self.bins[fullest].pop()
                self.open -= 1
                if not self.bins[fullest]:
                    self.free ^= 1 << fullest
            bin_, space = self.next, self.size
            self.next += 1
        left = space - length
        if left:
            self.bins[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.size - space


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SEQUENCE, open_bins: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(size, open_bins, TaskContext.get().partitionId() << 32)
        code = encoder(tokenizer)
        for batch in slices(batches):
            ids, counts = with_end(*code.encode([t or "" for t in batch.column(1).to_pylist()]), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            row, piece, start, length, crc, sequence, offset = [], [], [], [], [], [], []
            base = 0
            for k, n in enumerate(counts.tolist()):
                a, p = 0, 0
                while a < n:
                    b = min(n, a + size) if p else (n - 1) % size + 1
                    seq, off = bins.place(b - a)
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * (base + a) : 4 * (base + b)]))
                    sequence.append(seq)
                    offset.append(off)
                    a, p = b, p + 1
                base += n
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, sequence, offset))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path(), with_ids=False)
