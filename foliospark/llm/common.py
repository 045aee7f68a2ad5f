"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at a time; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20
#: The paths staged since the innermost stage_alone() began.
_STAGED: ContextVar[list[str]] = ContextVar("staged", default=[])  # noqa: B039
#: The local folders of sessions on one machine that name no shared one.
_ONE_MACHINE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine alone a fresh local one.

    Raises ValueError on a cluster that names none, as executors cannot see one another's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _ONE_MACHINE:
        _ONE_MACHINE[context.applicationId] = tempfile.mkdtemp(prefix="foliospark-")
        _delete_at_exit(spark, _ONE_MACHINE[context.applicationId])
    return _ONE_MACHINE[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is not taken; what is written there goes when the JVM ends, or before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    _STAGED.get().append(path)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.mkdirs(hadoop_path)  # only what exists is deleted
    files.deleteOnExit(hadoop_path)


def _delete(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)
    files.cancelDeleteOnExit(hadoop_path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors. They go with unstage() or, what a lazy result still
    reads, when the JVM ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the files behind frames of stage() that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.staged_at)


def stage_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """stage() for the frame that `make` returns, without any file that was staged on its way."""
    mine: list[str] = []
    token = _STAGED.set(mine)
    try:
        out = stage(make(), label)
    finally:
        _STAGED.reset(token)
    for path in mine:
        if path != out.staged_at:
            _delete(out.sparkSession, path)
    _STAGED.get().append(out.staged_at)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(text_sizes(batch.column(batch.schema.get_field_index(column))))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the least node reachable.

    Contraction: each node points to its least neighbour, chains are shortened by pointer
    doubling, and the edges are rewritten between roots until none is left. Vertices at least
    halve each round. Every step is a partial aggregate or an equi-join, so a hub is combined
    map-side or split by adaptive execution; nothing is collected.
    """
    live = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "cc-edges")
    label, done = None, []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jump = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "cc-parent")
        while True:
            up = jump.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            longer = stage(jump.join(up, F.col("root") == F.col("mid")).select("node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "cc-jump")
            unstage(jump)
            jump = longer
            if longer.where("moved").isEmpty():
                break
        done.append(jump)
        flat = jump.select("node", "root")
        if label is None:
            label = flat
        else:
            up = flat.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            label = label.join(up, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root"))
        pa_, pb_ = flat.select(F.col("node").alias("a"), F.col("root").alias("ra")), flat.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        old = live
        live = stage(live.join(pa_, "a").join(pb_, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        unstage(old)
    unstage(live)
    if label is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    label = stage(label, "cc-labels")
    unstage(*done)
    return label
