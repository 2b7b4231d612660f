"""Shared plumbing of the corpus operators: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import mix

#: Rows of one Arrow batch, if they are narrow: a batch ends with BLOCK_BYTES, as one row may hold megabytes.
BATCH_ROWS = 1 << 15
#: Text bytes that a Python worker gathers before it works on them as one block.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only where that is unset and the master is local, where driver
    and executors are one process, it is set to a temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="filigree-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/filigree/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution that starts in here are removed when it is over, not when their plan is collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() returned and no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete every table that the operators have written in this application. Call it when their results are no longer needed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of a bounded number of bytes. The setting is the session's, and the same for all steps."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_small()
        yield from step(batches)
        give_back()

    return df.mapInArrow(run, schema)


#: Arrays from this size on are mapped and unmapped one by one, so that no freed one is kept. mallopt's numbers are fixed values.
MAPPED_BYTES = 1 << 22
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8


def keep_small() -> None:
    """Let this worker hold little memory that it does not use: neither Arrow nor the C library keeps freed arrays."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        library = ctypes.CDLL(None)
        for name, value in ((_ARENA_MAX, 1), (_MMAP_THRESHOLD, MAPPED_BYTES), (_TRIM_THRESHOLD, 2 * MAPPED_BYTES)):
            library.mallopt(name, value)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def in_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Gather Arrow batches until they hold limit bytes of column or that many rows; larger ones are cut between rows."""
    held, size, count = [], 0, 0
    for whole in batches:
        step = max(1, whole.num_rows * limit // max(limit, whole.column(column).nbytes))
        for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
            held.append(batch)
            size += batch.column(column).nbytes
            count += batch.num_rows
            if size >= limit or count >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) in one array, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


#: Ids of dropped documents are sent to every executor up to this many; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (one column), with all their columns. Texts are moved only if the ids
    are too many to be sent."""
    gone = written(ids.toDF("_gone").distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def summed(df: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, kind=np.uint64) -> np.ndarray:
    """The sum over all partitions of an array of fixed size that counts() makes of each, or, of kind bool, where it is not
    0. Chunks of it are added up in two rounds, so no task holds more than a few hundred chunks."""
    chunk = min(size, 1 << 14)

    def packed(part: np.ndarray) -> bytes:
        return part.astype("<u2" if part.max() < 1 << 16 else "<u8").tobytes()

    def unpacked(part: bytes) -> np.ndarray:
        return np.frombuffer(part, "<u2" if len(part) == 2 * chunk else "<u8")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(batches)
        for k in range(0, size, chunk):
            if (part := own[k : k + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), pa.array([packed(part)], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(chunk, "<u8")
        for x in table.column("counts").to_pylist():
            total += unpacked(x)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([packed(total)], pa.binary())})

    schema = "chunk int, counts binary"
    parts = arrow_map(df, local, schema)
    total = np.zeros(size, kind)
    for r in parts.groupBy("chunk", F.spark_partition_id() % 64).applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect():
        total[r.chunk * chunk : (r.chunk + 1) * chunk] = unpacked(r.counts)
    return total


#: Cells of a Bloom filter of ids: some sixteen for each id, within these bounds (16 KB to 8 MB as bits). A full one lets
#: everything pass, which is slower but right.
LEAST_CELLS, MOST_CELLS = 1 << 17, 1 << 26
#: Ids that one task puts into a filter.
FILTER_IDS = 2_000_000


def _cells(ids: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.int64).view(np.uint64))
    return (h & np.uint64(cells - 1)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) & (cells - 1)


def id_filter(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """A Bloom filter of a column of ids, as packed bits."""
    ids = ids.select(column).distinct()
    many = ids.count()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (16 * many).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(cells, np.uint8)
        for batch in batches:
            for at in _cells(numbers(batch.column(column).fill_null(0)), cells):
                total[at] = 1
        return total

    own = ids.repartition(-(-many // FILTER_IDS) or 1)
    return np.packbits(summed(own, count, cells, bool), bitorder="little")


def maybe_in(found: np.ndarray, ids: pa.Array) -> np.ndarray:
    a, b = _cells(numbers(ids.fill_null(0)), 8 * len(found))
    return ((found[a >> 3] >> (a & 7).astype(np.uint8)) & (found[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
