"""Sparse matrices of MATLAB files (level 5), by ranges of bytes.

The driver walks the tags of the file's elements, in cells and structures too, and reads a few bytes of each: names, sizes and
where the row indices, column starts and values of a sparse matrix lie. The file is then read as records of a fixed
length, which Spark splits among tasks as it splits a text file, so no worker holds more than a record, however large the
matrix; its entries meet by their number. Elements that are compressed have no such ranges: they are unpacked whole, in one
worker.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.sources.files import _COMPRESSED, _MAT_TYPES, _MATRIX, _elements, mat_arrays, mat_file, sliced, write_files

#: Classes of arrays in the format.
_CELL, _STRUCT, _SPARSE = 1, 2, 5
#: Bytes of a record at most.
RECORD = 1 << 16


@dataclass(frozen=True)
class Sparse:
    """Rows, columns, and type, first byte and size of the row indices, column starts and values of a sparse matrix."""

    shape: tuple[int, int]
    rows: tuple[int, int, int]
    starts: tuple[int, int, int]
    values: tuple[int, int, int]


Read = Callable[[int, int], bytes]


def _tag(read: Read, at: int) -> tuple[int, int, int, int]:
    """Type, first byte, size of an element's content, and where the next one begins."""
    kind, size = struct.unpack("<II", read(at, 8))
    if kind >> 16:
        return kind & 0xFFFF, at + 4, kind >> 16, at + 8
    return kind, at + 8, size, at + 8 + size + (-size % 8 if kind != _COMPRESSED else 0)


def sparse_arrays(read: Read, at: int, end: int, prefix: str = "") -> dict[str, Sparse]:
    """The sparse matrices among the elements from a byte to another, by name; those in a cell as name{k}, k from 1 by columns,
    those in a structure as name.field, or name(k).field where it has several."""
    out: dict[str, Sparse] = {}
    while at + 8 <= end:
        kind, body, size, at = _tag(read, at)
        if kind == _MATRIX and size:
            out |= _matrix(read, body, body + size, prefix)
    return out


def _matrix(read: Read, at: int, end: int, name: str) -> dict[str, Sparse]:
    parts = []
    for _ in range(3):
        kind, body, size, at = _tag(read, at)
        parts.append(read(body, size))
    kind_of = parts[0][0]
    dims = np.frombuffer(parts[1], "<i4").tolist()
    name = name or parts[2].decode()
    if kind_of == _SPARSE:
        three = []
        for _ in range(3):
            kind, body, size, at = _tag(read, at)
            three.append((kind, body, size))
        return {name: Sparse((dims[0], dims[1]), *three)}
    out: dict[str, Sparse] = {}
    count = int(np.prod(dims))
    fields = [""]
    if kind_of == _STRUCT:
        _, body, size, at = _tag(read, at)
        width = int.from_bytes(read(body, size), "little")
        _, body, size, at = _tag(read, at)
        raw = read(body, size)
        fields = [raw[k : k + width].split(b"\0")[0].decode() for k in range(0, size, width)]
    if kind_of in (_CELL, _STRUCT):
        for k in range(count):
            for field in fields:
                _, body, size, after = _tag(read, at)
                inner = f"{name}{{{k + 1}}}" if kind_of == _CELL else f"{name}.{field}" if count == 1 else f"{name}({k + 1}).{field}"
                if size:
                    out |= _matrix(read, body, body + size, inner)
                at = after
    return out


def _opened(spark: SparkSession, path: str) -> tuple[Read, int]:
    """A reader of a few bytes of a file, by Spark's file systems, and the file's size."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.open(where)

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    return read, system.getFileStatus(where).getLen()


def _record(size: int) -> int:
    """The greatest record of whole eights, at most RECORD bytes, that a file consists of."""
    return next((n for n in range(min(RECORD, size) // 8 * 8, 0, -8) if size % n == 0), 0)


def read_mat_sparse(spark: SparkSession, path: str, name: str) -> DataFrame:
    """edges(src column, dst row, w) of a sparse matrix, ids from 0; ValueError where a file without
    compressed elements has none of that name, else no rows. A folder holds slices that write_mat_sparse() has written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return _by_slices(spark, path, name)
    read, size = _opened(spark, path)
    found = sparse_arrays(read, 128, size)
    if name in found and (length := _record(size)):
        return _by_records(spark, path, found[name], length)
    packed = spark.read.format("binaryFile").load(path).select("content")
    names = sorted(found)
    if not any(_tag(read, at)[0] == _COMPRESSED for at in _tops(read, size)):
        raise ValueError(f"no sparse matrix {name} in {path}, but {', '.join(names) or 'none'}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                for kind, body in _elements(raw.as_py()[128:]):
                    whole = zlib.decompress(body) if kind == _COMPRESSED else struct.pack("<II", kind, len(body)) + body
                    own = sparse_arrays(lambda at, n, whole=whole: whole[at : at + n], 0, len(whole)).get(name)
                    if own:
                        rows, starts, values = (np.frombuffer(whole[at : at + n], _MAT_TYPES[k]) for k, at, n in (own.rows, own.starts, own.values))
                        n = int(starts[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(own.shape[1]), np.diff(starts))), pa.array(rows[:n].astype(np.int64)), pa.array(values[:n].astype(float))], ["src", "dst", "w"])

    return packed.mapInArrow(run, "src long, dst long, w double")


def _tops(read: Read, size: int) -> Iterator[int]:
    at = 128
    while at + 8 <= size:
        yield at
        at = _tag(read, at)[3]


def _by_records(spark: SparkSession, path: str, own: Sparse, length: int) -> DataFrame:
    ranges = (own.rows, own.starts, own.values)
    records = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda r: (r[1] * length, bytes(r[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column("at").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for part, (kind, at, size) in enumerate(ranges):
                    low, high = max(first, at), min(first + len(raw), at + size)
                    if low < high:
                        v = np.frombuffer(raw[low - first : high - first], _MAT_TYPES[kind])
                        k = (low - at) // v.itemsize + np.arange(len(v))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), part, np.int32)), pa.array(k), pa.array(v.astype(float))], ["part", "k", "v"])

    rows = spark.createDataFrame(records, "at long, body binary").mapInArrow(run, "part int, k long, v double")
    of = lambda part, value, kind: rows.where(F.col("part") == part).select("k", F.col("v").cast(kind).alias(value))
    starts = of(1, "low", "long")
    spans = starts.join(starts.select((F.col("k") - 1).alias("k"), F.col("low").alias("high")), "k").where("high > low")
    columns = spans.select(F.col("k").alias("src"), F.explode(F.expr("sequence(low, high - 1)")).alias("k"))  # an array only in the generator
    return columns.join(of(0, "dst", "long"), "k").join(of(2, "w", "double"), "k").select("src", "dst", "w")


def _by_slices(spark: SparkSession, path: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                own = sparse_arrays(lambda at, n, raw=raw: raw[at : at + n], 128, len(raw)).get(name)
                if own is None:
                    raise ValueError(f"no sparse matrix {name} in a slice of {path}")
                rows, starts, values = (np.frombuffer(raw[at : at + n], _MAT_TYPES[k]) for k, at, n in (own.rows, own.starts, own.values))
                first, n = int(mat_arrays(raw)["first"].item()) - 1, int(starts[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(own.shape[1]), np.diff(starts)) + first), pa.array(rows[:n].astype(np.int64)), pa.array(values[:n].astype(float))], ["src", "dst", "w"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long, w double")


#: Entries of a slice, and columns that it may span.
SLICE, SPAN = 1 << 18, 1 << 20


def write_mat_sparse(edges: DataFrame, path: str, name: str, size: int = SLICE) -> None:
    """Distinct edges(src column, dst row, w) as a folder of MATLAB files, since one holds no array beyond 2 GB: each has some of the
    columns, in order, as a sparse matrix, name or structure.name, and the 1-based number of its first column (first)."""
    rows = (edges.agg(F.max("dst").alias("most")).first().most or 0) + 1
    outer, _, inner = name.rpartition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sliced(batches, size):
            src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
            for at in np.split(np.arange(len(src)), np.flatnonzero(np.diff((src - src[0]) // SPAN)) + 1):
                first = int(src[at[0]])
                own = sparse_element("" if outer else inner, (rows, int(src[at[-1]]) - first + 1), src[at] - first, dst[at], w[at])
                head = mat_file({"first": np.array([[first + 1.0]])}, False)
                yield pa.RecordBatch.from_arrays([pa.array([head + (container_element(outer, {inner: own}) if outer else own)], pa.binary())], ["body"])

    write_files(edges.select("src", "dst", F.col("w").cast("double").alias("w")).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(run, "body binary"), path)


# --- writing, for small matrices -----------------------------------------------------------------------------------
def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def sparse_element(name: str, shape: tuple[int, int], columns: np.ndarray, rows: np.ndarray, values: np.ndarray) -> bytes:
    """A sparse matrix as an element, from its entries by columns, then rows."""
    starts = np.searchsorted(columns, np.arange(shape[1] + 1)).astype("<i4")
    head = _element(6, struct.pack("<II", _SPARSE, max(1, len(rows)))) + _element(5, np.array(shape, "<i4").tobytes()) + _element(1, name.encode())
    return _element(_MATRIX, head + _element(5, rows.astype("<i4").tobytes()) + _element(5, starts.tobytes()) + _element(9, values.astype("<f8").tobytes()))


def container_element(name: str, members: dict[str, bytes] | list[bytes]) -> bytes:
    """A cell of elements, or a structure of named ones."""
    inside = list(members.values()) if isinstance(members, dict) else members
    shape = (1, 1) if isinstance(members, dict) else (1, len(inside))
    head = _element(6, struct.pack("<II", _STRUCT if isinstance(members, dict) else _CELL, 0)) + _element(5, np.array(shape, "<i4").tobytes()) + _element(1, name.encode())
    if isinstance(members, dict):
        head += struct.pack("<HHI", 5, 4, 32) + _element(1, b"".join(k.encode().ljust(32, b"\0") for k in members))
    return _element(_MATRIX, head + b"".join(inside))


def mat_of(elements: list[bytes], compressed: bool = False) -> bytes:
    """A file of elements."""
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for own in elements:
        packed = zlib.compress(own) if compressed else b""
        out += struct.pack("<II", _COMPRESSED, len(packed)) + packed if compressed else own
    return out
