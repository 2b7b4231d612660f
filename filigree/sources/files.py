"""Graph, point and embedding files. Single-file formats go through Spark's file systems, so their paths may be remote."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.operators.state import counted, discard, written

def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """edges of a coordinate file (1-based row, column, value; % starts a comment), or of a folder of files that follow one
    another by name. Repeated entries are summed."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("k")
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(place, F.split(F.trim("value"), r"\s+").alias("f"))
    head = lines.agg(F.min("k").alias("head"))
    rows = lines.join(F.broadcast(head)).where("k <> head")  # one row
    return rows.select((F.col("f")[1].cast("long") - 1).alias("src"), (F.col("f")[0].cast("long") - 1).alias("dst"), F.col("f")[2].cast("double").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def write_matrix_market(edges: DataFrame, path: str, n: int) -> None:
    """A folder of files that follow one another by name: the header, and the entries in column order. Each is a range
    of columns and rows, so no task holds more than its share."""
    rows = written(edges.select("src", "dst", "w"), "entries")  # counted as they are made, and not made again for the ranges
    head = edges.sparkSession.createDataFrame([(-1, -1, f"{n} {n} {counted(rows)}")], "src long, dst long, value string")
    body = rows.select("src", "dst", F.concat_ws(" ", F.col("dst") + 1, F.col("src") + 1, "w").alias("value"))
    head.unionByName(body).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("value").write.text(path)
    discard(rows)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """points of a text file: n d, then n d values by column, on any number of lines."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), words.alias("words")).withColumn("part", F.shiftright("line", 33))
    parts = lines.groupBy("part").agg(F.sum(F.size("words")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split of the file
    inside = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = lines.withColumn("own", F.coalesce(F.sum(F.size("words")).over(inside), F.lit(0))).join(F.broadcast(bases), "part")  # as many
    values = placed.select((F.col("base") + F.col("own")).alias("start"), F.posexplode("words").alias("k", "v")).select((F.col("start") + F.col("k") - 2).alias("at"), F.col("v").cast("double").alias("v"))
    n = values.where("at = -2").select(F.col("v").cast("long").alias("n"))
    rows = values.where("at >= 0").join(F.broadcast(n)).select((F.col("at") % F.col("n")).alias("id"), F.floor(F.col("at") / F.col("n")).alias("k"), "v")  # one row
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("x"))


def write_dense(points: DataFrame, path: str) -> None:
    """One file that read_dense() reads: a line for the sizes and one for each column. Points are taken in id order."""
    head = points.agg(F.concat_ws(" ", F.count("*"), F.max(F.size("x"))).alias("value")).select(F.lit(-1).alias("k"), "value")
    columns = points.select("id", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda r: r["v"].cast("string"))).alias("value"))
    head.unionByName(columns).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)


# --- binary files ----------------------------------------------------------------------------------------------------
def _put(spark: SparkSession, path: str, content: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for k in range(0, len(content), 1 << 20):
            out.write(bytearray(content[k : k + (1 << 20)]))
    finally:
        out.close()


def _rows(spark: SparkSession, path: str, start: int, n: int, d: int) -> DataFrame:
    """id and the d values of each of n rows of doubles that begin at a byte of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                values = np.frombuffer(raw.as_buffer(), "<f8", n * d, start)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values))], ["id", "x"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, x array<double>")


def _bytes(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", start + 1, size).alias("b")).first().b)


def _size(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select("length").first().length


def read_problem(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A binary problem of at most 2 GB: n, d, theta, perplexity, dims, max_iter and seed (or None), and its points."""
    names = ("n", "d", "theta", "perplexity", "dims", "max_iter")
    head = dict(zip(names, struct.unpack("<iiddii", _bytes(spark, path, 0, 32)), strict=True))
    end = 32 + 8 * head["n"] * head["d"]
    head["seed"] = struct.unpack("<i", _bytes(spark, path, end, 4))[0] if _size(spark, path) >= end + 4 else None
    return head, _rows(spark, path, 32, head["n"], head["d"])


def write_problem(spark: SparkSession, x: np.ndarray, path: str, theta: float = 0.5, perplexity: float = 30.0, dims: int = 2, max_iter: int = 1000, seed: int | None = None) -> None:
    head = struct.pack("<iiddii", *x.shape, theta, perplexity, dims, max_iter)
    _put(spark, path, head + x.astype("<f8").tobytes() + (b"" if seed is None else struct.pack("<i", seed)))


def write_result(spark: SparkSession, y: np.ndarray, path: str) -> None:
    """n, d, coordinates, identity landmarks and zero costs."""
    n, d = y.shape
    _put(spark, path, struct.pack("<ii", n, d) + y.astype("<f8").tobytes() + np.arange(n, dtype="<i4").tobytes() + np.zeros(n, "<f8").tobytes())


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """id, landmark, cost and coordinates of a result file."""
    n, d = struct.unpack("<ii", _bytes(spark, path, 0, 8))
    marks = np.frombuffer(_bytes(spark, path, 8 + 8 * n * d, 4 * n), "<i4")
    costs = _rows(spark, path, 8 + 8 * n * d + 4 * n, n, 1).select("id", F.col("x")[0].alias("cost"))
    landmarks = spark.createDataFrame([(k, int(v)) for k, v in enumerate(marks)], "id long, landmark int")
    return _coordinates(_rows(spark, path, 8, n, d), d).join(landmarks, "id").join(costs, "id")


def _coordinates(rows: DataFrame, d: int) -> DataFrame:
    return rows.select("id", *[F.col("x")[k].alias(f"y{k}") for k in range(d)])


def write_binary(spark: SparkSession, y: np.ndarray, path: str) -> None:
    _put(spark, path, y.astype("<f8").tobytes())


def read_binary(spark: SparkSession, path: str, d: int) -> DataFrame:
    """id and coordinates of a file of doubles by row."""
    return _coordinates(_rows(spark, path, 0, _size(spark, path) // (8 * d), d), d)


def write_text(coords: DataFrame, path: str) -> None:
    """Coordinates in id order, blank-separated."""
    columns = [c for c in ("y0", "y1", "y2") if c in coords.columns]
    coords.orderBy("id").select(F.concat(F.concat_ws(" ", *columns), F.lit(" ")).alias("value")).coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str, d: int) -> DataFrame:
    """id (the line's number) and coordinates of one file that write_text() has written."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("x")).withColumn("part", F.shiftright("line", 33))
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split of the file
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids = (F.col("base") + F.col("line").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")
    return lines.join(F.broadcast(bases), "part").select(ids, *[F.col("x")[k].cast("double").alias(f"y{k}") for k in range(d)])  # as many


def ordered(coords: DataFrame) -> np.ndarray:
    """Coordinates in id order on the driver, for the single-file writers."""
    columns = [c for c in ("y0", "y1", "y2") if c in coords.columns]
    return coords.orderBy("id").select(*columns).toPandas().to_numpy()


# --- MATLAB files (level 5) ------------------------------------------------------------------------------------------
#: The element types of the format.
_MAT_TYPES = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
_MATRIX, _COMPRESSED = 14, 15


def _elements(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and content of the data elements in raw."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # a small one: its size is in the type's upper half, its content in the tag
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != _COMPRESSED else 0)


def mat_arrays(raw: bytes) -> dict[str, np.ndarray]:
    """The full numeric arrays of a level 5 file, by name."""
    out = {}
    for kind, body in _elements(raw[128:]):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body)))
        if kind != _MATRIX or not body:
            continue
        (_, flags), (_, dims), (_, name), *rest = _elements(body)
        if 6 <= flags[0] <= 15 and rest:  # double to uint64
            values = np.frombuffer(rest[0][1], _MAT_TYPES[rest[0][0]])
            out[name.decode()] = values.astype(float).reshape(np.frombuffer(dims, "<i4"), order="F")
    return out


def mat_file(arrays: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    """A level 5 file of arrays of doubles."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, x in arrays.items():
        parts = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(x.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, x.astype("<f8").tobytes(order="F"))
        own = element(_MATRIX, parts)
        packed = zlib.compress(own)
        out += struct.pack("<II", _COMPRESSED, len(packed)) + packed if compressed else own
    return out


#: Bytes of an empty matrix: behind a file's others it changes nothing, and it ends in a zero byte.
_LAST = struct.pack("<II", _MATRIX, 0)


def write_files(bodies: DataFrame, path: str) -> None:
    """A folder with a file for each row of bodies(body), MATLAB files of a bounded size, written by the tasks that made them. The
    text source puts a line's end behind a row: it is the last byte of an empty matrix."""
    ended = F.concat("body", F.lit(_LAST[:-1])).cast("string")
    bodies.select(ended.alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def sliced(batches: Iterator[pa.RecordBatch], size: int, key: str | None = None) -> Iterator[pa.Table]:
    """Rows that come in order as tables of about that many; those of one key stay together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            table = pa.Table.from_batches(held)
            end = size
            if key:
                own = table.column(key).to_numpy()
                end = int(np.searchsorted(own, own[size - 1], "right" if own[0] == own[size - 1] else "left"))
                if end == n:  # the rest of the key can still come
                    break
            yield table.slice(0, end)
            held, n = table.slice(end).to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held)


#: Rows of neighbours of one file.
SLICE = 1 << 17


def write_mat_neighbours(knn: DataFrame, path: str, index: str = "IDX", distance: str = "D", size: int = SLICE) -> None:
    """knn(src, dst, rank, d), as many for each src, as a folder of MATLAB files, each with the 1-based neighbours, the distances
    and the 1-based numbers (ID) of a range of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sliced(batches, size, "src"):
            src, dst, d = (table.column(c).to_numpy() for c in ("src", "dst", "d"))
            ids = np.unique(src)
            yield pa.RecordBatch.from_arrays([pa.array([mat_file({index: dst.reshape(len(ids), -1) + 1.0, distance: d.reshape(len(ids), -1), "ID": ids[:, None] + 1.0})], pa.binary())], ["body"])

    write_files(knn.select("src", "rank", "dst", "d").repartitionByRange("src").sortWithinPartitions("src", "rank").mapInArrow(run, "body binary"), path)


def read_mat_neighbours(spark: SparkSession, path: str, index: str = "IDX", distance: str = "D") -> DataFrame:
    """src, dst, rank and d of the 1-based neighbour indices and the distances (a row for each point) in a MATLAB file, or in
    those of a folder, whose points ID tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                found = mat_arrays(raw.as_py())
                idx, d = found[index], found[distance]
                n, k = idx.shape
                own = found["ID"].ravel().astype(np.int64) - 1 if "ID" in found else np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)), pa.array(idx.ravel().astype(np.int64) - 1), pa.array(np.tile(np.arange(k), n)), pa.array(d.ravel())], ["src", "dst", "rank", "d"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long, rank long, d double")


def write_mat(spark: SparkSession, arrays: dict[str, np.ndarray], path: str, compressed: bool = True) -> None:
    _put(spark, path, mat_file(arrays, compressed))


# --- timings ---------------------------------------------------------------------------------------------------------
def write_timings(spark: SparkSession, rows: list[tuple[str, float]], path: str) -> None:
    """One CSV file of names and seconds."""
    _put(spark, path, "".join(f"{x}\n" for x in ["name,seconds", *(f"{n},{s:.6f}" for n, s in rows)]).encode())
