"""Least squares: triangular factors of tall dense matrices by a tree, and conjugate gradients for sparse ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import linalg
from filigree.operators.state import discard, written

#: Rows that are reduced to one factor at once.
ROWS = 1 << 14


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of some rows, with no negative diagonal; fewer rows than columns are filled up with zeros."""
    d = rows.shape[1]
    r = np.linalg.qr(np.concatenate([rows, np.zeros((max(0, d - len(rows)), d))]), mode="r")
    return np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] * r


def tall_factor(points: DataFrame, column: str = "x") -> np.ndarray | None:
    """R of the matrix with a row for each vector of points, all of one length, or None without any. Factors of batches of rows
    are stacked and factored again, up a tree, so the driver gets a few of them whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                for k in range(0, len(x), ROWS):
                    r = _factor(x[k : k + ROWS] if r is None else np.concatenate([r, x[k : k + ROWS]]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    parts = points.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "r binary").rdd

    def opened(body: bytes) -> np.ndarray:
        flat = np.frombuffer(body)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    def merged(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return b if a is None else a if b is None else _factor(np.concatenate([a, b]))

    return parts.treeAggregate(None, lambda a, row: merged(a, opened(row.r)), merged)


def fit_dense(points: DataFrame, target: str = "y", column: str = "x") -> np.ndarray:
    """The coefficients c that make the sum of (y - x c)^2 least, by R of x with y as a last column; rows with a null are left out.
    Where the vectors do not span all directions it is the shortest of the best."""
    rows = points.where(F.col(target).isNotNull() & F.col(column).isNotNull())
    r = tall_factor(rows.select(F.concat(F.col(column).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("x")))
    return np.zeros(0) if r is None else np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=None)[0]


def fit_sparse(edges: DataFrame, b: DataFrame, tolerance: float = 1e-10, steps: int = 1000) -> DataFrame:
    """x(id, x) for the columns of A, edges(src column, dst row, w), that makes |A x - b| least for b(id, x) over the rows, written.
    Conjugate gradients on the normal equations: each step is one product with A and one with its transpose, and it ends where
    |A'(b - A x)| has fallen to tolerance times its start. Of several best x it is the shortest."""
    edges = written(linalg.add(edges, edges.limit(0)), "matrix")
    rows = written(b.groupBy("id").agg(F.sum("x").alias("r")), "rows")
    back = linalg.spmv_t(edges, rows.select("id", F.col("r").alias("x")))
    columns = edges.select(F.col("src").alias("id")).distinct().join(back.withColumnRenamed("x", "s"), "id", "left")
    columns = written(columns.select("id", F.lit(0.0).alias("x"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("s", F.lit(0.0)).alias("p")), "columns")
    square = lambda table, c: table.agg(F.sum(F.col(c) * F.col(c))).first()[0] or 0.0
    first = now = square(columns, "s")
    for _ in range(steps):
        if now <= tolerance**2 * first or not now:
            break
        q = written(linalg.spmv(edges, columns.select("id", F.col("p").alias("x"))).withColumnRenamed("x", "q"), "product")
        length = square(q, "q")
        if not length:
            discard(q)
            break
        alpha = now / length
        last_rows = rows
        rows = written(rows.join(q, "id", "full").select("id", (F.coalesce("r", F.lit(0.0)) - alpha * F.coalesce("q", F.lit(0.0))).alias("r")), "rows")
        s = linalg.spmv_t(edges, rows.select("id", F.col("r").alias("x"))).withColumnRenamed("x", "n")
        moved = columns.join(s, "id", "left").select("id", (F.col("x") + alpha * F.col("p")).alias("x"), F.coalesce("n", F.lit(0.0)).alias("s"), "p")
        moved = written(moved, "moved")
        before, now = now, square(moved, "s")
        last = columns
        columns = written(moved.withColumn("p", F.col("s") + now / before * F.col("p")), "columns")
        discard(q, last_rows, last, moved)
    out = written(columns.select("id", "x"), "solution")
    discard(edges, rows, columns)
    return out
