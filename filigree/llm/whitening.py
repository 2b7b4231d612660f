"""Whitening of embeddings by principal components, in two passes over whole numbers.

An entry c becomes floor(64 c) + 1000000, a whole number, so sums do not depend on the order of rows. The fit list holds each
distinct vector once. Pass one adds up its entries exactly (Python's whole numbers hold any size) to n and S; pass two
adds up, batch by batch, the outer products of n x - S, which is exact, over n, by matrix products. Both are merged by
treeAggregate, so the driver gets a few partial results, each as large as the square of the dimension, whatever the
number of rows. LAPACK's symmetric solver gives the components, which are sent to all tasks (dimension times components
numbers).

A row whose vector is null or holds a null or an entry that is not finite has no result; neither has one whose vector's
length is 0 or not the commonest of the fit list (of equally common ones, the greatest). Repeated rows give repeated results,
and rows without a vec_id results without one; an empty table gives none. A component along which nothing varies
(eigenvalue below 1e-13 of the greatest) has no whitened value (null), and does not count in the identity error.
Deviations that do not fit into 64 bits are null. Entries are finite and below 2 ** 56 in size; greater ones do not fit into
64 bits and are treated as not finite. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

SCALE, SHIFT = 64, 1_000_000
#: Entries from this size on are not taken: their whole numbers do not fit into 64 bits.
MOST = 2.0**56
COMPONENTS = 16
#: Share of the greatest eigenvalue below which a component is one along which nothing varies.
FLAT = 1e-13


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of rows with a vector, the sizes and starts of these, and all entries as whole numbers."""
    lists = column.cast(pa.large_list(pa.float64()))
    flat = lists.values
    at = lists.offsets.to_numpy()
    entries = flat.to_numpy(zero_copy_only=False)  # nulls become not a number
    good = np.abs(entries) < MOST
    bad = np.concatenate([[0], np.cumsum(~good)])
    there = np.ones(len(lists), bool) if not lists.null_count else lists.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(there & (bad[at[1:]] == bad[at[:-1]]) & (at[1:] > at[:-1]))
    x = np.floor(SCALE * np.where(good, entries, 0.0)).astype(np.int64)
    return rows, (at[1:] - at[:-1])[rows], at[:-1][rows], x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: 4 an entry where all entries fit, else 8, so equal vectors have equal bytes."""
    for batch in batches:
        rows, sizes, starts, x = whole_vectors(batch.column("v"))
        small = (x == x.astype(np.int32)).astype(np.int64)
        fits = np.concatenate([[0], np.cumsum(small)])
        out = [x[a : a + n].astype("<i4" if fits[a + n] - fits[a] == n else "<i8").tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["size", "x"])


def fit_list(rows: DataFrame, column: str) -> DataFrame:
    """size and x of each distinct vector, written. Copies are dropped before they are shuffled."""
    return written(arrow_map(rows.select(F.col(column).alias("v")), _packed, "size int, x binary").distinct(), "vectors")


def _unpacked(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of a size, without the shift."""
    own = batch.column("x").to_pylist() if batch.num_rows else []
    narrow = [x for x in own if len(x) == 4 * size]
    wide = [x for x in own if len(x) == 8 * size]
    parts = [np.frombuffer(b"".join(group), kind).reshape(-1, size).astype(np.int64) for group, kind in ((narrow, "<i4"), (wide, "<i8"))]
    return np.concatenate(parts)


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By size, the number of vectors and the exact sums of their entries, without the shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                x = _unpacked(batch.filter(pa.array(sizes == size)), size)
                high = (x >> 32).sum(0).tolist()
                low = (x & 0xFFFFFFFF).sum(0).tolist()
                _add_totals(found, {size: (len(x), [(a << 32) + b for a, b in zip(high, low, strict=True)])})
        for size, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([",".join(map(str, sums))])], ["size", "n", "sums"])

    rows = arrow_map(fit, run, "size int, n long, sums string").rdd
    return rows.treeAggregate({}, lambda a, r: _add_totals(a, {r.size: (r.n, [int(v) for v in r.sums.split(",")])}), _add_totals)


def _add_totals(one: dict, two: dict) -> dict:
    for size, (n, sums) in two.items():
        if size in one:
            m, had = one[size]
            n, sums = n + m, [a + b for a, b in zip(had, sums, strict=True)]
        one[size] = (n, sums)
    return one


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly, as 64-bit numbers where these hold it, else as Python's."""
    most = int(np.abs(x).max()) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(moved: np.ndarray) -> pa.Array:
    """The sum of the squares of each row, null where 64 bits do not hold it."""
    if moved.size and (moved.dtype == object or float(np.abs(moved).max()) ** 2 * moved.shape[1] >= 2.0**62):
        out = [sum(int(v) ** 2 for v in row) for row in moved.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in out], pa.int64())
    return pa.array((moved * moved).sum(1), pa.int64())


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list (without the shift), its components (columns), their eigenvalues, the trace, and the largest
    entry by which the whitened fit list's covariance differs from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def steep(self) -> np.ndarray:
        return self.values > FLAT * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        """Rows of n x - S projected on the components, over the roots of their eigenvalues; not a number along flat ones."""
        e = np.where(self.steep, self.values, np.nan)
        return (moved.astype(float) / self.n) @ self.components / np.sqrt(e)


def _second_moment(fit: DataFrame, size: int, width: int, step) -> tuple[np.ndarray, np.ndarray]:
    """The sums of step(vectors), rows of a width, and of their outer products, over the vectors of a size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + width, width))
        for batch in batches:
            rows = step(_unpacked(batch, size))
            total[0] += rows.sum(0)
            total[1:] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = arrow_map(fit.where(F.col("size") == size).select("x"), run, "total binary").rdd
    zero = np.zeros((1 + width, width))
    total = parts.treeAggregate(zero, lambda a, r: a + np.frombuffer(r.total).reshape(zero.shape), np.add)
    return total[0], total[1:]


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, check: bool = True) -> Whitening | None:
    """The whitening of the distinct vectors of rows, or None where there is none. Without check, the identity error (a third
    pass over the fit list) is not measured."""
    vectors = fit_list(rows, column)
    totals = _totals(vectors)
    if not totals:
        return None
    size = max(totals, key=lambda k: (totals[k][0], k))
    n, sums = totals[size]
    _, products = _second_moment(vectors, size, size, lambda x: centred(x, n, sums).astype(float) / n)
    covariance = products / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    found = Whitening(n, sums, axes[:, order], np.maximum(values[order], 0.0), float(np.trace(covariance)))
    if not check or not found.steep.any():
        return found
    steep = found.steep
    first, second = _second_moment(vectors, size, int(steep.sum()), lambda x: found.whitened(centred(x, n, sums))[:, steep])
    error = second / n - np.outer(first / n, first / n) - np.eye(int(steep.sum()))
    return Whitening(n, sums, found.components, found.values, found.trace, float(np.abs(error).max()))


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error: a row for each row of rows with a vector
    and each of its components."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(rows, column, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        explained = own.values / own.trace if own.trace > 0 else np.zeros(k)
        for batch in batches:
            places, sizes, starts, x = whole_vectors(batch.column("v"))
            of_size = sizes == own.size
            places, starts = places[of_size], starts[of_size]
            moved = centred(x[starts[:, None] + np.arange(own.size)], own.n, own.sums)
            values = own.whitened(moved)
            again = np.repeat(np.arange(len(places)), k)
            each = np.tile(np.arange(k), len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(places[again])), pa.array(each + 1, pa.int32()), pa.array(np.full(len(again), own.n), pa.int64()), deviations(moved).take(pa.array(again)), pa.array(values.ravel(), pa.float64(), from_pandas=True), pa.array(explained[each]), pa.array(np.full(len(again), own.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow_map(rows.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")), run, schema)
