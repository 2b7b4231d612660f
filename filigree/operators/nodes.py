"""All pairs of points to the last digits, at a cost that grows with their number.

1 / (1 + r ** 2) and its square have no pole nearer than 1 to the real line, so inside boxes of side SIDE interpolation in ORDER
Chebyshev nodes a dimension is as good as double precision (an error of some 8.1 ** -ORDER, under 1e-16), for boxes that are near or the
same too. Points become weights on their boxes' nodes, nodes meet all nodes, and points take their sums from the nodes of their
box: no pair is left out, and no point meets another by itself. It is for extents that few boxes fill; others are for
forces.repulse_exact().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a box, its nodes in a dimension, and nodes of all boxes at most: those meet on the driver, which takes seconds.
SIDE, ORDER, MOST_NODES = 0.5, 18, 1 << 16
#: Points whose weights are held at once.
POINTS = 1 << 11

_NODES = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_TO_NODES = np.polynomial.chebyshev.chebvander(_NODES, ORDER - 1).T * np.where(np.arange(ORDER) == 0, 1, 2)[:, None] / ORDER


def boxes_of(coords: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Least coordinates, boxes in each dimension and number of points, where these are more than two for each node."""
    names = [f"y{k}" for k in range(d)]
    seen = coords.agg(*[f(F.col(c).cast("double")) for f in (F.min, F.max, F.count) for c in names], F.count("*")).first()
    low, high, known, n = seen[:d], seen[d : 2 * d], seen[2 * d : 3 * d], seen[-1]
    if not n or any(k < n for k in known) or not np.isfinite([*low, *high]).all():
        return None
    wide = np.floor((np.array(high) - low) / SIDE) + 1
    nodes = wide.prod() * ORDER**d
    return (np.array(low), wide.astype(int), n) if nodes <= MOST_NODES and n > 2 * nodes else None


def _weights(y: np.ndarray, low: np.ndarray, wide: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Boxes, their rows of y, and the weights of these on the box's nodes."""
    at = np.clip(np.floor((y - low) / SIDE).astype(int), 0, wide - 1)
    box = np.ravel_multi_index(at.T, wide)
    order = np.argsort(box, kind="stable")
    own, starts = np.unique(box[order], return_index=True)
    for b, rows in zip(own.tolist(), np.split(order, starts[1:]), strict=True):
        for k in range(0, len(rows), POINTS):
            some = rows[k : k + POINTS]
            t = (y[some] - low - at[some] * SIDE) * (2 / SIDE) - 1
            w = np.ones((len(some), 1))
            for m in range(y.shape[1]):
                w = (w[:, :, None] * (np.polynomial.chebyshev.chebvander(t[:, m], ORDER - 1) @ _TO_NODES)[:, None, :]).reshape(len(some), -1)
            yield b, some, w


def met(weights: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """For each node of each box the sums over all nodes of their weight times q and times q^2 (y - x)."""
    d, size = len(wide), ORDER ** len(wide)
    own = np.stack([a.ravel() for a in np.meshgrid(*[_NODES * SIDE / 2] * d, indexing="ij")], 1)
    boxes = np.stack(np.unravel_index(np.arange(len(weights)), wide), 1)
    full = weights.any(1)
    out = np.zeros((len(weights), size, d + 1))
    for shift in np.ndindex(*(2 * wide - 1)):
        away = np.array(shift) - (wide - 1)
        to = boxes + away
        there = ((to >= 0) & (to < wide)).all(1) & full
        if not there.any():
            continue
        target = np.ravel_multi_index(to[there].T, wide)
        diff = own[:, None, :] + away * SIDE - own[None, :, :]
        q = 1 / (1 + (diff * diff).sum(2))
        from_ = weights[there].T
        out[target, :, 0] += (q @ from_).T
        q *= q
        for k in range(d):
            out[target, :, k + 1] += ((q * diff[:, :, k]) @ from_).T
    return out


def repulse(coords: DataFrame, low: np.ndarray, wide: np.ndarray, n: int) -> DataFrame:
    """forces.repulse_exact() of coords in the boxes of boxes_of()."""
    d, size = len(wide), ORDER ** len(wide)
    names = [f"y{k}" for k in range(d)]
    rows = coords.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in names])

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy() for c in names], 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for b, _, w in _weights(read(batch), low, wide):
                    total[b] = total.get(b, 0) + w.sum(0)
        for b, w in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(b * size + np.arange(size)), pa.array(w)], ["node", "w"])

    weights = np.zeros((int(wide.prod()), size))
    for node, w in rows.mapInArrow(scatter, "node long, w double").groupBy("node").agg(F.sum("w")).collect():  # at most MOST_NODES
        weights.flat[node] = w
    sums = met(weights, wide)
    zeta = float((weights * sums[:, :, 0]).sum()) - n  # each point met itself

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                force = np.empty((batch.num_rows, d))
                for b, some, w in _weights(read(batch), low, wide):
                    force[some] = w @ sums[b, :, 1:]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(force[:, k] / zeta) for k in range(d))], ["id", *(f"f{k}" for k in range(d))])

    found = rows.mapInArrow(gather, "id long, " + ", ".join(f"f{k} double" for k in range(d)))
    return found.select("*", F.lit(zeta).alias("zeta"))
