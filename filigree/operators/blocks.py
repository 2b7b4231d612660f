"""The grid of the repulsion by blocks of cells: scattering, gathering, and a convolution that no task holds whole.

A block is BLOCK cells a side. Points are dealt by block, and those of a block with many by hash over several groups, so no
group is larger than GROUP_POINTS whatever the crowding. A group adds its points up in a dense array of its block and the
three cells beyond it, and gives a row for each cell that it touched: borders of neighbouring blocks meet in a sum over
cells, and no point becomes 4 ** d rows.

The convolution takes planes of the grid: each is transformed along its own axes, what belongs together along the remaining one
is brought together chunk by chunk, transformed, multiplied with the kernel, which went the same way, and transformed back;
then the planes are put together again. Each of the 2 ** d half-shifted transforms of forces.convolve_fft() goes this way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block's side, and points of a group.
BLOCK, GROUP_POINTS = 32, 200_000
#: Bytes that a group of the convolution should hold.
CHUNK_BYTES = 1 << 27


def _block(d: int, block: int) -> Column:
    """A block's number from the cells c0 .. of a point."""
    return sum((F.floor(F.col(f"c{k}") / block).cast("long") * (1 << (16 * k)) for k in range(d)), F.lit(0).cast("long"))


def dealt(placed: DataFrame, d: int, block: int = BLOCK, group_points: int = GROUP_POINTS) -> DataFrame:
    """placed points with block and way: the group that each belongs to."""
    own = placed.withColumn("block", _block(d, block))
    ways = own.groupBy("block").agg(F.ceil(F.count("*") / group_points).alias("ways"))
    return own.join(ways, "block").withColumn("way", F.pmod(F.xxhash64(*[f"z{k}" for k in range(d)], "id"), F.col("ways"))).drop("ways")


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _weighted(table: pa.Table, d: int, smooth: bool, number: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the places of its 4 ** d cells in its block's array, and their weights."""
    from filigree.operators.forces import weights

    n, side = table.num_rows, block + 3
    total, place = np.ones((n, 1)), np.zeros((n, 1), np.int64)
    for k in range(d):
        first = ((number >> (16 * k)) & 0xFFFF) * block
        w = np.stack(weights(_array(table, f"t{k}"), smooth), 1)
        at = _array(table, f"c{k}").astype(np.int64) - first
        total = (total[:, :, None] * w[:, None, :]).reshape(n, -1)
        place = (place[:, :, None] * side + at[:, None, None] + np.arange(4)).reshape(n, -1)
    return place, total


def _cells_of(places: np.ndarray, d: int, number: int, block: int) -> list[np.ndarray]:
    own = np.unravel_index(places, [block + 3] * d)
    return [(own[k] + ((number >> (16 * k)) & 0xFFFF) * block).astype(np.int32) for k in range(d)]


#: Points that are weighted at once.
BATCH = 1 << 14


def scatter(points: DataFrame, d: int, smooth: bool = False, block: int = BLOCK) -> DataFrame:
    """Cells g0 .. with the charges 1, z0, .. of the dealt() points around them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, size = key[0].as_py(), (block + 3) ** d
        sums, touched = np.zeros((d + 1, size)), np.zeros(size, bool)
        for k in range(0, table.num_rows, BATCH):
            part = table.slice(k, BATCH)
            place, total = _weighted(part, d, smooth, number, block)
            for m in range(d + 1):
                charge = total if m == 0 else total * _array(part, f"z{m - 1}")[:, None]
                sums[m] += np.bincount(place.ravel(), charge.ravel(), size)
            touched[place.ravel()] = True
        own = np.flatnonzero(touched)
        arrays = [pa.array(c) for c in _cells_of(own, d, number, block)] + [pa.array(sums[m, own]) for m in range(d + 1)]
        return pa.Table.from_arrays(arrays, [*(f"g{k}" for k in range(d)), *(f"v{m}" for m in range(d + 1))])

    kind = ", ".join([f"g{k} int" for k in range(d)] + [f"v{m} double" for m in range(d + 1)])
    needed = points.select("block", "way", *[f"{c}{k}" for c in "czt" for k in range(d)])
    rows = needed.groupBy("block", "way").applyInArrow(run, kind)
    return rows.groupBy(*[f"g{k}" for k in range(d)]).agg(*[F.sum(f"v{m}").alias(f"v{m}") for m in range(d + 1)])


def gather(points: DataFrame, phi: DataFrame, d: int, smooth: bool = False, block: int = BLOCK) -> DataFrame:
    """id, z0 .. and the potentials phi0 .. at the dealt() points, from the cells g0 .. of a grid."""

    def run(key: tuple, own: pa.Table, cells: pa.Table) -> pa.Table:
        number, side = key[0].as_py(), block + 3
        place = np.zeros(cells.num_rows, np.int64)
        for k in range(d):
            place = place * side + _array(cells, f"g{k}") - ((number >> (16 * k)) & 0xFFFF) * block
        grid = np.zeros((d + 1, side**d))
        for m in range(d + 1):
            grid[m, place] = _array(cells, f"phi{m}")
        out = np.zeros((d + 1, own.num_rows))
        for k in range(0, own.num_rows, BATCH):
            at, total = _weighted(own.slice(k, BATCH), d, smooth, number, block)
            out[:, k : k + BATCH] = (grid[:, at] * total).sum(2)
        return pa.Table.from_arrays([own.column("id"), *(own.column(f"z{k}") for k in range(d)), *(pa.array(out[m]) for m in range(d + 1))], ["id", *(f"z{k}" for k in range(d)), *(f"phi{m}" for m in range(d + 1))])

    kind = ", ".join(["id long"] + [f"z{k} double" for k in range(d)] + [f"phi{m} double" for m in range(d + 1)])
    # a cell belongs to its own block, and to the one before it in each dimension where it is one of the three beyond that
    around = phi
    for k in range(d):
        one = F.floor(F.col(f"g{k}") / block).cast("long")
        both = F.when((F.col(f"g{k}") % block < 3) & (one > 0), F.array(one, one - 1)).otherwise(F.array(one))
        around = around.withColumn(f"b{k}", F.explode(both))
    number = sum((F.col(f"b{k}") * (1 << (16 * k)) for k in range(d)), F.lit(0).cast("long"))
    groups = points.select("block", "way").distinct().select(F.col("block").alias("to"), F.col("way").alias("by"))
    around = around.withColumn("to", number).join(groups, "to").select("to", "by", *[f"g{k}" for k in range(d)], *[f"phi{m}" for m in range(d + 1)])
    needed = points.select("block", "way", "id", *[f"{c}{k}" for c in "czt" for k in range(d)])
    return needed.groupBy("block", "way").cogroup(around.groupBy("to", "by")).applyInArrow(run, kind)


# --- convolution by planes ---------------------------------------------------------------------------------------
def _turns(odd: tuple[int, ...], n: int) -> list[np.ndarray]:
    """For each dimension the phases of a half-shifted transform, or ones."""
    return [np.exp(-1j * np.pi * o * np.arange(n) / n) for o in odd]


def _spread(x: np.ndarray, k: int, d: int) -> np.ndarray:
    return x.reshape([-1 if m == k else 1 for m in range(d)])


def _kernel_plane(x: int, odd: tuple[int, ...], n: int, h: float) -> np.ndarray:
    """The plane x of the kernel 1 / (1 + h^2 r^2)^2, its halves folded for a half-shifted transform."""
    d = len(odd)
    far = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)).astype(float) ** 2
    out = np.zeros([n] * (d - 1))
    for half in np.ndindex(*[2] * d):
        r2 = far[half[0] * n + x] + sum(_spread(far[half[k] * n : (half[k] + 1) * n], k - 1, d - 1) for k in range(1, d))
        out += (-1) ** sum(a & b for a, b in zip(odd, half, strict=True)) / (1 + h * h * r2) ** 2
    return out


def convolve_planes(grid: DataFrame, d: int, n: int, h: float, chunk_bytes: int | None = None) -> DataFrame:
    """The grid (d of 2 or 3, n + 2 cells a side) convolved as by forces.convolve_fft(): cells g0 .. with phi0 .."""
    side, axes = n + 2, tuple(range(1, d))
    line = (d + 2) * side * 16 * (side if d == 3 else 1)  # what one place of the second dimension takes, over all planes
    step = max(1, (CHUNK_BYTES if chunk_bytes is None else chunk_bytes) // line)
    odds = list(np.ndindex(*[2] * d))

    def forward(key: tuple, table: pa.Table) -> pa.Table:
        x = key[0].as_py()
        plane = np.zeros((d + 1, *[side] * (d - 1)))
        if table.num_rows:
            at = tuple(_array(table, f"g{k}") for k in range(1, d))
            for m in range(d + 1):
                plane[m][at] = _array(table, f"v{m}")
        rows = []
        for number, odd in enumerate(odds):
            turns = _turns(odd, side)
            phase = turns[0][x]
            for k in range(1, d):
                phase = phase * _spread(turns[k], k - 1, d - 1)
            both = np.fft.fftn(np.concatenate([plane, _kernel_plane(x, odd, side, h)[None]]) * phase, axes=axes)
            rows += [(number, c // step, x, both[:, c : c + step].tobytes()) for c in range(0, side, step)]
        return _rows(rows)

    def across(key: tuple, table: pa.Table) -> pa.Table:
        number, chunk = key[0].as_py(), key[1].as_py()
        order = np.argsort(_array(table, "x"))
        parts = [table.column("body")[int(k)].as_buffer() for k in order]
        own = np.stack([np.frombuffer(p, complex).reshape(d + 2, -1, *[side] * (d - 2)) for p in parts], 1)
        moved = np.fft.fft(own, axis=1)
        back = np.fft.ifft(moved[:-1] * moved[-1:], axis=1)
        return _rows([(number, chunk, x, back[:, x].tobytes()) for x in range(side)])

    def backward(key: tuple, table: pa.Table) -> pa.Table:
        x, total = key[0].as_py(), np.zeros((d + 1, *[side] * (d - 1)))
        number, chunk = _array(table, "odd"), _array(table, "chunk")
        for k, odd in enumerate(odds):
            mine = np.flatnonzero(number == k)
            parts = [table.column("body")[int(r)].as_buffer() for r in mine[np.argsort(chunk[mine])]]
            plane = np.concatenate([np.frombuffer(p, complex).reshape(d + 1, -1, *[side] * (d - 2)) for p in parts], 1)
            turns = _turns(odd, side)
            phase = turns[0][x]
            for j in range(1, d):
                phase = phase * _spread(turns[j], j - 1, d - 1)
            total += (np.fft.ifftn(plane, axes=axes) * np.conj(phase)).real / 2**d
        at = np.unravel_index(np.arange(side ** (d - 1)), [side] * (d - 1))
        arrays = [pa.array(np.full(side ** (d - 1), x, np.int32)), *(pa.array(c.astype(np.int32)) for c in at), *(pa.array(total[m].ravel()) for m in range(d + 1))]
        return pa.Table.from_arrays(arrays, [*(f"g{k}" for k in range(d)), *(f"phi{m}" for m in range(d + 1))])

    spark, kind = grid.sparkSession, "odd int, chunk int, x int, body binary"
    planes = spark.range(side).select(F.col("id").cast("int").alias("plane"))
    first = planes.groupBy("plane").cogroup(grid.groupBy("g0")).applyInArrow(lambda key, _, table: forward(key, table), kind)
    second = first.groupBy("odd", "chunk").applyInArrow(across, kind)
    out = ", ".join([f"g{k} int" for k in range(d)] + [f"phi{m} double" for m in range(d + 1)])
    return second.groupBy("x").applyInArrow(backward, out)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    return pa.Table.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["odd", "chunk", "x", "body"])
