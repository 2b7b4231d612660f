"""Forces and costs of an embedding coords(id, y0[, y1[, y2]])."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators import blocks, nodes
from filigree.operators.state import reading, written

FLT_MIN = 1.1754943508222875e-38
#: Points of a group of repulse_exact() at most, and of the two sides of a tile of its pairs.
GROUP_POINTS, TILE = 1 << 18, (128, 1024)


def dims(coords: DataFrame) -> int:
    return sum(c in coords.columns for c in ("y0", "y1", "y2"))


def _side(coords: DataFrame, key: str, letter: str) -> DataFrame:
    return coords.select(F.col("id").alias(key), *[F.col(f"y{k}").alias(f"{letter}{k}") for k in range(dims(coords))])


def _square(d: int) -> Column:
    return sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in range(d)), F.lit(0.0))


def attract(edges: DataFrame, coords: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """id and sum over its edges of w (y_src - y_dst) / (1 + |y_src - y_dst|^2). In a bipartite graph the coordinates of dst
    are those of a table of their own, others."""
    d = dims(coords)
    rows = edges.join(_side(coords, "src", "a"), "src").join(_side(coords if others is None else others, "dst", "b"), "dst").withColumn("q", F.col("w") / (1 + _square(d)))
    return rows.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("q") * (F.col(f"a{k}") - F.col(f"b{k}"))).alias(f"f{k}") for k in range(d)])


def _pair_sums(y: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each row of y the sums of q and of q^2 (y - x) over the rows of x, and for each row of x those over y; without x,
    over the other rows of y. Tiles of TILE pairs stay in a processor's cache."""
    alone, x = x is None, y if x is None else x
    centre = y.mean(0)
    y, x = y - centre, x - centre
    one, two = np.hstack([np.ones((len(y), 1)), y]), np.hstack([np.ones((len(x), 1)), x])
    near, far = np.zeros_like(one), None if alone else np.zeros_like(two)
    room, other = np.empty(TILE[0] * TILE[1]), np.empty(TILE[0] * TILE[1])
    ones = np.ones(max(TILE))
    columns = [np.ascontiguousarray(x[:, k]) for k in range(x.shape[1])]
    for r in range(0, len(y), TILE[0]):
        i = slice(r, r + TILE[0])
        for c in range(0, len(x), TILE[1]):
            j = slice(c, c + TILE[1])
            shape = len(y[i]), len(columns[0][j])
            q, diff = (a[: shape[0] * shape[1]].reshape(shape) for a in (room, other))
            for k, column in enumerate(columns):
                to = diff if k else q
                np.subtract(y[i, k, None], column[None, j], out=to)
                np.multiply(to, to, out=to)
                if k:
                    q += to
            q += 1
            np.reciprocal(q, out=q)
            near[i, 0] += q @ ones[: shape[1]]
            if far is not None:
                far[j, 0] += ones[: shape[0]] @ q
            np.multiply(q, q, out=q)
            got = q @ two[j]
            near[i, 1:] += y[i] * got[:, :1] - got[:, 1:]
            if far is not None:
                got = q.T @ one[i]
                far[j, 1:] += x[j] * got[:, :1] - got[:, 1:]
    if alone:
        near[:, 0] -= 1  # each row met itself
    return near, far


def repulse_exact(coords: DataFrame, groups: int | None = None) -> DataFrame:
    """id, forces sum q^2 (y_i - y_j) / zeta, and zeta, by all pairs. It takes any number of points, at a cost that grows with
    its square: points are dealt into groups, each unordered pair of groups is a task that holds no more than these, and a
    point's coordinates and sums move as often as there are groups."""
    d = dims(coords)
    names = [f"y{k}" for k in range(d)]
    if groups is None:
        tasks = coords.sparkSession.sparkContext.defaultParallelism
        groups = max(math.ceil(math.sqrt(8 * tasks)), -(-coords.count() // GROUP_POINTS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        y = np.stack([table.column(c).to_numpy() for c in names], 1)[order]
        own, ids = own[order], ids[order]
        one, two = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        if key[1] == key[2]:
            sums, at = _pair_sums(y[one])[0], one
        elif len(one) and len(two):
            sums, at = np.concatenate(_pair_sums(y[one], y[two])), np.concatenate([one, two])
        else:
            sums, at = np.zeros((0, d + 1)), one[:0]
        return pa.table({"id": ids[at]} | {c: sums[:, k] for k, c in enumerate(["s", *(f"g{k}" for k in range(d))])})

    dealt = coords.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in names]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)))
    met = dealt.withColumn("other", F.explode(F.lit(list(range(groups))).cast("array<long>"))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    found = by_pairs(met, groups).applyInArrow(run, "id long, s double, " + ", ".join(f"g{k} double" for k in range(d)))
    sums = found.groupBy("id").agg(F.sum("s").alias("s"), *[F.sum(f"g{k}").alias(f"g{k}") for k in range(d)])
    sums = written(sums, "sums")  # else the zeta would make all pairs again
    zeta = sums.agg(F.sum("s").alias("zeta"))
    out = sums.join(F.broadcast(zeta)).where("zeta > 0").select("id", *[(F.col(f"g{k}") / F.when(F.col("zeta") > 0, F.col("zeta"))).alias(f"f{k}") for k in range(d)], "zeta")  # one row
    return reading(out, sums)


def by_pairs(met: DataFrame, groups: int):
    """met rows grouped by (pair, low, high), each unordered pair of groups in a partition of its own: as a hash of so few keys
    would deal them, some tasks would get several."""
    pair = (F.col("high") * (F.col("high") + 1) / 2 + F.col("low")).cast("int")
    return met.withColumn("pair", pair).repartitionById(groups * (groups + 1) // 2, "pair").groupBy("pair", "low", "high")


#: The lengths of transforms that grids have.
LENGTHS = (
    8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 25, 26, 28, 32, 33, 35, 36, 39, 40, 42, 44, 45, 48, 49, 50, 52, 54, 55, 56, 60, 63, 64, 65, 66, 70, 72, 75, 77, 78, 80, 84, 88, 90, 91, 96,
    98, 99, 100, 104, 105, 108, 110, 112, 117, 120, 125, 126, 130, 132, 135, 140, 144, 147, 150, 154, 156, 160, 165, 168, 175, 176, 180, 182, 189, 192, 195, 196, 198, 200, 208, 210,
    216, 220, 224, 225, 231, 234, 240, 245, 250, 252, 260, 264, 270, 273, 275, 280, 288, 294, 297, 300, 308, 312, 315, 320, 325, 330, 336, 343, 350, 351, 352, 360, 364, 375, 378, 385,
    390, 392, 396, 400, 416, 420, 432, 440, 441, 448, 450, 455, 462, 468, 480, 490, 495, 500, 504, 512,
)


def smooth_size(n: int) -> int:
    """Cells for n wanted: two less than the least of LENGTHS that is at least n + 2, or than the last."""
    return LENGTHS[min(bisect.bisect_left(LENGTHS, n + 2), len(LENGTHS) - 1)] - 2


def weights(t, smooth: bool = False):
    """Cubic weights of the four cells around a fraction t: Lagrange's, or, smooth, those of cubic convolution."""
    near = lambda x: 1.5 * x * x * x - 2.5 * x * x + 1 if smooth else x * x * x / 2 - x * x - x / 2 + 1
    far = lambda x: -(x * x * x) / 2 + 2.5 * x * x - 4 * x + 2 if smooth else -(x * x * x) / 6 + x * x - 11 * x / 6 + 1
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def grid_of(coords: DataFrame, step: float) -> tuple[list[float], float, int, float]:
    """Least coordinates, largest extent, cells, and the grid's real step."""
    d = dims(coords)
    r = coords.agg(*[F.min(f"y{k}") for k in range(d)], *[F.max(f"y{k}") for k in range(d)]).first()
    if r[0] is None:
        return [0.0] * d, 1.0, 14, 1.0
    low = [r[k] for k in range(d)]
    extent = max(r[d + k] - r[k] for k in range(d)) or 1.0
    n = smooth_size(max(int(np.ceil(extent / step)), 14))
    return low, extent, n, extent / (n - 1 - np.finfo(float).eps)


def cells(coords: DataFrame, low: list[float], extent: float, n: int) -> DataFrame:
    """coords with shifted coordinates z, cell c and fraction t in each dimension."""
    out = coords
    for k in range(dims(coords)):
        scaled = (F.col(f"y{k}") - low[k]) / extent
        scaled = F.when(scaled >= 1.0, scaled - np.finfo(float).eps).otherwise(scaled) * (n - 1)
        out = out.withColumn(f"z{k}", F.col(f"y{k}") - low[k]).withColumn(f"c{k}", F.floor(scaled).cast("int")).withColumn(f"t{k}", scaled - F.floor(scaled))
    return out


def scatter(placed: DataFrame, d: int, smooth: bool = False) -> DataFrame:
    """Grid cells with the charges 1, z0, .. of the points around them."""
    return blocks.scatter(blocks.dealt(placed, d), d, smooth)


#: Cells of a grid that convolve_cells() takes, and sends to every executor.
CONVOLVE_CELLS = 100_000


def convolve_cells(grid: DataFrame, d: int, n: int, h: float) -> DataFrame:
    """The grid convolved with 1 / (1 + h^2 r^2)^2 by all pairs of cells: for small grids."""
    spark = grid.sparkSession
    if (n + 2) ** d > CONVOLVE_CELLS:
        raise ValueError(f"{(n + 2) ** d} cells; all pairs are for at most {CONVOLVE_CELLS}")
    target = spark.range((n + 2) ** d)
    for k in range(d):
        target = target.withColumn(f"p{k}", (F.floor(F.col("id") / (n + 2) ** k) % (n + 2)).cast("int"))
    r2 = sum(((F.col(f"p{k}") - F.col(f"g{k}")) * (F.col(f"p{k}") - F.col(f"g{k}")) for k in range(d)), F.lit(0))
    rows = target.join(F.broadcast(grid)).withColumn("kern", 1 / ((1 + h * h * r2) * (1 + h * h * r2)))
    return rows.groupBy(*[F.col(f"p{k}").alias(f"g{k}") for k in range(d)]).agg(*[F.sum(F.col("kern") * F.col(f"v{m}")).alias(f"phi{m}") for m in range(d + 1)])


def convolve_fft(values: np.ndarray, h: float) -> np.ndarray:
    """The same for arrays (channels, cells, ..), without padding. A transform of twice the length falls into transforms of
    the single length for its even and its odd places in each dimension, so a channel needs as many as there are
    corners, one after another, and the memory of one."""
    shape = values.shape[1:]
    d = len(shape)
    out = np.zeros(values.shape)
    r2 = [np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)).astype(float) ** 2 for n in shape]

    def along(x: np.ndarray, k: int) -> np.ndarray:
        return x.reshape([-1 if m == k else 1 for m in range(d)])

    for odd in np.ndindex(*[2] * d):
        turn = np.ones([1] * d)
        for k in range(d):
            if odd[k]:
                turn = turn * along(np.exp(-1j * np.pi * np.arange(shape[k]) / shape[k]), k)
        kernel = np.zeros(shape)
        for half in np.ndindex(*[2] * d):
            far = sum(along(r2[k][half[k] * shape[k] : (half[k] + 1) * shape[k]], k) for k in range(d))
            kernel += (-1) ** sum(a & b for a, b in zip(odd, half, strict=True)) / (1 + h * h * far) ** 2
        spectrum = np.fft.fftn(kernel * turn)
        for m in range(len(values)):
            out[m] += (np.fft.ifftn(np.fft.fftn(values[m] * turn) * spectrum) * np.conj(turn)).real / 2**d
    return out


#: Cells of a grid that one task convolves.
ONE_TASK_CELLS = 1 << 21


def convolve_grid(grid: DataFrame, d: int, n: int, h: float) -> DataFrame:
    """The grid convolved by convolve_fft(), in one task on an executor: its size has a bound, whatever that of the data."""
    names = [f"g{k}" for k in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.zeros((d + 1, *[n + 2] * d))
        for batch in batches:
            where = tuple(batch.column(c).to_numpy() for c in names)
            for m in range(d + 1):
                values[m][where] = batch.column(f"v{m}").to_numpy()
        out = convolve_fft(values, h).reshape(d + 1, -1)
        for k in range(0, out.shape[1], 1 << 16):
            own = np.arange(k, min(k + (1 << 16), out.shape[1]))
            cells_ = np.unravel_index(own, [n + 2] * d)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cells_] + [pa.array(out[m, own]) for m in range(d + 1)], names + [f"phi{m}" for m in range(d + 1)])

    kind = ", ".join([f"{c} int" for c in names] + [f"phi{m} double" for m in range(d + 1)])
    return grid.repartition(1).mapInArrow(run, kind)


def repulse_grid(coords: DataFrame, step: float, by_cells: bool = False, by_planes: bool = False) -> DataFrame:
    """id, forces and zeta by the grid (at most 512 cells a side): those of at most ONE_TASK_CELLS are convolved in one
    task, others, and with by_planes all, by planes, or, by cells, in a join. Points and potentials meet by blocks of cells."""
    d = dims(coords)
    low, extent, n, h = grid_of(coords, step)
    points = blocks.dealt(cells(coords, low, extent, n), d)
    grid = blocks.scatter(points, d)
    by_planes = d > 1 and (by_planes or (n + 2) ** d > ONE_TASK_CELLS)
    phi = convolve_cells(grid, d, n, h) if by_cells else blocks.convolve_planes(grid, d, n, h) if by_planes else convolve_grid(grid, d, n, h)
    got = blocks.gather(points, phi, d)
    norm = sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(d)), F.lit(0.0))
    inner = sum((F.col(f"z{k}") * F.col(f"phi{k + 1}") for k in range(d)), F.lit(0.0))
    zeta = got.agg((F.sum((1 + 2 * norm) * F.col("phi0") - 2 * inner) - F.count("*")).alias("zeta"))
    return got.join(F.broadcast(zeta)).select("id", *[((F.col(f"z{k}") * F.col("phi0") - F.col(f"phi{k + 1}")) / F.col("zeta")).alias(f"f{k}") for k in range(d)], "zeta")  # one row


def repulse(coords: DataFrame, step: float | None = None, theta: float | None = None) -> DataFrame:
    """Repulsion by the tree where there is an opening angle theta, by the grid where there is a step, else by all pairs: many
    points in few boxes meet by the boxes' nodes, with the same digits."""
    if theta is not None:
        from filigree.operators.treecode import repulse_tree

        return repulse_tree(coords, theta)
    if step is not None:
        return repulse_grid(coords, step)
    found = nodes.boxes_of(coords, dims(coords))
    return repulse_exact(coords) if found is None else nodes.repulse(coords, *found)


def gradient(edges: DataFrame, coords: DataFrame, alpha: float = 1.0, step: float | None = None, scale: float = 1.0, theta: float | None = None) -> DataFrame:
    """id, scale (alpha attraction - repulsion) in each dimension, and zeta; exact without a step and without a theta."""
    return gradient_of(attract(edges, coords), coords, alpha, step, scale, theta)


def gradient_of(pull: DataFrame, coords: DataFrame, alpha: float = 1.0, step: float | None = None, scale: float = 1.0, theta: float | None = None) -> DataFrame:
    """gradient() from the attraction."""
    d = dims(coords)
    pull = pull.select("id", *[F.col(f"f{k}").alias(f"p{k}") for k in range(d)])
    push = repulse(coords, step, theta)
    out = push.join(pull, "id", "left").select("id", *[(scale * (alpha * F.coalesce(f"p{k}", F.lit(0.0)) - F.col(f"f{k}"))).alias(f"d{k}") for k in range(d)], "zeta")
    return reading(out, push)


def kl_cost(edges: DataFrame, coords: DataFrame, alpha: float = 1.0, zeta: float | None = None, step: float | None = None, theta: float | None = None) -> DataFrame:
    """Sum of alpha p ln(alpha p / (q / zeta)) over the edges; zeta is that of coords, by repulse(), unless an older one is
    given."""
    d = dims(coords)
    rows = edges.join(_side(coords, "src", "a"), "src").join(_side(coords, "dst", "b"), "dst").withColumn("q", 1 / (1 + _square(d)))
    if zeta is None:
        push = repulse(coords, step, theta)
        rows = rows.join(F.broadcast(push.agg(F.first("zeta").alias("zeta"))))  # one row
    else:
        rows = rows.withColumn("zeta", F.lit(zeta))
    p = F.col("w") * alpha
    return rows.agg(F.sum(p * F.ln((p + FLT_MIN) / (F.col("q") / F.col("zeta") + FLT_MIN))).alias("cost"))
