"""The descent of large graphs by tiles: no step moves an edge.

Vertices are dealt into blocks by the upper bits of a hash of their ids. A pair of vertices belongs to the tile of its two
blocks, whichever way its edges go, so an edge and its reverse meet in one row. Edges are shuffled twice, as packed arrays:
to their tile, and to the partition where the tile stays. A step sends each vertex's coordinates to the tiles of its block,
gets back a sum from each of them, and adds them up in the block. Both are once a block for each vertex, while a join of edges and
coordinates would send every edge each time.

Rescaled edges come with their weights; with lam 1 the tiles hold the weights as they were, and the sums that these are
divided by belong to the vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filigree.operators import forces
from filigree.operators.descent import schedule
from filigree.operators.state import discard, written
from filigree.params import Params

#: Bits of the hash that packed edges are dealt by, and the least that blocks have: tiles for every core.
FINE_BITS, LEAST_BITS = 6, 3
#: Pairs of a tile and vertices of a block that are aimed at, edges that are packed at once, and pairs that a tile takes at once.
TILE_PAIRS, BLOCK_POINTS, FLUSH, CHUNK = 1 << 22, 1 << 20, 1 << 20, 1 << 17
#: Points whose cells are held at once: they stay in a processor's cache.
POINTS = 1 << 13
#: Pairs of a graph whose vertices can be one block.
WHOLE_PAIRS = 1 << 26
#: Cells of a grid that each block scatters into and reads from as a whole; others go by blocks of cells.
DENSE_CELLS = 1 << 19


def block_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of a hash: what falls together by more bits does so by fewer."""
    x = ids.astype(np.int64).view(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _small(a: np.ndarray) -> bytes:
    """An array in as few bytes as hold its values, behind 8 bytes that name its type."""
    if len(a) and a.min() >= 0 and a.max() < 1 << 32:
        short = a.astype(np.uint8 if a.max() < 1 << 8 else np.uint16 if a.max() < 1 << 16 else np.uint32)
        a = short if (short == a).all() else a
    return a.dtype.char.encode().ljust(8) + np.ascontiguousarray(a).tobytes()


def _array(body: pa.Scalar) -> np.ndarray:
    own = body.as_buffer()
    return np.frombuffer(own[8:], np.dtype(own[:1].to_pybytes().decode()))


def _summed(first: np.ndarray, second: np.ndarray, forth: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in their order, those of one pair summed."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))[: len(first)]
    return first[at], second[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in (forth, back))


def packed(edges: DataFrame, fold: bool) -> DataFrame:
    """edges as rows of arrays: the fine blocks low and high of n pairs, their ends, and the weights forth and back; folded,
    both ways in one. Written."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
        low, high = block_of(src, FINE_BITS), block_of(dst, FINE_BITS)
        swap = (low > high) | ((low == high) & (src > dst))
        one, two = np.where(swap, dst, src), np.where(swap, src, dst)
        one, two, forth, back = _summed(one, two, np.where(swap, 0.0, w), np.where(swap, w, 0.0))
        if fold:
            forth, back = forth + back, np.zeros(len(back))
        tile = (block_of(one, FINE_BITS) << FINE_BITS | block_of(two, FINE_BITS)).astype(np.uint16)
        order = np.argsort(tile, kind="stable")
        tile, parts = tile[order].astype(np.int64), [x[order] for x in (one, two, forth, back)]
        at = np.append(np.flatnonzero(np.diff(tile, prepend=-1)), len(tile))
        own = tile[at[:-1]]
        bodies = [pa.array([_small(x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in parts]
        head = [pa.array((own >> FINE_BITS).astype(np.int32)), pa.array((own & ((1 << FINE_BITS) - 1)).astype(np.int32)), pa.array(np.diff(at))]
        return pa.RecordBatch.from_arrays(head + bodies, ["low", "high", "n", "one", "two", "forth", "back"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).where("src IS NOT NULL")
    rows = rows.withColumn("dst", F.when(F.col("dst").isNull(), F.raise_error(F.lit("an edge ends at no vertex"))).otherwise(F.col("dst"))).fillna(0.0, ["w"])
    return written(rows.mapInArrow(run, "low int, high int, n long, one binary, two binary, forth binary, back binary"), "packs")


def unpacked(packs: DataFrame) -> DataFrame:
    """The edges src, dst and w again, repeated ones perhaps more than once; those without weight one way are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two, forth, back = (_array(batch.column(c)[k]) for c in ("one", "two", "forth", "back"))
                way = back != 0
                there = (forth != 0) | ~way  # an edge of weight 0 is one still
                ends = [np.concatenate([a[there], b[way]]).astype(np.int64) for a, b in ((one, two), (two, one))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(np.concatenate([forth[there], back[way]]).astype(float))], ["src", "dst", "w"])

    return packs.mapInArrow(run, "src long, dst long, w double")


def ends(packs: DataFrame) -> DataFrame:
    """The ids at which edges end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_array(batch.column(c)[k]) for c in ("one", "two") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)).astype(np.int64))], ["id"])

    return packs.select("one", "two").mapInArrow(run, "id long").distinct()


def pairs(packs: DataFrame) -> int:
    return packs.agg(F.sum("n")).first()[0] or 0


class Plan:
    """Blocks and tiles. Few vertices are one block, whose pairs are dealt over several tiles."""

    def __init__(self, n_pairs: int, n_points: int, tasks: int):
        self.bits = 0 if n_points <= BLOCK_POINTS and n_pairs <= WHOLE_PAIRS else LEAST_BITS
        while 0 < self.bits < FINE_BITS and (n_pairs > TILE_PAIRS << (2 * self.bits - 1) or n_points > BLOCK_POINTS << self.bits):
            self.bits += 1
        self.blocks = 1 << self.bits
        self.tiles = self.blocks * (self.blocks + 1) // 2 if self.bits else max(tasks, -(-n_pairs // TILE_PAIRS))

    def tile(self, low: Column, high: Column) -> Column:
        """The tile of packed edges by their fine blocks."""
        if not self.bits:
            return F.pmod(F.xxhash64(low, high), F.lit(self.tiles)).cast("int")
        low, high = (F.shiftright(c, FINE_BITS - self.bits) for c in (low, high))
        return (F.floor(high * (high + 1) / 2) + low).cast("int")

    def ends(self, tile: int) -> tuple[int, int]:
        """The blocks of a tile."""
        if not self.bits:
            return 0, 0
        high = int((np.sqrt(8 * tile + 1) - 1) // 2)
        return tile - high * (high + 1) // 2, high

    def sent(self, blocks: DataFrame, once: list[str] = []) -> DataFrame:  # noqa: B006
        """The blocks' rows to every tile that they are in, each of these in a partition of its own. The columns once go to tile 0."""
        into = {b: [t for t in range(self.tiles) if b in self.ends(t)] for b in range(self.blocks)}
        tiles = F.lit([into[b] for b in range(self.blocks)]).cast("array<array<int>>")
        rows = blocks.withColumn("tile", F.explode(F.get(tiles, "block")))
        return _by(rows.withColumns({c: F.when(F.col("tile") == 0, F.col(c)) for c in once}), "tile", self.tiles)


def _by(table: DataFrame, key: str, n: int):
    """Rows of each value of key in a partition of its own."""
    return table.repartitionById(n, key).groupBy(key)


def _blocks(rows: DataFrame, plan: Plan, columns: list[str], name: str) -> DataFrame:
    """A row for each block: its ids in their order, n, and the columns' values as one array, a column after the other."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("block", pa.array(block_of(batch.column("id").to_numpy(), plan.bits).astype(np.int32)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, values = table.column("id").to_numpy()[order], np.stack([table.column(c).to_numpy()[order] for c in columns])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": [len(ids)], "ids": [_small(ids)], name: [_small(values)]})

    own = rows.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns])
    placed = own.mapInArrow(place, ", ".join(["id long", *(f"{c} double" for c in columns), "block int"]))
    return _by(placed, "block", plan.blocks).applyInArrow(run, f"block int, n long, ids binary, {name} binary")


def _built(packs: DataFrame, points: DataFrame, plan: Plan) -> DataFrame:
    """A row for each tile: n pairs by their places i and j in the two blocks, their weights, the sums of weights of both
    blocks' vertices, and some ids that no block has. Written."""

    def run(key: tuple, edges: pa.Table, blocks: pa.Table) -> pa.Table:
        low, high = plan.ends(key[0].as_py())
        at = blocks.column("block").to_pylist()
        known = [_array(blocks.column("ids")[at.index(b)]).astype(np.int64) if b in at else np.zeros(0, np.int64) for b in (low, high)]
        parts = [np.concatenate([_array(v) for v in edges.column(c)] or [np.zeros(0)]).astype(t) for c, t in (("one", np.int64), ("two", np.int64), ("forth", float), ("back", float))]
        one, two, forth, back = _summed(*parts)
        places, lost = [], np.zeros(0, np.int64)
        for ids, own in zip((one, two), known, strict=True):
            place = np.searchsorted(own, ids)
            found = place < len(own)
            found[found] = own[place[found]] == ids[found]
            lost = np.union1d(lost, ids[~found])[:3]
            places.append(np.where(found, place, 0))
        sums = [b""] * 2 if len(lost) else [_small(np.bincount(p, w, len(own))) for p, w, own in zip(places, (forth, back), known, strict=True)]
        own = {"i": _small(places[0]), "j": _small(places[1]), "forth": _small(forth), "back": _small(back), "first": sums[0], "second": sums[1]}
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "n": [len(one)]} | {k: pa.array([v], pa.binary()) for k, v in own.items()} | {"lost": pa.array([lost], pa.list_(pa.int64()))})

    rows = packs.withColumn("tile", plan.tile(F.col("low"), F.col("high"))).drop("low", "high", "n")
    met = _by(rows, "tile", plan.tiles).cogroup(plan.sent(points.select("block", "ids")))
    return written(met.applyInArrow(run, "tile int, n long, i binary, j binary, forth binary, back binary, first binary, second binary, lost array<long>"), "tiles")


def _divisors(built: DataFrame, points: DataFrame, plan: Plan, alone: bool) -> DataFrame:
    """points with r, what the weights of a vertex's edges are multiplied by to have the sum 1 (or 1 for all, unless alone), and the
    total of its edges then."""

    def run(key: tuple, own: pa.Table, parts: pa.Table) -> pa.Table:
        n = own.column("n")[0].as_py() if own.num_rows else 0
        sums = sum((_array(v) for v in parts.column("sums")), np.zeros(n))
        near = (np.abs(sums - 1) <= 1e-12) | (sums == 0)
        r = np.where(near | (not alone), 1.0, 1 / np.where(near, 1.0, sums))
        return own.append_column("r", pa.array([_small(r)] * own.num_rows, pa.binary())).append_column("total", pa.array([float((sums * r).sum())] * own.num_rows))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [plan.ends(tile) for tile in batch.column("tile").to_pylist()]
            for side, name in enumerate(("first", "second")):
                yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in of], pa.int32()), batch.column(name)], ["block", "sums"])

    parts = built.select("tile", "first", "second").mapInArrow(both, "block int, sums binary")
    return _by(points, "block", plan.blocks).cogroup(_by(parts, "block", plan.blocks)).applyInArrow(run, "block int, n long, ids binary, y binary, r binary, total double")


def _ends_of(plan: Plan, key: tuple, blocks: pa.Table, d: int) -> tuple[tuple[int, int], list[np.ndarray], list[np.ndarray]]:
    """Numbers, coordinates (dimension, vertex) and factors of a tile's two blocks."""
    numbers = plan.ends(key[0].as_py())
    rows = [blocks.column("block").to_pylist().index(b) for b in numbers]
    return numbers, [_array(blocks.column("y")[k]).astype(float).reshape(d, -1) for k in rows], [_array(blocks.column("r")[k]).astype(float) for k in rows]


def _chunks(tile: pa.Table, y: list[np.ndarray], r: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of some pairs at once the places i and j, the sums of their two weights, the differences, and 1 + their squares."""
    i, j, forth, back = (_array(tile.column(c)[0]) for c in ("i", "j", "forth", "back"))
    for k in range(0, len(i), CHUNK):
        at = slice(k, k + CHUNK)
        a, b = i[at].astype(np.int64), j[at].astype(np.int64)
        diff = [one[a] - two[b] for one, two in zip(*y, strict=True)]
        yield at, a, b, forth[at] * r[0][a] + back[at] * r[1][b], diff, 1 + sum(x * x for x in diff)


def _pulled(plan: Plan, key: tuple, tile: pa.Table, blocks: pa.Table, d: int, alpha: float) -> tuple[tuple[int, ...], list[np.ndarray]]:
    """A tile's blocks, and for each of them the sums of alpha p (y_i - y_j) / (1 + |y_i - y_j|^2) of its vertices."""
    numbers, y, r = _ends_of(plan, key, blocks, d)
    sums = [np.zeros(x.shape) for x in y]
    for _, i, j, p, diff, square in _chunks(tile, y, r):
        q = alpha * p / square
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for k in range(d):
            f = q * diff[k]
            sums[0][k, i[starts]] += np.add.reduceat(f, starts)
            sums[1][k] -= np.bincount(j, f, y[1].shape[1])
    return (numbers, sums) if numbers[0] != numbers[1] else (numbers[:1], [sums[0] + sums[1]])


def _pulls(tiles: DataFrame, state: DataFrame, plan: Plan, d: int, alpha: float) -> DataFrame:
    """The sums of each tile by block."""

    def run(key: tuple, tile: pa.Table, blocks: pa.Table) -> pa.Table:
        some = tile.num_rows and tile.column("n")[0].as_py()
        numbers, sums = _pulled(plan, key, tile, blocks, d, alpha) if some else ((), [])
        return pa.table({"block": pa.array(numbers, pa.int32()), "force": pa.array([_small(x) for x in sums], pa.binary())})

    return tiles.groupBy("tile").cogroup(plan.sent(state.select("block", "y", "r"))).applyInArrow(run, "block int, force binary")


def _cost(tiles: DataFrame, state: DataFrame, plan: Plan, d: int, total: float, zeta: float) -> float:
    def run(key: tuple, tile: pa.Table, blocks: pa.Table) -> pa.Table:
        cost = 0.0
        if tile.num_rows and tile.column("n")[0].as_py():
            numbers, y, r = _ends_of(plan, key, blocks, d)
            for _, i, j, p, _, square in _chunks(tile, y, r):
                loop = (i == j) if numbers[0] == numbers[1] else np.zeros(len(i), bool)
                p = np.where(loop, 2 * p, p) / total
                cost += float((np.where(loop, 1, 2) * p * np.log((p + forces.FLT_MIN) / (1 / square / zeta + forces.FLT_MIN))).sum())
        return pa.table({"cost": [cost]})

    return tiles.groupBy("tile").cogroup(plan.sent(state.select("block", "y", "r"))).applyInArrow(run, "cost double").agg(F.sum("cost")).first()[0] or 0.0


# --- repulsion by a grid that a task holds whole --------------------------------------------------------------------
def _grid(low: list[float], high: list[float], step: float) -> tuple[float, int, float]:
    """Extent, cells a side, and the grid's real step."""
    extent = max(b - a for a, b in zip(low, high, strict=True)) or 1.0
    n = forces.smooth_size(max(int(np.ceil(extent / step)), 14))
    return extent, n, extent / (n - 1 - np.finfo(float).eps)


def _around(y: np.ndarray, low: list[float], extent: float, n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some points of y (dimension, point) at once their shifted coordinates, the cells around them, and these's weights."""
    for k in range(0, y.shape[1], POINTS):
        at = slice(k, k + POINTS)
        z = y[:, at] - np.asarray(low)[:, None]
        scaled = z / extent
        scaled = np.where(scaled >= 1, scaled - np.finfo(float).eps, scaled) * (n - 1)
        total, place = np.ones((z.shape[1], 1)), np.zeros((z.shape[1], 1), np.int64)
        for own in scaled:
            cell = np.floor(own).astype(np.int64)
            w = np.stack(forces.weights(own - cell), 1)
            total = (total[:, :, None] * w[:, None, :]).reshape(len(own), -1)
            place = (place[:, :, None] * (n + 2) + cell[:, None, None] + np.arange(4)).reshape(len(own), -1)
        yield at, z, place, total


def _scattered(y: np.ndarray, low: list[float], extent: float, n: int) -> np.ndarray:
    """Cells with the charges 1, z0, .. and |z|^2 of points."""
    d, size = len(y), (n + 2) ** len(y)
    sums = np.zeros((d + 2, size))
    for _, z, place, total in _around(y, low, extent, n):
        at, first = place.ravel(), place.min()  # cells beyond those that some points touch are not added up
        for m, charge in enumerate([None, *z, (z * z).sum(0)]):
            got = np.bincount(at - first, (total if charge is None else total * charge[:, None]).ravel())
            sums[m, first : first + len(got)] += got
    return sums


def _convolved(sums: np.ndarray, points: int, n: int, h: float) -> tuple[np.ndarray, float]:
    """The potentials of scattered cells, and zeta, which the cells give too."""
    d = len(sums) - 2
    phi = forces.convolve_fft(sums[: d + 1].reshape(d + 1, *[n + 2] * d), h).reshape(d + 1, -1)
    return phi, float(((sums[0] + 2 * sums[-1]) * phi[0] - 2 * (sums[1:-1] * phi[1:]).sum(0)).sum() - points)


def _potential(state: DataFrame, d: int, low: list[float], high: list[float], step: float) -> DataFrame:
    """One row: the potentials of all cells as phi, and zeta. Blocks scatter into whole grids, which one task sums and convolves:
    their size has a bound."""
    extent, n, h = _grid(low, high, step)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("y"):
                y = _array(body).astype(float).reshape(d, -1)
                yield pa.RecordBatch.from_arrays([pa.array([y.shape[1]]), pa.array([_scattered(y, low, extent, n).tobytes()], pa.binary())], ["n", "sums"])

    def convolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, points = np.zeros((d + 2, (n + 2) ** d)), 0
        for batch in batches:
            for body in batch.column("sums"):
                sums += np.frombuffer(body.as_buffer()).reshape(d + 2, -1)
            points += sum(batch.column("n").to_pylist())
        phi, zeta = _convolved(sums, points, n, h)
        yield pa.RecordBatch.from_arrays([pa.array([phi.tobytes()], pa.binary()), pa.array([zeta])], ["phi", "zeta"])

    return state.select("y").mapInArrow(scatter, "n long, sums binary").repartition(1).mapInArrow(convolve, "phi binary, zeta double")


def _rows(state: DataFrame, d: int, shift: list[float]) -> DataFrame:
    """id and coordinates of every vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body in zip(batch.column("ids"), batch.column("y"), strict=True):
                ids, y = _array(ids).astype(np.int64), _array(body).astype(float).reshape(d, -1)
                for k in range(0, len(ids), CHUNK):
                    at = slice(k, k + CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *(pa.array(y[m, at] - shift[m]) for m in range(d))], ["id", *(f"y{m}" for m in range(d))])

    return state.select("ids", "y").mapInArrow(run, "id long, " + ", ".join(f"y{m} double" for m in range(d)))


_KIND = "block int, n long, ids binary, y binary, u binary, g binary, r binary"


def _observed(table: DataFrame, name: str, d: int) -> tuple[DataFrame, dict]:
    """The table written, and the bounds and means of its coordinates."""
    seen = Observation()
    table = table.observe(seen, F.sum("n").alias("n"), F.max("most").alias("most"), *[f(F.col(c)[k]).alias(f"{c}{k}") for f, c in ((F.min, "low"), (F.max, "high"), (F.sum, "sum")) for k in range(d)])
    out = written(table, name)
    got = seen.get
    return out, {"most": got["most"], "low": [got[f"low{k}"] for k in range(d)], "high": [got[f"high{k}"] for k in range(d)], "mean": [(got[f"sum{k}"] or 0.0) / max(got["n"] or 0, 1) for k in range(d)]}


def _stated(block: pa.Scalar, ids: pa.Scalar, r: pa.Scalar, y: np.ndarray, u: np.ndarray, g: np.ndarray, most: float) -> pa.Table:
    bodies = {"ids": ids.as_py(), "y": _small(y), "u": _small(u), "g": _small(g), "r": r.as_py()}
    facts = {"low": y.min(1), "high": y.max(1), "sum": y.sum(1)}
    return pa.table({"block": pa.array([block.as_py()], pa.int32()), "n": [y.shape[1]]} | {k: pa.array([v], pa.binary()) for k, v in bodies.items()} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in facts.items()} | {"most": [most]})


_FACTS = _KIND + ", low array<double>, high array<double>, sum array<double>, most double"


def _moved(params: Params, momentum: float, own: pa.Table, pulls: pa.Table, shift: np.ndarray | None, low: list[float], grid: tuple[float, int, float] | None) -> pa.Table:
    """The next state of a block from its own and its pulls. The repulsion is that of the grid, by the potentials that come with the
    state, or, where that is all vertices, by their own; without a grid it comes with the state. Coordinates are read with
    shift taken off."""
    d = params.dims
    y, u, g = (_array(own.column(c)[0]).astype(float).reshape(d, -1) for c in "yug")
    grad = sum((_array(v).reshape(d, -1) for v in pulls.column("force")), np.zeros(y.shape))
    if grid:
        extent, n, h = grid
        if "phi" in own.column_names:
            phi, zeta = np.frombuffer(own.column("phi")[0].as_buffer()).reshape(d + 1, -1), own.column("zeta")[0].as_py()
        else:
            phi, zeta = _convolved(_scattered(y, low, extent, n), y.shape[1], n, h)
        for at, z, place, weight in _around(y, low, extent, n):
            got = [np.einsum("ij,ij->i", phi[m].take(place), weight) for m in range(d + 1)]
            for k in range(d):
                grad[k, at] -= (z[k] * got[0] - got[k + 1]) / zeta
    else:
        grad -= _array(own.column("push")[0]).reshape(d, -1)
    g = np.maximum(np.where(np.sign(grad) != np.sign(u), g + params.gain_up, g * params.gain_down), params.gain_floor)
    u = momentum * u - params.rate * g * grad
    return _stated(own.column("block")[0], own.column("ids")[0], own.column("r")[0], y - np.asarray(shift)[:, None] + u, u, g, float(np.abs(grad).sum(0).max()))


#: Steps of one job where all vertices are one block: it has what else the driver would gather between them.
CHAINED = 10


def _chained(tiles: DataFrame, state: DataFrame, plan: Plan, params: Params, it: int, total: float) -> DataFrame:
    """The state of a whole block after step number it. Its tiles get the coordinates, and the first of them the rest, which goes
    back with the sums."""
    d, (alpha, momentum) = params.dims, schedule(it, params)
    names = ["block", "n", "ids", "y", "u", "g", "r", "most"]
    kind = "block int, n long, ids binary, y binary, u binary, g binary, r binary, most double, force binary"

    def pull(key: tuple, tile: pa.Table, own: pa.Table) -> pa.Table:
        if tile.num_rows and tile.column("n")[0].as_py():
            force = _pulled(plan, key, tile, own, d, alpha / total)[1][0]
        else:
            force = np.zeros((d, own.column("n")[0].as_py()))
        body = own.select(names)
        if key[0].as_py():
            body = body.set_column(names.index("y"), "y", pa.array([None], pa.binary())).set_column(names.index("r"), "r", pa.array([None], pa.binary()))
        return body.append_column("force", pa.array([_small(force)], pa.binary()))

    def step(key: tuple, table: pa.Table) -> pa.Table:
        at = [k for k, v in enumerate(table.column("ids")) if v.is_valid][0]
        own = table.slice(at, 1)
        y = _array(own.column("y")[0]).astype(float).reshape(d, -1)
        if params.tolerance and own.column("most")[0].as_py() < params.tolerance:  # the steps have ended
            u, g = (_array(own.column(c)[0]).astype(float).reshape(d, -1) for c in "ug")
            return _stated(key[0], own.column("ids")[0], own.column("r")[0], y, u, g, own.column("most")[0].as_py())
        low, high = y.min(1).tolist(), y.max(1).tolist()
        shift = y.mean(1) if params.recenter and it else np.zeros(d)
        return _moved(params, momentum, own, table, shift, low, _grid(low, high, params.grid_step))

    sent = plan.sent(state.select(*names), ["ids", "u", "g"])
    pulls = tiles.groupBy("tile").cogroup(sent).applyInArrow(pull, kind)
    return _by(pulls, "block", plan.blocks).applyInArrow(step, _FACTS)


def _step(params: Params, momentum: float, shift: list[float], low: list[float], grid: tuple[float, int, float] | None):
    return lambda key, own, pulls: _moved(params, momentum, own, pulls, shift, low, grid)


def descend(packs: DataFrame, coords: DataFrame, params: Params, alone: bool) -> DataFrame:
    """id, coordinates and cost after params.max_iter steps by the grid, from packed() edges; alone: these are not stochastic yet.
    Every step's state is written, and the one before it deleted."""
    d = params.dims
    plan = Plan(pairs(packs), coords.count(), packs.sparkSession.sparkContext.defaultParallelism)
    points = written(_blocks(coords, plan, [f"y{k}" for k in range(d)], "y"), "points")
    built = _built(packs, points, plan)
    lost = [x for r in built.where(F.size("lost") > 0).select("lost").limit(3).collect() for x in r.lost][:3]
    if lost:
        raise ValueError(f"edges end at {', '.join(map(str, lost))}, which the vertices lack")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                y = _array(batch.column("y")[k]).astype(float).reshape(d, -1)
                yield from _stated(batch.column("block")[k], batch.column("ids")[k], batch.column("r")[k], y, np.zeros(y.shape), np.ones(y.shape), np.inf).to_batches()

    divided = written(_divisors(built, points, plan, alone), "divisors")
    total = 2 * (divided.agg(F.sum("total")).first()[0] or 0.0)
    state, facts = _observed(divided.mapInArrow(begin, _FACTS), "state", d)
    discard(points, divided)
    shift = [0.0] * d
    tiles = built.select("tile", "n", "i", "j", "forth", "back").repartitionById(plan.tiles, "tile").persist()
    whole = plan.bits == 0 and d < 3 and total > 0
    for it in range(0, params.max_iter, CHAINED if whole else 1):
        before = state
        if whole:
            for k in range(it, min(it + CHAINED, params.max_iter)):
                state = _chained(tiles, state, plan, params, k, total)
            state, facts = _observed(state, "state", d)
            discard(before)
            shift = facts["mean"] if params.recenter else shift
            if params.tolerance and facts["most"] < params.tolerance:
                break
            continue
        alpha, momentum = schedule(it, params)
        own = state.select("block", "n", "ids", "y", "u", "g", "r")
        pulls = _pulls(tiles, own, plan, d, alpha / total if total else 0.0)
        low, high = facts["low"], facts["high"]
        grid = _grid(low, high, params.grid_step)
        grid = grid if (grid[1] + 2) ** d <= DENSE_CELLS else None
        if not grid:
            push = _blocks(forces.repulse_grid(_rows(own, d, [0.0] * d), params.grid_step), plan, [f"f{k}" for k in range(d)], "push")
            own = own.join(push.select("block", "push").hint("merge"), "block")
        elif plan.bits:
            own = own.join(F.broadcast(_potential(own, d, low, high, params.grid_step)))  # one row, of a bounded grid
        moved = _by(own, "block", plan.blocks).cogroup(_by(pulls, "block", plan.blocks)).applyInArrow(_step(params, momentum, shift, low, grid), _FACTS)
        state, facts = _observed(moved, "state", d)
        discard(before)
        shift = facts["mean"] if params.recenter else shift
        if params.tolerance and (facts["most"] is None or facts["most"] < params.tolerance):
            break
    if (_grid(facts["low"], facts["high"], params.grid_step)[1] + 2) ** d <= DENSE_CELLS:
        zeta = _potential(state, d, facts["low"], facts["high"], params.grid_step).first().zeta
    else:
        zeta = forces.repulse_grid(_rows(state, d, [0.0] * d), params.grid_step).agg(F.first("zeta")).first()[0]
    cost = _cost(tiles, state, plan, d, total, zeta)
    out = written(_rows(state, d, shift).withColumn("cost", F.lit(cost)), "embedding")
    tiles.unpersist()
    discard(state, built)
    return out


class Joint:
    """The symmetric joint distribution of edges, stochastic or not, over the vertices of coords, as tiles: forces and costs move
    vertices, and packed edges once. lost: some edges end at no vertex, or none has a weight; then it holds nothing."""

    def __init__(self, edges: DataFrame, coords: DataFrame):
        packs = packed(edges, fold=False)
        self.coords, self.d = coords, forces.dims(coords)
        self.plan = Plan(pairs(packs), coords.count(), packs.sparkSession.sparkContext.defaultParallelism)
        points = written(_blocks(coords, self.plan, [f"y{k}" for k in range(self.d)], "y"), "points")
        self.built, self.points, self.total = _built(packs, points, self.plan), None, 0.0
        if self.built.where(F.size("lost") > 0).isEmpty():
            self.points = written(_divisors(self.built, points, self.plan, True), "divisors")
            self.total = 2 * (self.points.agg(F.sum("total")).first()[0] or 0.0)
        discard(packs, points)
        self.lost = not self.total > 0
        if self.lost:
            self.close()

    def _state(self, coords: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The tiles, and coords of the same vertices by block."""
        tiles = self.built.select("tile", "n", "i", "j", "forth", "back").repartitionById(self.plan.tiles, "tile")
        own = self.points.select("block", "n", "ids", "y", "r")
        if coords is not self.coords:
            new = _blocks(coords, self.plan, [f"y{k}" for k in range(self.d)], "y").select("block", F.col("ids").alias("these"), "y")
            own = own.drop("y").join(new.hint("merge"), "block", "left")
            same = F.when(F.col("ids").eqNullSafe(F.col("these")), F.col("y")).otherwise(F.raise_error(F.lit("other vertices than those of the joint distribution")))
            own = own.select("block", "n", "ids", same.alias("y"), "r")
        return tiles, own

    def pull(self, coords: DataFrame) -> DataFrame:
        """forces.attract() for every vertex."""
        (tiles, own), d = self._state(coords), self.d

        def run(key: tuple, block: pa.Table, pulls: pa.Table) -> pa.Table:
            ids = np.concatenate([_array(v) for v in block.column("ids")] or [np.zeros(0)]).astype(np.int64)
            force = sum((_array(v).astype(float).reshape(d, -1) for v in pulls.column("force")), np.zeros((d, len(ids))))
            return pa.table({"id": ids} | {f"f{k}": force[k] for k in range(d)})

        pulls = _pulls(tiles, own, self.plan, d, 1 / self.total)
        met = _by(own.select("block", "ids"), "block", self.plan.blocks).cogroup(_by(pulls, "block", self.plan.blocks))
        return met.applyInArrow(run, "id long, " + ", ".join(f"f{k} double" for k in range(d)))

    def cost(self, coords: DataFrame, zeta: float, alpha: float = 1.0) -> float:
        """forces.kl_cost() with this zeta."""
        tiles, own = self._state(coords)
        return _cost(tiles, own, self.plan, self.d, self.total / alpha, zeta)

    def close(self) -> None:
        discard(self.built, self.points)
