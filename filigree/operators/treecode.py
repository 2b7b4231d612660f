"""Repulsion by a tree of cells, with an opening angle.

Equal positions become one with a multiplicity. Cells are prefixes of Morton codes, 2 ** d children each, with the number of
their points, their centroid and their tight box; a cell of at most LEAF_POINTS positions is a leaf. Leaves are the targets:
from the root down, level by level, the pairs (leaf, cell) of a level meet the level's cells in one join. A cell whose longest side
is less than theta times the distance of its centroid from the leaf's box counts as one point; a leaf that is nearer
counts by its points; any other cell gives way to its children. So there are some log n / theta ** d pairs for a leaf, and
with theta 0, which gives the exact sums, all pairs of leaves: these are not made into rows, groups of points meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.forces import dims, repulse_exact
from filigree.operators.state import discard, written

LEAF_POINTS = 32
#: Levels below the root: cells of a millionth of the extent are not divided, and their points not limited.
DEPTH = 20
#: Cells of a level up to which these are sent to all executors; upper levels have few cells, which all leaves meet.
BROADCAST_CELLS = 20_000
#: Rows that a leaf meets in one group; leaves with more (small theta) are dealt over several groups.
GROUP_ROWS = 20_000
#: Pairs of positions that are compared at once.
PAIRS = 1 << 20


def morton_code(cells: Sequence[Column], bits: int) -> Column:
    """The interleaved bits of whole numbers, the first one's lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * len(cells) + k))
    return out


def positions(coords: DataFrame) -> DataFrame:
    """Distinct positions y0 .. with their number of points m and their code at the finest level."""
    d = dims(coords)
    names = [f"y{k}" for k in range(d)]
    own = coords.groupBy(*names).agg(F.count("*").cast("double").alias("m"))
    r = coords.agg(*[F.min(c) for c in names], *[F.max(c) for c in names]).first()
    low = [0.0 if r[k] is None else r[k] for k in range(d)]
    extent = max((r[d + k] - r[k] for k in range(d) if r[k] is not None), default=0.0) or 1.0
    cells = [F.least(F.floor((F.col(c) - low[k]) / extent * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long") for k, c in enumerate(names)]
    return own.withColumn("code", morton_code(cells, DEPTH))


def tree(places: DataFrame, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """level, cell, n (points), k (positions), centroid x0 .., box a0 .. b0 .., and whether it has children. Finest cells are summed
    up once, and their sums go to all levels, so no level reads the points again."""
    d = sum(c.startswith("y") for c in places.columns)
    span = range(d)
    finest = places.groupBy("code").agg(F.sum("m").alias("n"), F.count("*").alias("k"), *[F.sum(F.col("m") * F.col(f"y{j}")).alias(f"x{j}") for j in span], *[F.min(f"y{j}").alias(f"a{j}") for j in span], *[F.max(f"y{j}").alias(f"b{j}") for j in span])
    at = finest.withColumn("level", F.explode(F.lit(list(range(DEPTH + 1))))).withColumn("cell", _prefix(F.col("code"), F.col("level"), d))
    sums = at.groupBy("level", "cell").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), *[F.sum(f"x{j}").alias(f"x{j}") for j in span], *[F.min(f"a{j}").alias(f"a{j}") for j in span], *[F.max(f"b{j}").alias(f"b{j}") for j in span])
    sums = sums.select("level", "cell", "n", "k", *[(F.col(f"x{j}") / F.col("n")).alias(f"x{j}") for j in span], *[f"{c}{j}" for c in "ab" for j in span], ((F.col("k") > leaf_points) & (F.col("level") < DEPTH)).alias("open"))
    # a cell whose parent is no parent has at most leaf_points positions, and only one of its ancestors is a leaf
    full = sums.where("open").select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    below = sums.withColumn("parent", F.shiftright("cell", d)).join(full, ["level", "parent"], "left_semi").drop("parent")
    return sums.where("level = 0").unionByName(below)


def _prefix(code: Column, level: Column, d: int) -> Column:
    return F.call_function("shiftright", code, (F.lit(DEPTH) - level) * d)


def _packed(places: DataFrame, leaves: DataFrame, d: int, leaf_points: int) -> DataFrame:
    """level, cell and part of each leaf with its positions and multiplicities as one flat array. Finest cells can have more
    than leaf_points positions; these are dealt over several parts."""
    levels = [r.level for r in leaves.select("level").distinct().collect()]
    at = places.withColumn("level", F.explode(F.lit(levels or [0]))).withColumn("cell", _prefix(F.col("code"), F.col("level"), d))
    own = at.join(leaves.select("level", "cell", "k"), ["level", "cell"])
    names = [f"y{j}" for j in range(d)]
    part = F.pmod(F.xxhash64(*names), F.ceil(F.col("k") / leaf_points))
    return own.groupBy("level", "cell", part.alias("part")).agg(F.flatten(F.collect_list(F.array(*names, "m"))).alias("points"))


def _walk(nodes: DataFrame, d: int, theta: float) -> list[DataFrame]:
    """For each level a written table of pairs: the leaf tl, tc with its box, the cell level, cell with n and centroid,
    and whether it is far, or open."""
    counts = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    box = [f"{c}{j}" for c in "ab" for j in range(d)]
    target = nodes.where("NOT open").select(F.col("level").alias("tl"), F.col("cell").alias("tc"), *[F.col(c).alias(f"t{c}") for c in box])
    beside = [F.greatest(F.col(f"ta{j}") - F.col(f"x{j}"), F.col(f"x{j}") - F.col(f"tb{j}"), F.lit(0.0)) for j in range(d)]
    distance = F.sqrt(reduce(lambda a, b: a + b, (x * x for x in beside)))
    sides = [F.col(f"b{j}") - F.col(f"a{j}") for j in range(d)]
    far = (F.greatest(*sides) if d > 1 else sides[0]) < theta * distance
    pairs, out = target.withColumn("cell", F.lit(0).cast("long")), []
    for level in range(max(counts, default=-1) + 1):
        own = nodes.where(F.col("level") == level).drop("k")
        met = pairs.join(F.broadcast(own) if counts.get(level, 0) <= BROADCAST_CELLS else own, "cell").withColumn("far", far)
        met = written(met.select("tl", "tc", *[f"t{c}" for c in box], "level", "cell", "n", *[f"x{j}" for j in range(d)], "far", "open"), f"walk-{level}")
        out.append(met)
        child = F.explode(F.transform(F.lit(list(range(1 << d))), lambda c: F.shiftleft(F.col("cell"), d) + c))
        pairs = met.where("open AND NOT far").select("tl", "tc", *[f"t{c}" for c in box], child.alias("cell"))
    return out


def _sums(targets: pa.Table, sources: pa.Table, d: int) -> pa.Table:
    """For each position of a leaf the sums of w q and of w q^2 (y - x) over the weighted points x of the sources."""

    def points(table: pa.Table, column: str) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in table.column(column).chunks)]).reshape(-1, d + 1)

    y, x = points(targets, "points"), points(sources, "points")
    total = np.zeros((len(y), d + 1))
    step = max(1, PAIRS // max(1, len(y)))
    for k in range(0, len(x), step):
        own = x[k : k + step]
        diff = y[:, None, :d] - own[None, :, :d]
        q = 1 / (1 + (diff * diff).sum(2))
        total[:, 0] += q @ own[:, d]
        total[:, 1:] += (diff * (q * q * own[:, d])[:, :, None]).sum(1)
    arrays = [pa.array(y[:, j]) for j in range(d + 1)] + [pa.array(total[:, j]) for j in range(d + 1)]
    return pa.Table.from_arrays(arrays, [*(f"y{j}" for j in range(d)), "m", "s", *(f"g{j}" for j in range(d))])


def repulse_tree(coords: DataFrame, theta: float = 0.5, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """id, forces sum q^2 (y_i - y_j) / zeta, and zeta, by the tree. Smaller theta is nearer to the exact sums, 0 equal to them.
    The result is a written table; what leads to it is deleted."""
    d = dims(coords)
    names = [f"y{j}" for j in range(d)]
    if theta == 0:  # no cell is far
        coords = coords.select("id", *names)
        exact = repulse_exact(coords)
        push = exact.select(F.col("id").cast(coords.schema["id"].dataType).alias("id"), *[f"f{j}" for j in range(d)], "zeta")
        out = written(coords.select("id").join(push, "id", "left").fillna(0.0), "repulsion")  # one place has no push
        discard(exact)
        return out
    places = written(positions(coords), "positions")
    nodes = written(tree(places, leaf_points), "cells")
    packed = written(_packed(places, nodes.where("NOT open"), d, leaf_points), "leaves")
    walk = _walk(nodes, d, theta)
    kind = ["level", "cell", "part"]
    target = packed.select(F.col("level").alias("tl"), F.col("cell").alias("tc"), "points")
    rows = None
    if walk:
        met = reduce(DataFrame.unionByName, walk)
        alone = met.where("far").select("tl", "tc", F.col("cell").alias("salt"), F.array(*[f"x{j}" for j in range(d)], "n").alias("points"))
        near = met.where("NOT far AND NOT open").select("tl", "tc", "level", "cell")
        most = alone.select("tl", "tc").unionByName(near.join(packed.select("level", "cell"), ["level", "cell"]).select("tl", "tc")).groupBy("tl", "tc").count().agg(F.max("count")).first()[0] or 0
        ways = 1 + most // GROUP_ROWS
        close = near.join(packed, ["level", "cell"]).select("tl", "tc", F.xxhash64(*kind).alias("salt"), "points")
        sources = alone.unionByName(close).select("tl", "tc", F.pmod(F.xxhash64("salt"), F.lit(ways)).alias("way"), "points")
        targets = target.withColumn("way", F.explode(F.lit(list(range(ways))).cast("array<long>")))
        keys = ["tl", "tc", "way"]
        schema = ", ".join(f"{c} double" for c in [*names, "m", "s", *(f"g{j}" for j in range(d))])
        rows = targets.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInArrow(lambda a, b: _sums(a, b, d), schema)
        if ways > 1:
            rows = rows.groupBy(*names, "m").agg(F.sum("s").alias("s"), *[F.sum(f"g{j}").alias(f"g{j}") for j in range(d)])
    if rows is None:
        return coords.select("id", *[F.lit(0.0).alias(f"f{j}") for j in range(d)], F.lit(0.0).alias("zeta")).limit(0)
    rows = written(rows, "sums")
    zeta = rows.agg(F.sum(F.col("m") * (F.col("s") - 1)).alias("zeta"))
    out = coords.join(rows, names).join(F.broadcast(zeta)).select("id", *[(F.when(F.col("zeta") > 0, F.col(f"g{j}") / F.col("zeta")).otherwise(0.0)).alias(f"f{j}") for j in range(d)], "zeta")  # one row
    out = written(out, "repulsion")
    discard(places, nodes, packed, rows, *walk)
    return out
