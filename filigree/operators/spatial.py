"""An order of points by a tree over their space, and the blocks of a matrix that it makes.

The tree is that of the tree code: cells are divided until they have at most leaf_points positions, however the points
crowd. Leaves beside one another that are all small, each of at most a share of leaf_points so that they fit together, become one
block. Blocks follow one another along the Morton curve, so near points have near positions, and most entries of a
neighbour matrix fall into few pairs of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import ordering, treecode
from filigree.operators.forces import dims
from filigree.operators.state import discard, written


def blocks(coords: DataFrame, leaf_points: int) -> DataFrame:
    """id, code, level, cell and merged: the block of each point, a leaf or, if merged, all small leaves below a cell."""
    d = dims(coords)
    names = [f"y{j}" for j in range(d)]
    places = written(treecode.positions(coords), "positions")
    leaves = written(treecode.tree(places, leaf_points).where("NOT open").select("level", "cell", "k"), "leaves")
    small = (F.col("k") * (1 << d) <= leaf_points) & (F.col("level") > 0)
    levels = [r.level for r in leaves.select("level").distinct().collect()]
    at = places.withColumn("level", F.explode(F.lit(levels or [0]))).withColumn("cell", treecode._prefix(F.col("code"), F.col("level"), d))
    own = at.join(leaves, ["level", "cell"]).select(*names, "code", F.when(small, F.col("level") - 1).otherwise(F.col("level")).alias("level"), F.when(small, F.shiftright("cell", d)).otherwise(F.col("cell")).alias("cell"), small.alias("merged"))
    out = written(coords.join(own, names).select("id", "code", "level", "cell", "merged"), "blocks")
    discard(places, leaves)
    return out


def spatial_order(coords: DataFrame, leaf_points: int) -> DataFrame:
    """id, block (its least code, and whether it is merged) and position (0, 1, ..) of each point: blocks along the curve, points of
    one by their codes, then ids."""
    own = blocks(coords, leaf_points)
    starts = own.groupBy("level", "cell", "merged").agg(F.min("code").alias("start"))
    digits = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    named = own.join(starts, ["level", "cell", "merged"]).select("id", F.concat_ws(":", digits("start"), F.col("merged").cast("int"), digits("code")).alias("path"))
    out = ordering.positions(named).select("id", F.substring_index("path", ":", 2).alias("block"), "position")
    out = written(out, "order")
    discard(own)
    return out


def block_pairs(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Entries of a matrix for each pair of blocks(id, level, cell, merged): the level, cell and merged of both, and nnz."""
    one, two = (own.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("level", "cell", "merged")]) for c in ("src", "dst"))
    keys = [f"{c}_{x}" for c in ("src", "dst") for x in ("level", "cell", "merged")]
    return edges.join(one, "src").join(two, "dst").groupBy(*keys).agg(F.count("*").alias("nnz"))
