"""Elimination trees of sparse symmetric matrices, and what follows from them, for the order of the vertices' ids.

parent(j) is the least i > j that a path of vertices up to j joins with j. It depends only on which vertices the edges up to
each i connect, so any part of the edges can be replaced by the forest that it makes alone: batches of edges become forests,
whose edges are merged range by range of ids. In a range, a vertex below it gets its first neighbour there as parent, and stands
for it from then on; what is left has both ends in the range, and one task with RANGE entries joins it. After a
range, each vertex is replaced by the root of its tree in the edges of later ones.

Postorders come from ranking the tree's tour by pointer doubling, lowest common ancestors from tables of 2 ** k-th ancestors:
some log n joins, whatever the tree's height. Children, and neighbours, of one vertex are ordered in blocks, so none is a
single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators import linalg
from filigree.operators.state import counted, discard, written

#: Ids that one task joins.
RANGE = 1 << 20
#: Edges that become one forest before any are merged.
BATCH = 1 << 20
#: Rows of one key that are ordered in one block, in bits of the order.
BLOCK_BITS = 16


def lower(edges: DataFrame) -> DataFrame:
    """lo, hi of every edge once, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


def join_edges(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1: none) of 0 .. n - 1, and the root of each, for edges ascending by hi. Ways to the root are shortened."""
    parent, above = [-1] * n, list(range(n))
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        while (up := above[a]) != a:  # the way from a to its root, each step of it set to b
            above[a] = b
            if up == b:
                break
            a = up
        else:
            if a != b:
                parent[a] = above[a] = b
    roots = np.array(above, np.int64)
    while not np.array_equal(again := roots[roots], roots):
        roots = again
    return np.array(parent, np.int64), roots


def forest_edges(pairs: DataFrame) -> DataFrame:
    """pairs(lo, hi) with batches of them replaced by the edges of the forests that they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            lo, hi = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("lo", "hi"))
            order = np.argsort(hi, kind="stable")
            ids = np.unique(np.concatenate([lo, hi]))
            parent, _ = join_edges(np.searchsorted(ids, lo[order]), np.searchsorted(ids, hi[order]), len(ids))
            own = np.flatnonzero(parent >= 0)
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[parent[own]])], ["lo", "hi"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                yield made()
                held = []
        if held:
            yield made()

    return pairs.mapInArrow(run, "lo long, hi long")


def _joined_range(first: int):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo").to_numpy() - first, table.column("hi").to_numpy() - first
        order = np.argsort(hi, kind="stable")
        parent, roots = join_edges(lo[order], hi[order], RANGE)
        own = np.unique(np.concatenate([lo, hi]))
        return pa.table({"id": own + first, "parent": pa.array(parent[own] + first, pa.int64(), mask=parent[own] < 0), "root": roots[own] + first})

    return run


def tree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id and parent (null: none) of all vertices(id), written. Ids are not negative; edges may have either direction, repeats and
    loops, and end at vertices alone."""
    block = lambda c: F.floor(F.col(c) / RANGE).cast("long")
    rest = written(forest_edges(lower(edges)).distinct(), "forest")
    found: list[DataFrame] = []
    for b in sorted(r.b for r in rest.select(block("hi").alias("b")).distinct().collect()):
        own = rest.where(block("hi") == b)
        below = written(own.where(block("lo") < b).groupBy(F.col("lo").alias("id")).agg(F.min("hi").alias("parent")), "below")
        moved = own.join(below.withColumnRenamed("id", "lo"), "lo").where("hi > parent").select(F.col("parent").alias("lo"), "hi")
        inner = own.where(block("lo") == b).select("lo", "hi").unionByName(moved).distinct()
        inside = written(inner.groupBy(F.lit(1).alias("one")).applyInArrow(_joined_range(b * RANGE), "id long, parent long, root long"), "inside")
        found += [below, inside]
        roots = inside.select("id", "root")
        lower_roots = below.join(roots.withColumnRenamed("id", "parent"), "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
        later = rest.where(block("hi") > b)
        left = later.join(roots.unionByName(lower_roots).withColumnRenamed("id", "lo"), "lo", "left").select(F.coalesce("root", "lo").alias("lo"), "hi").distinct()
        before, rest = rest, written(left, "forest")
        discard(before)
    parents = None
    for table in found:
        own = table.where("parent IS NOT NULL").select("id", "parent")
        parents = own if parents is None else parents.unionByName(own)
    out = vertices.select("id").distinct()
    out = out.withColumn("parent", F.lit(None).cast("long")) if parents is None else out.join(parents, "id", "left")
    out = written(out, "tree")
    discard(rest, *found)
    return out


def before(rows: DataFrame, key: str, order: str, value: str, ahead: bool = False) -> DataFrame:
    """rows with prev: value of the row before it (with ahead: behind it) in the order, a whole number, among those of its
    key; null for the first. Keys are ordered in blocks, and only the blocks' ends meet."""
    step = F.lead if ahead else F.lag
    end = F.min if ahead else F.max
    own = rows.withColumn("_block", F.shiftright(order, BLOCK_BITS))
    ends = own.groupBy(key, "_block").agg(end(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias("_end"))
    over = Window.partitionBy(key).orderBy("_block")
    ends = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), step("_end").over(over).alias("_from"))
    inside = own.withColumn("_in", step(value).over(Window.partitionBy(key, "_block").orderBy(order)))
    return inside.join(ends, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b"))).withColumn("prev", F.coalesce("_in", "_from")).select(*rows.columns, "prev")


def postorder(parents: DataFrame) -> DataFrame:
    """id, parent, post (from 1) and first, the least post among its descendants and itself; children by id, written."""
    nodes = parents.withColumn("_up", F.coalesce("parent", F.lit(-1)))
    siblings = before(nodes, "_up", "id", "id", ahead=True)
    heads = nodes.groupBy("_up").agg(F.min("id").alias("child")).withColumnRenamed("_up", "id")
    down = nodes.join(heads, "id", "left").select((2 * F.col("id")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("to"), F.lit(0).cast("long").alias("n"))
    up = siblings.select((2 * F.col("id") + 1).alias("e"), F.coalesce(2 * F.col("prev"), 2 * F.col("parent") + 1).alias("to"), F.lit(1).cast("long").alias("n"))
    total = parents.count()
    tour = written(down.unionByName(up), "tour", F.col("to").isNotNull(), 2 * total)
    while counted(tour):
        last = tour
        tour = written(last.join(last.select(F.col("e").alias("to"), F.col("to").alias("t"), F.col("n").alias("m")), "to", "left").select("e", F.col("t").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "tour", F.col("to").isNotNull(), 2 * total)
        discard(last)
    ups = tour.where("e % 2 = 1").select(F.shiftright("e", 1).alias("id"), (F.lit(total + 1) - F.col("n")).alias("post"))
    downs = tour.where("e % 2 = 0").select(F.shiftright("e", 1).alias("id"), (F.lit(total + 1) - F.col("n")).alias("first"))
    out = written(parents.select("id", "parent").join(ups, "id").join(downs, "id"), "postorder", rows=total)
    discard(tour)
    return out


def ancestors_before(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """pairs(a, limit, ..) with lca: the lowest ancestor of a whose post is at least limit, by tables of 2 ** k-th ancestors."""
    own, n = order.select("id", "parent").where("parent IS NOT NULL"), order.count()
    jump = written(own.join(order.select(F.col("id").alias("parent"), F.col("post").alias("up")), "parent").select("id", F.col("parent").alias("to"), "up"), "jump", rows=n)
    jumps = []
    while counted(jump):
        jumps.append(jump)
        jump = written(jump.select("id", F.col("to").alias("mid")).join(jump.select(F.col("id").alias("mid"), "to", "up"), "mid").select("id", "to", "up"), "jump", rows=n)
    rows = pairs.withColumn("at", F.col("a"))
    for table in reversed(jumps):
        rows = rows.join(table.select(F.col("id").alias("at"), "to", "up"), "at", "left").withColumn("at", F.when(F.col("up") < F.col("limit"), F.col("to")).otherwise(F.col("at"))).select(*pairs.columns, "at")
    rows = written(rows.join(own.select(F.col("id").alias("at"), F.col("parent").alias("lca")), "at", "left").select(*pairs.columns, "lca"), "lca")
    discard(jump, *jumps)
    return rows


def column_counts(edges: DataFrame, vertices: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """id and n, the entries of its column in the matrix's factor, the diagonal with them. The rows' subtrees are counted by
    their leaves and where these meet, without making them."""
    own = tree(edges, vertices) if parents is None else parents
    order = postorder(own)
    posts = order.select(F.col("id").alias("lo"), "post", "first")
    near = before(lower(edges).join(posts, "lo"), "hi", "post", "post")
    leaves = written(near.where("prev IS NULL OR first > prev").select(F.col("lo").alias("id"), F.col("hi").alias("row"), "post", "prev"), "leaves")
    met = leaves.where("prev IS NOT NULL").join(order.select(F.col("post").alias("prev"), F.col("id").alias("a")), "prev").select("a", F.col("post").alias("limit"))
    meets = ancestors_before(met, order)
    alone = vertices.select("id").distinct().join(leaves.select(F.col("row").alias("id")), "id", "left_anti")
    weights = leaves.select("id", F.lit(1).alias("x")).unionAll(alone.select("id", F.lit(1))).unionAll(meets.select("lca", F.lit(-1))).unionAll(order.where("parent IS NOT NULL").select("parent", F.lit(-1)))
    summed = order.join(weights.groupBy("id").agg(F.sum("x").cast("double").alias("x")), "id", "left")
    runs = written(linalg.running_sums(summed.select(F.col("post").alias("id"), F.coalesce("x", F.lit(0.0)).alias("x"))), "runs")
    last, first = runs.select(F.col("id").alias("post"), F.col("x").alias("upto")), runs.select((F.col("id") + 1).alias("first"), F.col("x").alias("ahead"))
    out = order.join(last, "post").join(first, "first", "left").select("id", (F.col("upto") - F.coalesce("ahead", F.lit(0.0))).cast("long").alias("n"))
    out = written(out, "counts")
    discard(order, leaves, meets, runs)
    if parents is None:
        discard(own)
    return out
