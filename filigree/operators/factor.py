"""Sparse Cholesky factors along a nested dissection, and solutions by them.

Each part that is not cut any more, and each separator, is a front: a dense block with a column for each of its vertices and
a row for these and for the later vertices that they touch. All fronts of a step of the dissection are factored at once, each a
group, in numpy: A11 = L11 L11', L21 = A21 inverse(L11'). Below the first cuts, whole subtrees of at most SUBTREE vertices are
one group and one step, which goes through its fronts in order. What they take away from later columns, L21 L21', goes as rows to
the fronts that have these columns, and is summed up there. Parts have ordering.LEAF vertices; a separator's front is
as large as the separator and what it touches, which is what a dissection keeps small.

Solving goes over the same steps: forward from the parts to the first cut, and back, one join of the front's blocks with the
vector for each step, of which there are twice as many as cuts on top of each other, whatever the number of vertices.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import ordering
from filigree.operators.state import discard, gathered, written

_FRONT = "node string, kind string, i long, j long, v double"


@dataclass(frozen=True)
class Factor:
    """order(id, path, position), lower(i, j, v, node) by positions, the steps in the order of elimination, and the
    letters of a path that name a subtree's group."""

    order: DataFrame
    lower: DataFrame
    steps: list[int]
    depth: int

    def close(self) -> None:
        discard(self.order, self.lower)


#: Vertices of a subtree of the dissection that is one group.
SUBTREE = 4096


def step_of(path) -> F.Column:
    """The step of a front, greater ones first: a separator's comes behind all that its cut has parted."""
    return 2 * F.length(path) - (F.right(path, F.lit(1)) == "2").cast("int")


def _depth(order: DataFrame) -> int:
    """The least length of prefixes that no more than SUBTREE vertices share."""
    paths = order.groupBy("path").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.length("path"))))
    wide = paths.groupBy("k", F.expr("left(path, k)").alias("prefix")).agg(F.sum("n").alias("n")).where(F.col("n") > SUBTREE)
    last = wide.agg(F.max("k")).first()[0]
    return 0 if last is None else last + 1


def _home(path, depth: int) -> F.Column:
    """The group of a front: its subtree's, or its own."""
    return F.left(path, F.lit(depth))


def _grouped_step(path, depth: int) -> F.Column:
    return F.least(step_of(path), F.lit(2 * depth))


def _dense(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and rows (these columns first) of a front, and its entries, added up, as a dense block."""
    columns = np.unique(j)
    rows = np.concatenate([columns, np.setdiff1d(i, columns)])
    block = np.zeros((len(rows), len(columns)))
    order = np.argsort(rows, kind="stable")
    np.add.at(block, (order[np.searchsorted(rows, i, sorter=order)], np.searchsorted(columns, j)), v)
    return columns, rows, block


def _fronts(table: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """node, i, j and v of the fronts of a group in the order of elimination."""
    nodes = table.column("node").combine_chunks().dictionary_encode()
    names, number = nodes.dictionary.to_pylist(), nodes.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(len(names) + 1))
    i, j, v = (table.column(c).to_numpy()[order] for c in "ijv")
    parts = [(name, *(a[ends[k] : ends[k + 1]] for a in (i, j, v))) for k, name in enumerate(names)]
    return sorted(parts, key=lambda part: (part[0][-1:] == "2") - 2 * len(part[0]))


def _factored(key: tuple, table: pa.Table) -> pa.Table:
    """L of a group's fronts (kind L), and what they take away from the columns of later groups (kind U)."""
    fronts = _fronts(table)
    own = np.concatenate([np.unique(j) for _, _, j, _ in fronts])
    home = np.repeat(np.arange(len(fronts)), [len(np.unique(j)) for _, _, j, _ in fronts])
    order = np.argsort(own)
    own, home = own[order], home[order]
    waiting: list[list] = [[part[1:]] for part in fronts]
    found, rest = [], []
    for k, (node, _, _, _) in enumerate(fronts):
        columns, rows, block = _dense(*(np.concatenate(a) for a in zip(*waiting[k], strict=True)))
        waiting[k], n = [], len(columns)
        pivot = np.linalg.cholesky(np.tril(block[:n]) + np.tril(block[:n], -1).T)
        below = np.linalg.solve(pivot, block[n:].T).T
        low = np.concatenate([pivot, below])
        li, lj = np.nonzero(low)
        found.append((node, rows[li], columns[lj], low[li, lj]))
        ui, uj = np.nonzero(rows[n:, None] >= rows[None, n:])
        i, j, v = rows[n:][ui], rows[n:][uj], -(below @ below.T)[ui, uj]
        at = np.minimum(np.searchsorted(own, j), len(own) - 1)
        to = np.where(own[at] == j, home[at], -1)
        for t in np.unique(to):
            (waiting[t] if t >= 0 else rest).append((i[to == t], j[to == t], v[to == t]))
    i, j, v = (np.concatenate(a) for a in zip(*[part[1:] for part in found], *rest, strict=True))
    inner = sum(len(part[1]) for part in found)
    node = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(found) + 1, dtype=np.int32), [*(len(part[1]) for part in found), len(i) - inner])), pa.array([*(part[0] for part in found), ""])).cast(pa.string())
    kind = pa.DictionaryArray.from_arrays(pa.array((np.arange(len(i)) >= inner).astype(np.int32)), pa.array(["L", "U"])).cast(pa.string())
    return pa.Table.from_arrays([node, kind, pa.array(i), pa.array(j), pa.array(v)], ["node", "kind", "i", "j", "v"])


def cholesky(edges: DataFrame, vertices: DataFrame, order: DataFrame | None = None) -> Factor:
    """The factor of a symmetric positive definite matrix edges(src, dst, w), both halves and the diagonal given, over
    vertices(id). Without an order(id, path, position) it is that of the nested dissection. A matrix that is not positive definite
    is an error of a front's task."""
    order = written(ordering.nested_dissection(edges, vertices) if order is None else order, "order")
    depth = _depth(order)
    place = order.select(F.col("id").alias("src"), F.col("position").alias("j"), F.col("path").alias("node"))
    rows = edges.join(place, "src").join(order.select(F.col("id").alias("dst"), F.col("position").alias("i")), "dst")
    todo = written(rows.where("i >= j").groupBy("node", "i", "j").agg(F.sum("w").alias("v")).withColumn("step", _grouped_step(F.col("node"), depth)), "entries")
    homes = order.select(F.col("position").alias("j"), F.col("path").alias("node"))
    steps = sorted((r.step for r in order.select(_grouped_step(F.col("path"), depth).alias("step")).distinct().collect()), reverse=True)
    done: list[DataFrame] = []
    for k, step in enumerate(steps):
        made = written(todo.where(F.col("step") == step).select("node", "i", "j", "v").groupBy(_home(F.col("node"), depth)).applyInArrow(_factored, _FRONT), "fronts")
        if k + 1 < len(steps):
            taken = made.where("kind = 'U'").groupBy("i", "j").agg(F.sum("v").alias("v")).join(homes, "j").withColumn("step", _grouped_step(F.col("node"), depth))
            later = todo.where(F.col("step") < step).unionByName(taken.select("node", "i", "j", "v", "step"))
            last, todo = todo, written(later.groupBy("node", "i", "j", "step").agg(F.sum("v").alias("v")), "entries")
            discard(last)
        done = gathered(done, made, "factors")
    whole = reduce(DataFrame.unionByName, done).where("kind = 'L'").select("i", "j", "v", "node") if done else todo.select("i", "j", "v", "node")
    lower = written(whole, "factor")
    discard(todo, *done)
    return Factor(order, lower, steps, depth)


def lower_edges(factor: Factor) -> DataFrame:
    """L as edges(src column, dst row, w) over the vertices' ids."""
    one, two = (factor.order.select(F.col("position").alias(k), F.col("id").alias(c)) for k, c in (("j", "src"), ("i", "dst")))
    return factor.lower.join(one, "j").join(two, "i").select("src", "dst", F.col("v").alias("w"))


def _held(blocks: pa.Table, vector: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a group's fronts, and their values (0 where the vector has none)."""
    rows = np.unique(blocks.column("i").to_numpy())
    x = np.zeros(len(rows))
    np.add.at(x, np.searchsorted(rows, vector.column("at").to_numpy()), vector.column("x").to_numpy())
    return rows, x


def _ahead(key: tuple, blocks: pa.Table, vector: pa.Table) -> pa.Table:
    """x of a group's columns (own), and what they take away from later rows."""
    held, x = _held(blocks, vector)
    own = np.zeros(len(held), bool)
    for _, i, j, v in _fronts(blocks):
        columns, rows, block = _dense(i, j, v)
        n, at = len(columns), np.searchsorted(held, rows)
        x[at[:n]], own[at[:n]] = np.linalg.solve(np.tril(block[:n]), x[at[:n]]), True
        x[at[n:]] -= block[n:] @ x[at[:n]]
    return pa.table({"i": held, "x": x, "own": own})


def _behind(key: tuple, blocks: pa.Table, vector: pa.Table) -> pa.Table:
    """x of a group's columns, from their own values and those of the later rows that it has."""
    held, x = _held(blocks, vector)
    own = np.zeros(len(held), bool)
    for _, i, j, v in reversed(_fronts(blocks)):
        columns, rows, block = _dense(i, j, v)
        n, at = len(columns), np.searchsorted(held, rows)
        x[at[:n]], own[at[:n]] = np.linalg.solve(np.tril(block[:n]).T, x[at[:n]] - block[n:].T @ x[at[n:]]), True
    return pa.table({"i": held[own], "x": x[own], "own": own[own]})


def solve(factor: Factor, b: DataFrame) -> DataFrame:
    """x(id, x) with L L' x = b for b(id, x), written; vertices that b lacks have 0."""
    home = _home(F.col("node"), factor.depth)
    fronts = factor.lower.select(home.alias("home"), "node", "i", "j", "v", _grouped_step(F.col("node"), factor.depth).alias("step"))
    start = factor.order.join(b.groupBy("id").agg(F.sum("x").alias("x")), "id", "left").select(F.col("position").alias("i"), "path", F.coalesce("x", F.lit(0.0)).alias("x"))
    state = written(start, "vector")
    for step in factor.steps:
        own = fronts.where(F.col("step") == step).drop("step")
        here = state.where(_grouped_step(F.col("path"), factor.depth) == step).select(_home(F.col("path"), factor.depth).alias("to"), F.col("i").alias("at"), "x")
        got = own.groupBy("home").cogroup(here.groupBy("to")).applyInArrow(_ahead, "i long, x double, own boolean")
        got = written(got, "ahead")
        sums = got.groupBy("i").agg(F.sum("x").alias("more"), F.max("own").alias("own"))
        value = F.when(F.col("own"), F.col("more")).otherwise(F.col("x") + F.coalesce("more", F.lit(0.0)))
        last, state = state, written(state.join(sums, "i", "left").select("i", "path", value.alias("x")), "vector")
        discard(last, got)
    for step in reversed(factor.steps):
        own = fronts.where(F.col("step") == step).drop("step")
        wanted = own.select("home", "i").distinct().join(state.select("i", "x"), "i").select(F.col("home").alias("to"), F.col("i").alias("at"), "x")
        got = own.groupBy("home").cogroup(wanted.groupBy("to")).applyInArrow(_behind, "i long, x double, own boolean")
        got = written(got.select("i", F.col("x").alias("new")), "behind")
        last, state = state, written(state.join(got, "i", "left").select("i", "path", F.coalesce("new", "x").alias("x")), "vector")
        discard(last, got)
    out = written(factor.order.join(state.select(F.col("i").alias("position"), "x"), "position").select("id", "x"), "solution")
    discard(state)
    return out


def laplacian(edges: DataFrame, vertices: DataFrame, shift: float = 1.0) -> DataFrame:
    """shift + degree on the diagonal, minus the weight elsewhere: symmetric positive definite for a symmetric graph."""
    off = edges.where("src <> dst").groupBy("src", "dst").agg((-F.sum("w")).alias("w"))
    own = vertices.select("id").distinct().join(off.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s")), "id", "left")
    return off.unionByName(own.select(F.col("id").alias("src"), F.col("id").alias("dst"), (shift - F.coalesce("s", F.lit(0.0))).alias("w")))
