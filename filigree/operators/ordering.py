"""Nested dissection of sparse symmetric graphs: an order of the vertices in which elimination fills in little.

Each part of more than PART vertices is cut in two by a multilevel scheme, all such parts of a round at once. A level is contracted
by heavy edges: every vertex names its heaviest neighbour in the part (the lighter the neighbour the better), and two that
name one another become one; those left over that name the same vertex are dealt by hash into groups of some two, so the
leaves of a hub meet each other and not the hub alone. The smallest graphs, of some COARSEST vertices a part, are cut by
the level sets of a search from a far vertex. Going back up, vertices that lower the cut change sides, one side at a time, where
the sides stay even. Of the vertices on a cut edge, those of the side with fewer become the separator.

Parts and contracted graphs that have at most GROUPED vertices and GROUPED_EDGES edges are cut by the same scheme in a group each: a
part then all the way down to PART vertices. Smaller parts are dissected to the end, a part a group, by level sets alone. A vertex's path has a letter for each cut: 0 and 1 for
the sides, 2 for the separator, so in the order of paths a separator follows both its sides.

Sums over a vertex's edges are made in parts before they are shuffled, and a hub's edges are never in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.state import counted, discard, written

#: Vertices of a part that is dissected as one group.
PART = 8192
#: Vertices of a part that its coarsest graph should have, and levels after which it is taken as it is.
COARSEST, LEVELS = 256, 60
#: Vertices and edges (both directions) of a part that is cut in one group.
GROUPED, GROUPED_EDGES = 1 << 18, 1 << 21
#: Vertices of a part that is not cut any more.
LEAF = 24
#: Share of a part that its larger side may have after a change of sides.
EVEN = 0.6


def pattern(edges: DataFrame) -> DataFrame:
    """The symmetric pattern u, v of a matrix, without its diagonal."""
    one = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


# --- contraction -------------------------------------------------------------------------------------------------
def _contracted(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """v, into: the vertex that each vertex becomes part of. edges(u, v, w) are within parts, sizes(v, n)."""
    rated = edges.join(sizes.select("v", F.col("n").alias("nv")), "v")
    rank = F.struct((F.col("w") / F.col("nv")).alias("a"), F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("b"), F.col("v").alias("c"))
    best = rated.groupBy("u").agg(F.max(rank)["c"].alias("to"))
    pairs = best.join(best.select(F.col("u").alias("to"), F.col("to").alias("u")), ["u", "to"], "left_semi").select(F.col("u").alias("v"), F.least("u", "to").alias("into"))
    rest = best.join(pairs.select(F.col("v").alias("u")), "u", "left_anti")
    ways = rest.groupBy("to").agg(F.ceil(F.count("*") / 2).alias("ways"))
    dealt = rest.join(ways, "to").withColumn("way", F.pmod(F.xxhash64("u"), F.col("ways")))
    heads = dealt.groupBy("to", "way").agg(F.min("u").alias("into"))
    groups = dealt.join(heads, ["to", "way"]).select(F.col("u").alias("v"), "into")
    return pairs.unionByName(groups)


def _coarser(edges: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contraction v, into of all vertices, and the contracted graph's edges and sizes, written."""
    into = sizes.select("v").join(_contracted(edges, sizes), "v", "left").select("v", F.coalesce("into", "v").alias("into"))
    n, m = counted(sizes), counted(edges)
    into = written(into, "into", rows=n)
    ends = edges.join(into.select(F.col("v").alias("u"), F.col("into").alias("a")), "u").join(into.select("v", F.col("into").alias("b")), "v")
    out = written(ends.where("a <> b").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "edges", rows=m)
    new = written(sizes.join(into, "v").groupBy("path", F.col("into").alias("v")).agg(F.sum("n").alias("n")), "sizes", rows=n)
    return into, out, new


# --- cuts of small graphs ----------------------------------------------------------------------------------------
class Small:
    """A graph of a few thousand vertices with whole numbers as names, as rows of neighbours."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, size: np.ndarray):
        order = np.argsort(u, kind="stable")
        self.n, self.to, self.size = n, v[order], size
        self.at = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))])

    def around(self, some: np.ndarray) -> np.ndarray:
        count = self.at[some + 1] - self.at[some]
        first = np.repeat(self.at[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return self.to[first + np.arange(count.sum())]

    def levels(self, start: int, inside: np.ndarray) -> np.ndarray:
        """Steps from start to each vertex inside; -1 where there is no way."""
        out = np.full(self.n, -1)
        out[start], front, step = 0, np.array([start]), 0
        while len(front):
            near = np.unique(self.around(front))
            front, step = near[inside[near] & (out[near] < 0)], step + 1
            out[front] = step
        return out

    def halves(self, inside: np.ndarray) -> np.ndarray:
        """Side 0 or 1 of each vertex inside: the near and the far half of the level sets from a far vertex. Components follow
        one another."""
        alone = inside & (np.bincount(np.repeat(np.arange(self.n), np.diff(self.at)), inside[self.to], self.n) == 0)
        rank, left, base = np.cumsum(alone) - 1, inside & ~alone, int(alone.sum())
        while left.any():
            start = int(np.flatnonzero(left)[0])
            for _ in range(3):
                steps = self.levels(start, left)
                start = int(np.flatnonzero(steps == steps.max())[0])
            steps = self.levels(start, left)
            seen = steps >= 0
            rank[seen] = base + steps[seen]
            base += int(steps.max()) + 1
            left &= ~seen
        own = np.flatnonzero(inside)
        weight = np.bincount(rank[own], self.size[own], base)
        ahead = np.cumsum(weight) - weight / 2
        side = (ahead > weight.sum() / 2).astype(np.int8)
        if base > 1:  # neither side is empty
            side[0], side[-1] = 0, 1
        out = np.full(self.n, -1, np.int8)
        out[own] = side[rank[own]]
        return out

    def paths(self) -> list[str]:
        """The path of each vertex in the dissection down to LEAF vertices."""
        out = [""] * self.n
        todo = [np.arange(self.n)]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                continue
            inside = np.zeros(self.n, bool)
            inside[own] = True
            side = self.halves(inside)
            if not (side == 1).any():
                continue
            edge = [own[(side[own] == s)] for s in (0, 1)]
            border = [np.array([x for x in edge[s].tolist() if (side[self.to[self.at[x] : self.at[x + 1]]] == 1 - s).any()], np.int64) for s in (0, 1)]
            s = int(len(border[1]) < len(border[0]))
            side[border[s]] = 2
            for x in own.tolist():
                out[x] += str(side[x])
            todo += [own[side[own] == s] for s in (0, 1)]
        return out


def _mixed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Numbers that look random, of two whole numbers each."""
    with np.errstate(over="ignore"):
        x = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _matched(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """_contracted() of a graph in one group, with the new vertices numbered."""
    order = np.lexsort((v, _mixed(np.minimum(u, v), np.maximum(u, v)), w / size[v], u))
    last = np.flatnonzero(np.diff(u[order], append=-1))
    best = np.full(n, -1)
    best[u[order[last]]] = v[order[last]]
    into, ids = np.arange(n), np.arange(n)
    paired = (best >= 0) & (best[best] == ids)
    into[paired] = np.minimum(ids, best)[paired]
    rest = np.flatnonzero((best >= 0) & ~paired)
    to = best[rest]
    ways = (np.bincount(to, minlength=n)[to] + 1) // 2
    key = to * np.int64(n) + (_mixed(rest, rest) % ways.astype(np.uint64)).astype(np.int64)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)  # rest rises: the first is the least
    into[rest] = rest[first][group]
    return np.unique(into, return_inverse=True)[1]


def _halved(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """_sides() of one part in one group."""
    levels = []
    while n > COARSEST:
        into = _matched(n, u, v, w, size)
        m = int(into.max()) + 1
        if m > 0.97 * n:
            break
        levels.append((into, u, v, w, size))
        a, b = into[u], into[v]
        key, group = np.unique((a * np.int64(m) + b)[a != b], return_inverse=True)
        u, v, w, size, n = key // m, key % m, np.bincount(group, w[a != b], len(key)), np.bincount(into, size, m), m
    side = Small(n, u, v, size).halves(np.ones(n, bool))
    for into, u, v, w, size in reversed(levels):
        side = side[into]
        for s in (0, 1):
            gain = np.bincount(u, np.where(side[u] == s, np.where(side[v] == s, -w, w), 0.0), len(side))
            after = np.where(gain > 0, 1 - side, side)
            if 1 - EVEN <= size[after == 0].sum() / size.sum() <= EVEN:
                side = after
    return side


def _read(vertices: pa.Table, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices in order, their sizes, and the ends of the edges as places among them."""
    own = vertices.column("v").to_numpy()
    order = np.argsort(own)
    u, v = (np.searchsorted(own[order], edges.column(c).to_numpy()) for c in "uv")
    return own[order], vertices.column("n").to_numpy()[order].astype(float), u, v


def _small(vertices: pa.Table, edges: pa.Table) -> tuple[np.ndarray, Small]:
    ids, size, u, v = _read(vertices, edges)
    return ids, Small(len(ids), u, v, size)


def _cut_group(key: tuple, vertices: pa.Table, edges: pa.Table) -> pa.Table:
    ids, size, u, v = _read(vertices, edges)
    return pa.table({"v": ids, "side": _halved(len(ids), u, v, edges.column("w").to_numpy(), size).astype(np.int32)})


def _pieces(part: int):
    """A part in pieces of at most that many vertices, and the separators between them: v and path."""

    def run(key: tuple, vertices: pa.Table, edges: pa.Table) -> pa.Table:
        ids, _, u, v = _read(vertices, edges)
        todo, done = [(key[0].as_py(), np.arange(len(ids)), u, v)], []
        while todo:
            path, own, u, v = todo.pop()
            side = _halved(len(own), u, v, np.ones(len(u)), np.ones(len(own))) if len(own) > part else np.zeros(0)
            if len(set(side.tolist())) < 2:
                done.append((path, own))
                continue
            cut = side[u] != side[v]
            border = [np.unique(u[cut & (side[u] == s)]) for s in (0, 1)]
            side[border[int(len(border[1]) < len(border[0]))]] = 2
            for s in (0, 1, 2):
                inner, place = (side[u] == s) & (side[v] == s), np.cumsum(side == s) - 1
                piece = (path + str(s), own[side == s], place[u[inner]], place[v[inner]])
                if s < 2 and len(piece[1]):
                    todo.append(piece)
                elif len(piece[1]):
                    done.append(piece[:2])
        paths = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(done), dtype=np.int32), [len(x) for _, x in done])), pa.array([p for p, _ in done])).cast(pa.string())
        return pa.table({"v": ids[np.concatenate([x for _, x in done])], "path": paths})

    return run


def _dissected_group(key: tuple, vertices: pa.Table, edges: pa.Table) -> pa.Table:
    ids, graph = _small(vertices, edges)
    return pa.table({"v": ids, "path": [key[0].as_py() + p for p in graph.paths()]})


# --- cuts of large parts -----------------------------------------------------------------------------------------
def _sides(edges: DataFrame, parts: DataFrame, m: int, n: int) -> DataFrame:
    """v, side of the vertices of parts(v, path) by the multilevel scheme; m edges(u, v) lie within parts, n is at least
    the number of vertices."""
    fine = written(edges.withColumn("w", F.lit(1.0)), "edges", rows=m)
    sizes = written(parts.select("path", "v", F.lit(1).cast("long").alias("n")), "sizes", rows=n)
    levels, count = [], counted(sizes)
    while not _fits(fine, sizes) and len(levels) < LEVELS:
        into, coarse, fewer = _coarser(fine, sizes)
        levels.append((into, fine, sizes))
        fine, sizes, before, count = coarse, fewer, count, counted(fewer)
        if count > 0.97 * before:
            break
    within = fine.join(sizes.select("v", F.col("path").alias("part")), "v")
    sides = sizes.groupBy("path").cogroup(within.groupBy("part")).applyInArrow(_cut_group, "v long, side int")
    sides = written(sides, "sides", rows=n)
    discard(fine, sizes)
    for into, edges_, sizes_ in reversed(levels):
        finer = into.join(sides.select(F.col("v").alias("into"), "side"), "into").select("v", "side")
        old, sides = sides, written(_evened(edges_, sizes_, finer), "sides", rows=n)
        discard(old, into, edges_, sizes_)
    return sides


def _fits(edges: DataFrame, sizes: DataFrame) -> bool:
    """Whether each part can be cut in one group."""
    most = sizes.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    if most <= COARSEST or most > GROUPED or counted(edges) <= GROUPED_EDGES:
        return most <= GROUPED
    return edges.join(sizes, "v").groupBy("path").count().agg(F.max("count")).first()[0] <= GROUPED_EDGES


def _evened(edges: DataFrame, sizes: DataFrame, sides: DataFrame) -> DataFrame:
    """sides after vertices of side 0, then of side 1, whose change lowers the cut have changed it, in parts that stay even."""
    for side in (0, 1):
        ends = edges.join(sides.select(F.col("v").alias("u"), F.col("side").alias("a")), "u").join(sides.select("v", F.col("side").alias("b")), "v")
        gain = ends.where(F.col("a") == side).groupBy(F.col("u").alias("v")).agg(F.sum(F.when(F.col("b") == side, -F.col("w")).otherwise(F.col("w"))).alias("gain")).where("gain > 0").select("v", F.lit(True).alias("moves"))
        own = sides.join(sizes, "v").join(gain, "v", "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
        after = F.when(F.col("moves"), 1 - F.col("side")).otherwise(F.col("side"))
        even = own.groupBy("path").agg((F.sum(F.when(after == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where(F.col("share").between(1 - EVEN, EVEN)).select("path", F.lit(True).alias("even"))
        sides = own.join(even, "path", "left").select("v", F.when(F.coalesce("even", F.lit(False)), after).otherwise(F.col("side")).alias("side"))
    return sides


def _within(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges u, v with both ends in one part, and its path."""
    return edges.join(parts.select(F.col("v").alias("u"), "path"), "u").join(parts.select("v", F.col("path").alias("p")), "v").where("path = p").select("u", "v", "path")


def _separated(inner: DataFrame, parts: DataFrame, m: int, n: int) -> DataFrame:
    """v, path with a letter more: the sides of each part, and the separator between them. inner(u, v, path) are the edges within
    parts, at most m."""
    sides = written(_sides(inner.select("u", "v"), parts, m, n).join(parts, "v"), "sides", rows=n)
    ends = inner.select("u", "v").join(sides.select(F.col("v").alias("u"), F.col("side").alias("a"), "path"), "u").join(sides.select("v", F.col("side").alias("b")), "v")
    border = written(ends.where("a <> b").select("path", F.col("u").alias("v"), F.col("a").alias("side")).distinct(), "border", rows=n)
    fewer = border.groupBy("path").agg((F.sum("side") < F.sum(1 - F.col("side"))).cast("int").alias("side"))
    chosen = border.join(fewer, ["path", "side"], "left_semi").select("v", F.lit(2).alias("separates"))
    out = sides.join(chosen, "v", "left").select("v", F.concat("path", F.coalesce("separates", "side").cast("string")).alias("path"))
    out = written(out, "parts", rows=n)
    discard(sides, border)
    return out


def dissection(edges: DataFrame, vertices: DataFrame, part: int | None = None) -> DataFrame:
    """id and path of all vertices(id), written; edges(src, dst) may have either direction, repeats and loops."""
    part = PART if part is None else part
    graph = written(pattern(edges), "pattern")
    todo = written(vertices.select(F.col("id").alias("v"), F.lit("").alias("path")).distinct(), "parts")
    done: list[DataFrame] = []
    n = counted(todo)
    while True:
        large = todo.groupBy("path").count().where(F.col("count") > part)
        if large.isEmpty():
            break
        small = written(todo.join(large, "path", "left_anti").select("v", "path"), "small", rows=n)
        own = written(todo.join(large, "path", "left_semi").select("v", "path"), "large", rows=n)
        inner = written(_within(graph, own), "within", rows=counted(graph))
        within = inner.groupBy("path").agg(F.count("*").alias("m"))
        wide = written(large.join(within, "path", "left").where((F.col("count") > GROUPED) | (F.col("m") > GROUPED_EDGES)).select("path"), "wide")
        vertices = own.join(wide, "path", "left_anti").select("path", "v", F.lit(1).cast("long").alias("n"))
        pieces = vertices.groupBy("path").cogroup(inner.join(wide, "path", "left_anti").select(F.col("path").alias("part"), "u", "v").groupBy("part")).applyInArrow(_pieces(part), "v long, path string")
        done += [small, written(pieces, "pieces")]
        if not counted(wide):
            discard(todo, own, inner, wide)
            todo = None
            break
        cut = _separated(inner.join(wide, "path", "left_semi").select("u", "v", "path"), own.join(wide, "path", "left_semi").select("v", "path"), counted(graph), n)
        discard(todo, own, inner, wide)
        apart = cut.groupBy(F.expr("left(path, length(path) - 1)").alias("path")).agg(F.countDistinct(F.right("path", F.lit(1))).alias("n")).where("n = 1").select("path")
        whole = F.expr("left(path, length(path) - 1)")
        stuck = cut.withColumn("own", whole).join(apart.withColumnRenamed("path", "own"), "own", "left_semi")  # one side has all
        separators = cut.where(F.right("path", F.lit(1)) == "2")
        done += [written(separators.unionByName(stuck.select("v", "path").where(F.right("path", F.lit(1)) != "2")), "done", rows=n)]
        todo = written(cut.where(F.right("path", F.lit(1)) != "2").withColumn("own", whole).join(apart.withColumnRenamed("path", "own"), "own", "left_anti").select("v", "path"), "parts", rows=n)
        discard(cut)
    done += [todo] if todo is not None else []
    out = _finished(graph, done)
    discard(graph, *done)
    return out


def _finished(graph: DataFrame, done: list[DataFrame]) -> DataFrame:
    """All parts together, those that are no separators dissected to the end, a part a group."""
    rows = done[0]
    for other in done[1:]:
        rows = rows.unionByName(other)
    closed = F.right("path", F.lit(1)) == "2"
    small = rows.where(~closed)
    inner = _within(graph, small).withColumnRenamed("path", "part")
    ends = small.select("path", "v", F.lit(1).cast("long").alias("n")).groupBy("path").cogroup(inner.groupBy("part")).applyInArrow(_dissected_group, "v long, path string")
    return written(ends.unionByName(rows.where(closed)).select(F.col("v").alias("id"), "path"), "paths")


def positions(paths: DataFrame) -> DataFrame:
    """id, path and position (0, 1, ..) in the order of paths, then ids. Ranges of the order are counted by themselves."""
    ranged = written(paths.repartitionByRange("path", "id").withColumn("block", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("block").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = counts.select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("path", "id")
    return ranged.withColumn("k", F.row_number().over(inside)).join(F.broadcast(base), "block").select("id", "path", (F.col("base") + F.col("k") - 1).alias("position"))


def nested_dissection(edges: DataFrame, vertices: DataFrame, part: int | None = None) -> DataFrame:
    """id, path and position of every vertex: a permutation in which separators come after the sides that they separate."""
    return positions(dissection(edges, vertices, part))


def crossing(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges that join two sides of one cut: there are none in a dissection."""
    p, q = (paths.select(F.col("id").alias(c), F.col("path").alias(f"path_{c}")) for c in ("src", "dst"))
    both = edges.select("src", "dst").join(p, "src").join(q, "dst")
    return both.where(_parted(F.col("path_src"), F.col("path_dst")))


def _parted(a: Column, b: Column) -> Column:
    """Whether the first letters in which two paths differ are those of the two sides."""
    far = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    first = F.get(far, F.lit(0))
    return F.coalesce(F.substring(a, first, F.lit(1)).isin("0", "1") & F.substring(b, first, F.lit(1)).isin("0", "1"), F.lit(False))


def mesh(ids: DataFrame, width: int) -> DataFrame:
    """A mesh over ids 0, 1, ..: each joined with the next in its row of width, and with that below it; w = 1."""
    beside = ids.where((F.col("id") + 1) % width != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    below = ids.select(F.col("id").alias("src"), (F.col("id") + width).alias("dst"))
    one = beside.unionAll(below).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("w"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
