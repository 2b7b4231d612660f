"""Strongly connected components, maximum bipartite matchings, and the Dulmage-Mendelsohn form that follows from both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.state import counted, discard, gathered, written

#: Rounds in which vertices without a way in or out are taken away before the rest is coloured.
TRIMS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those from a vertex with no way in or to one with no way out, written; edges itself is discarded."""
    for _ in range(TRIMS):
        n = counted(edges)
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        kept = written(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "trimmed", rows=n)
        discard(edges)
        edges = kept
        if counted(edges) in (0, n):
            break
    return edges


def _spread(state: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """c of each vertex: the greatest id from which there is a way to it. Only vertices that changed send on."""
    while True:
        sent = state.where("moved").select(F.col("id").alias("src"), "c").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
        last, more = state, F.coalesce(F.col("m") > F.col("c"), F.lit(False))
        state = written(state.join(sent, "id", "left").select("id", F.when(more, F.col("m")).otherwise(F.col("c")).alias("c"), more.alias("moved")), "colours", F.col("moved"), rows)
        discard(last)
        if not counted(state):
            return state


def _back(state: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """id, c, hit: whether there is a way from the vertex to that with the id c, inside the colour."""
    state = written(state.select("id", "c", (F.col("id") == F.col("c")).alias("hit"), (F.col("id") == F.col("c")).alias("moved")), "hits", rows=rows)
    while True:
        sent = state.where("moved").select(F.col("id").alias("dst")).join(edges, "dst").select(F.col("src").alias("id"), F.lit(True).alias("m")).distinct()
        last, more = state, F.coalesce("m", F.lit(False)) & ~F.col("hit")
        state = written(state.join(sent, "id", "left").select("id", "c", (F.col("hit") | more).alias("hit"), more.alias("moved")), "hits", F.col("moved"), rows)
        discard(last)
        if not counted(state):
            return state


def strong_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id and scc, the least id among those it reaches and is reached from, of all vertices(id), written.

    Vertices without a way in or out go, round by round. The others take the greatest id that reaches them as colour; what
    reaches, inside a colour, the vertex with the colour's id is one component, and goes. Each round does so for all colours at
    once, and edges between colours go too. A round takes as many steps as its longest shortest way."""
    edges = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found: list[DataFrame] = []
    while counted(edges := _trimmed(edges)):
        n = counted(edges)
        ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
        colours = _spread(written(ends.select("id", F.col("id").alias("c"), F.lit(True).alias("moved")), "colours", rows=2 * n), edges, 2 * n)
        one, two = (colours.select(F.col("id").alias(k), F.col("c").alias(f"c_{k}")) for k in ("src", "dst"))
        inner = written(edges.join(one, "src").join(two, "dst").where("c_src = c_dst").select("src", "dst"), "edges", rows=n)
        hits = _back(colours, inner, 2 * n)
        own = hits.where("hit")
        found.append(written(own.select("id", "c").join(own.groupBy("c").agg(F.min("id").alias("scc")), "c").select("id", "scc"), "components", rows=2 * n))
        gone = own.select("id")
        left = inner.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        before, edges = edges, written(left.select("src", "dst"), "edges", rows=n)
        discard(before, inner, hits, colours)
    out = vertices.select("id").distinct()
    if found:
        out = out.join(reduce(DataFrame.unionByName, found), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    else:
        out = out.withColumn("scc", F.col("id"))
    out = written(out, "components")
    discard(edges, *found)
    return out


# --- matchings ---------------------------------------------------------------------------------------------------
def _greedy(edges: DataFrame) -> DataFrame:
    """src, dst of a matching that no edge can be added to, written: free columns propose, rows accept, until there are none."""
    pairs = None
    free, n = edges, counted(edges)  # a written table
    order = F.struct(F.xxhash64("src", "dst").alias("h"), "src", "dst")
    while counted(free):
        proposed = free.groupBy("src").agg(F.min(order)["dst"].alias("dst"))
        taken = proposed.groupBy("dst").agg(F.min(order)["src"].alias("src")).select("src", "dst")
        taken = written(taken if pairs is None else pairs.unionByName(taken), "pairs", rows=n)
        discard(pairs)
        pairs = taken
        left = edges.join(pairs.select("src"), "src", "left_anti").join(pairs.select("dst"), "dst", "left_anti")
        old, free = free, written(left.select("src", "dst"), "free", rows=n)
        if old is not edges:
            discard(old)
    if pairs is None:
        return written(edges.limit(0).select("src", "dst"), "pairs")
    discard(free)
    return pairs


def _search(edges: DataFrame, pairs: DataFrame, columns: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From all free columns(src) at once, by edges to rows and by pairs back: seen(dst, src, root) with the column from which
    each row was first reached, ends(root, dst) with one free row of each root that found any, and reached(src, root). Roots that
    found one go no further; each row is reached once, so ways from different roots do not meet."""
    front = written(columns.join(pairs, "src", "left_anti").select("src", F.col("src").alias("root")), "front", rows=rows)
    steps, found, reached = [], [], []
    pick = F.min(F.struct(F.xxhash64("src", "dst").alias("h"), "src", "root")).alias("p")
    while counted(front):
        step = front.join(edges, "src")
        if steps:
            step = step.join(reduce(DataFrame.unionByName, steps).select("dst"), "dst", "left_anti")
        step = step.groupBy("dst").agg(pick).select("dst", F.col("p.src").alias("src"), F.col("p.root").alias("root"))
        step = written(step.join(pairs.select("dst", F.col("src").alias("mate")), "dst", "left"), "step", F.col("mate").isNull(), rows)
        on = step.where("mate IS NOT NULL")
        if counted(step):
            found = gathered(found, written(step.where("mate IS NULL").groupBy("root").agg(F.min("dst").alias("dst")), "ends", rows=rows), "ends", rows)
        if found:
            on = on.join(reduce(DataFrame.unionByName, found).select("root"), "root", "left_anti")
        last, front = front, written(on.select(F.col("mate").alias("src"), "root"), "front", rows=rows)
        steps, reached = gathered(steps, step, "steps", rows), gathered(reached, last, "reached", rows)
    none = edges.limit(0)
    seen = reduce(DataFrame.unionByName, steps) if steps else none.select("dst", "src", F.col("src").alias("root"))
    ends = reduce(DataFrame.unionByName, found) if found else none.select(F.col("src").alias("root"), "dst")
    seen, ends = written(seen.select("dst", "src", "root"), "seen", rows=rows), written(ends, "ends", rows=rows)
    out = written(reduce(DataFrame.unionByName, [*reached, front]), "reached", rows=rows)
    discard(front, *reached, *steps, *found)
    return seen, ends, out


def _augmented(pairs: DataFrame, seen: DataFrame, ends: DataFrame, rows: int) -> DataFrame:
    """pairs after the ways that end at ends are turned around, a step of all ways at a time."""
    at, turned = written(ends.select("dst"), "at", rows=rows), []
    while counted(at):
        step = written(at.join(seen, "dst").select("src", "dst"), "step", rows=rows)
        last, at = at, written(step.select("src").join(pairs, "src").select("dst"), "at", rows=rows)
        turned = gathered(turned, step, "turned", rows)
        discard(last)
    new = reduce(DataFrame.unionByName, turned)
    out = written(pairs.join(new.select("src"), "src", "left_anti").unionByName(new), "pairs", rows=rows)
    discard(at, *turned)
    return out


def maximum_matching(edges: DataFrame) -> DataFrame:
    """src, dst of a matching of most edges between columns (src) and rows (dst), written. It starts from one that no edge
    can be added to, and turns around alternating ways between free vertices until a search from all free columns finds none."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    columns, n = edges.select("src").distinct(), counted(edges)
    pairs = _greedy(edges)
    while True:
        seen, ends, reached = _search(edges, pairs, columns, n)
        done = not counted(ends)
        if not done:
            old, pairs = pairs, _augmented(pairs, seen, ends, n)
            discard(old)
        discard(seen, ends, reached)
        if done:
            discard(edges)
            return pairs


#: Parts of the coarse form: more columns than rows, as many, more rows than columns.
WIDE, SQUARE, TALL = "wide", "square", "tall"


def dulmage_mendelsohn(edges: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """id, side (column or row), part and block of all columns(id) and rows(id) of a matrix with edges(src column, dst row), written.

    Columns and rows that an alternating way joins with a free column are the wide part, those that one joins with a free
    row the tall part; the rest is square, matched within itself. Blocks of the square part are the strong components of
    its columns (each with an edge to the mates of its rows), named by their least column; other parts are one block (null).
    With the wide part first, blocks in an order of their edges, and the tall part last, the matrix is block triangular."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    pairs = maximum_matching(edges)
    every_column, every_row = columns.select(F.col("id").alias("src")).distinct(), rows.select(F.col("id").alias("dst")).distinct()
    every_column, every_row = (written(t, "ends") for t in (every_column, every_row))
    n = counted(edges) + counted(every_column) + counted(every_row)
    seen, ends, reached = _search(edges, pairs, every_column, n)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen_t, ends_t, reached_t = _search(back, turned, every_row.withColumnRenamed("dst", "src"), n)
    wide = [reached.select(F.col("src").alias("id")), seen.select(F.col("dst").alias("id"))]
    tall = [seen_t.select(F.col("dst").alias("id")), reached_t.select(F.col("src").alias("id"))]

    def parts(ids: DataFrame, k: int, side: str) -> DataFrame:
        marks = wide[k].select("id", F.lit(WIDE).alias("part")).unionByName(tall[k].select("id", F.lit(TALL).alias("part"))).distinct()
        return ids.join(marks, "id", "left").select("id", F.lit(side).alias("side"), F.coalesce("part", F.lit(SQUARE)).alias("part"))

    own = written(parts(every_column.withColumnRenamed("src", "id"), 0, "column").unionByName(parts(every_row.withColumnRenamed("dst", "id"), 1, "row")), "parts", rows=n)
    square = own.where((F.col("part") == SQUARE) & (F.col("side") == "column")).select(F.col("id").alias("src"))
    mates = pairs.join(square, "src", "left_semi")
    inner = edges.join(square, "src", "left_semi").join(mates.select("dst", F.col("src").alias("mate")), "dst")
    blocks = strong_components(inner.select("src", F.col("mate").alias("dst")), square.withColumnRenamed("src", "id"))
    named = blocks.select("id", F.lit("column").alias("side"), F.col("scc").alias("block")).unionByName(mates.join(blocks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.lit("row").alias("side"), F.col("scc").alias("block")))
    out = written(own.join(named, ["id", "side"], "left").select("id", "side", "part", "block"), "form")
    discard(edges, pairs, seen, ends, reached, seen_t, ends_t, reached_t, own, blocks, every_column, every_row)
    return out
