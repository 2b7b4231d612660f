"""Graph preparation on edge tables edges(src, dst, w)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.solvers import rescaling_exponent, rescaling_exponents


def dedup_sum(edges: DataFrame) -> DataFrame:
    """Repeated edges summed."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _with_sums(edges: DataFrame, *sums) -> DataFrame:
    """edges with aggregates over their source. Sums are made in parts before they are shuffled, so a hub is no single task."""
    return edges.join(edges.groupBy("src").agg(*sums), "src")


def make_stochastic(edges: DataFrame) -> DataFrame:
    """Weights divided by their source's sum; sums within 1e-12 of 1, and 0, are left alone."""
    s = F.col("_sum")
    scaled = F.when((F.abs(s - 1) > 1e-12) & (s != 0), F.col("w") / F.when(s != 0, s)).otherwise(F.col("w"))
    return _with_sums(edges, F.sum("w").alias("_sum")).withColumn("w", scaled).drop("_sum").select(*edges.columns)


def stochastic_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("s")).agg(F.count(F.when(F.abs(F.col("s") - 1) <= 1e-12, 1)).alias("n_stochastic"))


#: Neighbours of one source that are folded in one row; sources with more are bisected over tables.
ROW_NEIGHBOURS = 100_000


def _delta(distances: bool):
    return F.col("w") if distances else -F.ln("w")


def rescaling(edges: DataFrame, lam: float, distances: bool = False, neighbours: int | None = None) -> DataFrame:
    """src and the exponent g with sum(w ** g) = lam over its positive weights, that sum as total, its degree and whether that
    is at most lam. A bound of neighbours that no source exceeds (the vertices of a simple graph, say) can save the look
    for hubs."""
    rows = edges.where("w > 0").select("src", "dst", _delta(distances).alias("d"))
    hubs = rows.groupBy("src").count().where(F.col("count") > ROW_NEIGHBOURS).select("src")
    some = (neighbours is None or neighbours > ROW_NEIGHBOURS) and not hubs.isEmpty()
    short = (rows.join(hubs, "src", "left_anti") if some else rows).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "d"))).alias("a"))
    out = short.select("src", rescaling_exponent(F.transform("a", lambda x: x["d"]), lam).alias("g"), "a")
    out = out.select("src", "g", F.aggregate("a", F.lit(0.0), lambda s, x: s + F.exp(-F.col("g") * x["d"])).alias("total"), F.size("a").cast("long").alias("degree"))
    if some:
        out = out.unionByName(rescaling_of_hubs(rows.join(hubs, "src", "left_semi"), lam))
    return out.withColumn("short", F.col("degree") <= F.lit(lam))


#: Steps between two checkpoints of the bisection.
CHAINED = 5


def rescaling_of_hubs(rows: DataFrame, lam: float, steps: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """src, g, total and degree by the same bisection, each step one sum over rows(src, d): for sources of any degree. There can be
    as many sources as vertices, so their states are never broadcast: each step would leave a table of them on the driver."""
    from filigree.operators.state import counted, discard, written

    rows = written(rows.select("src", "d"), "hubs")
    start = rows.groupBy("src").agg(F.count("*").alias("degree"), (F.sum(F.exp(-F.col("d"))) - lam).alias("f"))
    state = start.select("src", "degree", F.lit(1.0).alias("g"), F.lit(-1000.0).alias("lo"), F.lit(None).cast("double").alias("hi"), "f")
    kept = None
    for i in range(steps):
        if i % CHAINED == 0:
            last, state = kept, written(state, "exponents", F.abs("f") > tolerance)
            kept = state
            discard(last)
            if not counted(state):
                break
        more, on = F.col("f") > 0, F.abs("f") > tolerance
        g = F.when(~on, F.col("g")).when(more, F.when(F.col("hi").isNull(), F.col("g") * 2).otherwise((F.col("g") + F.col("hi")) / 2)).otherwise((F.col("lo") + F.col("g")) / 2)
        moved = state.select("src", "degree", g.alias("g"), F.when(on & more, F.col("g")).otherwise(F.col("lo")).alias("lo"), F.when(on & ~more, F.col("g")).otherwise(F.col("hi")).alias("hi"))
        state = rows.join(moved.hint("merge"), "src").groupBy(*moved.columns).agg((F.sum(F.exp(-F.col("g") * F.col("d"))) - lam).alias("f"))
    out = written(state.select("src", "g", (F.col("f") + lam).alias("total"), "degree"), "exponents")
    discard(rows, kept)
    return out


def shared_folder(context) -> str:
    """The checkpoint folder. Only on a local master, where driver and executors are one process, it is set to a temporary one."""
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="filigree-"))
    return (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()).rstrip("/")


def rescale(edges: DataFrame, lam: float, distances: bool = False, drop_leaf: bool = False, neighbours: int | None = None) -> DataFrame:
    """Weights raised to their source's exponent and normalised to 1; zero weights stay. lam 1 changes nothing."""
    if lam == 1:
        return edges
    w = F.exp(-F.col("g") * F.when(F.col("w") > 0, _delta(distances))) / F.when(F.col("total") > 0, F.col("total"))
    scaled = F.coalesce(w, F.lit(0.0))
    out = edges.join(rescaling(edges, lam, distances, neighbours).select("src", "g", "total"), "src", "left")
    if drop_leaf:
        out, scaled = _with_sums(out, F.count("*").alias("_count")), F.when(F.col("_count") == 1, 0.0).otherwise(scaled)
    return out.select("src", "dst", scaled.alias("w"))


#: Edges that rescale_rows() takes at once, or the edges of one source.
SOURCES_ROWS = 1 << 18


def rescale_rows(edges: DataFrame, lam: float, drop_leaf: bool = False) -> DataFrame:
    """rescale(make_stochastic(dedup_sum(edges))) in one shuffle, by source: for sources of at most ROW_NEIGHBOURS edges, which
    are looked for first; where there are others it is done over tables."""
    if not edges.groupBy("src").count().where(F.col("count") > ROW_NEIGHBOURS).isEmpty():
        return rescale(make_stochastic(dedup_sum(edges)), lam, drop_leaf=drop_leaf)

    def flush(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]))
        src, dst, w = src[at], dst[at], np.add.reduceat(w, at)
        at = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        size = np.diff(at, append=len(src))
        total = np.add.reduceat(w, at)
        w = w / np.repeat(np.where((np.abs(total - 1) > 1e-12) & (total != 0), total, 1.0), size)
        there = w > 0
        of = np.repeat(np.arange(len(at)), size)[there]
        delta = -np.log(w[there])
        scaled = np.zeros(len(w))
        g = rescaling_exponents(delta, of, len(at), lam)
        own = np.exp(-g[of] * delta)
        scaled[there] = own / np.bincount(of, own, len(at))[of] if len(of) else 0.0
        if drop_leaf:
            scaled[np.repeat(size == 1, size)] = 0.0
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(scaled)], ["src", "dst", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= SOURCES_ROWS:
                src, dst, w = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("src", "dst", "w"))
                last = np.searchsorted(src, src[-1])  # the last source may go on
                if last:
                    yield flush(src[:last], dst[:last], w[:last])
                held = [pa.RecordBatch.from_arrays([pa.array(x[last:]) for x in (src, dst, w)], ["src", "dst", "w"])]
                n = len(src) - last
        if n:
            yield flush(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("src", "dst", "w")))

    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")).where("src IS NOT NULL")
    rows = rows.withColumn("dst", F.when(F.col("dst").isNull(), F.raise_error(F.lit("an edge ends at no vertex"))).otherwise(F.col("dst")))
    return rows.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(run, "src long, dst long, w double")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrize(edges: DataFrame) -> DataFrame:
    """P + P'; the diagonal is doubled."""
    return dedup_sum(edges.select("src", "dst", "w").unionByName(transpose(edges)))


def symmetric_half(edges: DataFrame) -> DataFrame:
    """(P + P') / 2."""
    return symmetrize(edges).withColumn("w", F.col("w") * 0.5)


def symmetric_keep_diagonal(edges: DataFrame) -> DataFrame:
    """P + P' without doubling the diagonal."""
    return dedup_sum(edges.select("src", "dst", "w").unionByName(transpose(edges.where("src <> dst"))))


def normalize_joint(edges: DataFrame) -> DataFrame:
    """Weights divided by their total."""
    total = edges.agg(F.sum("w").alias("total"))
    return edges.join(F.broadcast(total)).select("src", "dst", (F.col("w") / F.col("total")).alias("w"))  # one row


def joint_by_count(edges: DataFrame, n: int) -> DataFrame:
    """(P + P') / 2n."""
    return symmetrize(edges).withColumn("w", F.col("w") / (2 * n))


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is not there."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return vertices.join(ends, "id", "left_anti")


def upper(edges: DataFrame) -> DataFrame:
    return edges.where("src >= dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def offsets(edges: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Exclusive running sums of the degrees by src, in two levels: inside blocks of ids, and over blocks."""
    own = degrees(edges).withColumn("block", F.floor(F.col("src") / block))
    blocks = own.groupBy("block").agg(F.sum("degree").alias("n"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of ids
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("run", F.coalesce(F.sum("degree").over(inside), F.lit(0))).join(blocks, "block").select("src", "degree", (F.col("base") + F.col("run")).alias("start"))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices renamed by mapping(old, new)."""
    first = edges.join(mapping.select(F.col("old").alias("src"), F.col("new").alias("s")), "src")
    return first.join(mapping.select(F.col("old").alias("dst"), F.col("new").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "w")


def banded(ids: DataFrame, width: int) -> DataFrame:
    """A banded matrix over ids(id): w = 1 / (1 + |i - j|) for |i - j| <= width."""
    rows = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") - width, F.col("id") + width)).alias("dst"))
    known = ids.select(F.col("id").alias("dst")).hint("merge")  # as many as rows of the matrix: not for the driver and a broadcast
    return rows.join(known, "dst", "left_semi").select("src", "dst", (1.0 / (1 + F.abs(F.col("src") - F.col("dst")))).alias("w"))


def banded_limited(ids: DataFrame, width: int, limit: int) -> DataFrame:
    """Of the entries of a banded matrix below the diagonal (band by band from the farthest, by vertex), the first limit."""
    rows = banded(ids, width).where("dst < src").orderBy(F.col("dst") - F.col("src"), "src").limit(limit)
    return rows.select("src", "dst", "w")


def uniform(seed: int, *keys: Column) -> Column:
    """Numbers from 0 up to 1 that look random, by whole numbers: a Lehmer generator run over the keys."""
    x = F.lit(seed + 1).cast("long")
    for k in keys:
        for factor in (48271, 69621):
            x = F.pmod((x + F.pmod(k.cast("long"), F.lit(MODULUS)) + 1) * factor, F.lit(MODULUS))
    return x / float(MODULUS)


#: The prime of the generator.
MODULUS = 2**31 - 1


def banded_symmetric(ids: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """A symmetric banded matrix with weights from 0.5 to 1.5 that depend on the two ids."""
    rows = banded(ids, width)
    return rows.withColumn("w", 0.5 + uniform(seed, F.least("src", "dst"), F.greatest("src", "dst")))


def random_coordinates(ids: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """Uniform coordinates y0 .. in the unit cube, by id."""
    return ids.select("id", *[uniform(seed, F.col("id"), F.lit(k)).alias(f"y{k}") for k in range(dims)])


def random_graph(spark, n: int, seed: int = 0) -> DataFrame:
    """2 to 11 entries for each vertex, with uniform ends and weights; repeats and loops can occur."""
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(2) + F.floor(10 * uniform(seed, F.col("id"))).cast("int"))).alias("k"))
    return rows.select("src", F.floor(n * uniform(seed + 1, F.col("src"), F.col("k"))).alias("dst"), uniform(seed + 2, F.col("src"), F.col("k")).alias("w"))


def describe(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("src").alias("n_src"), F.count("*").alias("nnz"), F.min("w").alias("least"), F.max("w").alias("most"), F.sum("w").alias("total"))
