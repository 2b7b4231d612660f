"""Sparse linear algebra on edge tables (column src, row dst) and vectors v(id, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.graph import uniform


def _products(edges: DataFrame, v: DataFrame) -> DataFrame:
    """Edges with the entries of v. A vector is as long as the matrix is wide, whatever its file's size suggests: it is never broadcast."""
    return edges.join(v.withColumnRenamed("id", "src").hint("merge"), "src")


def spmv(edges: DataFrame, v: DataFrame, *columns: str) -> DataFrame:
    """A x, for one or several columns at once."""
    columns = columns or ("x",)
    return _products(edges, v).groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def spmv_t(edges: DataFrame, v: DataFrame, *columns: str) -> DataFrame:
    """A' x."""
    return spmv(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), v, *columns)


def spmv_pattern(edges: DataFrame, v: DataFrame) -> DataFrame:
    """A x with all weights 1."""
    return _products(edges, v).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))


def spmv_min_plus(edges: DataFrame, v: DataFrame) -> DataFrame:
    """One relaxation step of shortest paths."""
    return _products(edges, v).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("w") + F.col("x")).alias("x"))


def spmv_symmetric(lower: DataFrame, v: DataFrame) -> DataFrame:
    """A x where only one triangle of a symmetric A is stored."""
    return spmv(lower.unionByName(lower.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), v)


def axpy(y: DataFrame, edges: DataFrame, v: DataFrame) -> DataFrame:
    """y + A x."""
    return y.select("id", "x").unionByName(spmv(edges, v)).groupBy("id").agg(F.sum("x").alias("x"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B."""
    right = b.select("src", F.col("dst").alias("mid"), F.col("w").alias("wb"))
    left = a.select(F.col("src").alias("mid"), "dst", F.col("w").alias("wa"))
    return right.join(left, "mid").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def product_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """src, the entries n of each column of A B and their sum w, without A B, which can have the square of the vertices. Columns
    of B with the same pattern are one class, and so are rows of A: classes meet instead of their members. Equal patterns
    are found by a hash, and then compared entry by entry."""
    right, left = b.groupBy("src", F.col("dst").alias("mid")).agg(F.sum("w").alias("wb")), a.groupBy("dst", F.col("src").alias("mid")).agg(F.sum("w").alias("wa"))
    total = right.join(left.groupBy("mid").agg(F.sum("wa").alias("wa")), "mid").groupBy("src").agg(F.sum(F.col("wb") * F.col("wa")).alias("w"))
    columns, rows = _classes(right.select(F.col("src").alias("id"), "mid")), _classes(left.select(F.col("dst").alias("id"), "mid"))
    sizes = rows.groupBy("head").agg(F.count("*").alias("size"))
    ends = lambda own, entries, key, c: own.where("id = head").select("id").join(entries.select(F.col(key).alias("id"), "mid"), "id").select(F.col("id").alias(c), "mid")
    met = ends(columns, right, "src", "column").join(ends(rows, left, "dst", "head"), "mid").select("column", "head").distinct()
    counts = met.join(sizes, "head").groupBy("column").agg(F.sum("size").alias("n"))
    return columns.select(F.col("id").alias("src"), F.col("head").alias("column")).join(counts, "column").join(total, "src").select("src", "n", "w")


def _classes(entries: DataFrame) -> DataFrame:
    """id and head, the least id with the same set of mid among the distinct entries(id, mid)."""
    key = [F.count("*").alias("k"), F.bit_xor(F.xxhash64("mid")).alias("x"), F.sum(F.xxhash64("mid", F.lit(1)).cast("decimal(38, 0)")).alias("y")]
    keys = entries.groupBy("id").agg(*key)
    heads = keys.join(keys.groupBy("k", "x", "y").agg(F.min("id").alias("head")), ["k", "x", "y"]).select("id", "head")
    theirs = entries.select(F.col("id").alias("head"), "mid")
    other = entries.join(heads, "id").join(theirs, ["head", "mid"], "left_anti").select("id", F.lit(True).alias("other")).distinct()  # a hash that two sets share
    return heads.join(other, "id", "left").select("id", F.when(F.col("other"), F.col("id")).otherwise(F.col("head")).alias("head"))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return a.select("src", "dst", (F.col("w") * alpha).alias("w")).unionByName(b.select("src", "dst", (F.col("w") * beta).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def norm1(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s").alias("norm1"))


def drop_small(edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    return edges.where(F.abs("w") > tolerance)


def block_counts(edges: DataFrame, bits: int) -> DataFrame:
    return edges.groupBy(F.shiftright("src", bits).alias("bi"), F.shiftright("dst", bits).alias("bj")).agg(F.count("*").alias("nnz"))


def imbalance(edges: DataFrame, bits: int, side: str = "dst") -> DataFrame:
    """Most over mean entries of a block row (dst) or column (src)."""
    counts = edges.groupBy(F.shiftright(side, bits).alias("b")).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.avg("n")).alias("imbalance"))


def block_diagonal(edges: DataFrame, bits: int, d: int) -> DataFrame:
    """Entries, and imbalance, of the d-th diagonal of blocks."""
    own = block_counts(edges, bits).where(F.col("bj") - F.col("bi") == d)
    return own.agg(F.sum("nnz").alias("nnz"), (F.max("nnz") / F.avg("nnz")).alias("imbalance"))


def morton(x, y, bits: int = 16):
    """Interleaved bits of two columns, y above x."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return out


def vector(ids: DataFrame, fill: str | float, seed: int = 0) -> DataFrame:
    """v(id, x) over ids(id): a number everywhere, or "iota" (the id), or "random" (uniform in the unit interval, by id)."""
    x = F.col("id").cast("double") if fill == "iota" else uniform(seed, F.col("id")) if fill == "random" else F.lit(float(fill))
    return ids.select("id", x.alias("x"))


def top_level(edges: DataFrame, bits: int, blocks: int) -> DataFrame:
    """The dense table of entries by block: a row bi, a column for each bj below blocks."""
    return block_counts(edges, bits).groupBy("bi").pivot("bj", list(range(blocks))).agg(F.sum("nnz")).fillna(0).select("bi", *[F.col(str(k)).alias(f"b{k}") for k in range(blocks)])


def dense(edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """The leading rows and columns of a matrix as a table: a row dst, a column c0 .. for each src."""
    own = edges.where((F.col("dst") < rows) & (F.col("src") < columns))
    return own.groupBy("dst").pivot("src", list(range(columns))).agg(F.sum("w")).fillna(0.0).select("dst", *[F.col(str(k)).alias(f"c{k}") for k in range(columns)])


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is at least x; 1 for x below 1."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), highest_bit(x - 1) + 1))


def highest_bit(x: Column) -> Column:
    """The place of the highest bit of x that is set; -1 for 0."""
    return F.when(x > 0, F.length(F.bin(x.cast("long"))) - 1).otherwise(-1)


def whole_power(x: Column, power: int) -> Column:
    out = F.lit(1).cast("long")
    for _ in range(power):
        out = out * x.cast("long")
    return out


def popcount(x: Column) -> Column:
    return F.bit_count(x.cast("long")).cast("long")


def running_sums(v: DataFrame, block: int = 1 << 16) -> DataFrame:
    """id and the sum of x up to and with it, in two levels: inside blocks of ids, and over blocks."""
    own = v.select("id", "x", F.floor(F.col("id") / block).alias("block"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of ids
    blocks = own.groupBy("block").agg(F.sum("x").alias("s")).select("block", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("run", F.sum("x").over(inside)).join(blocks, "block").select("id", (F.col("base") + F.col("run")).alias("x"))


def histogram(v: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """bin (0: below low, bins + 1: from high on) and its number of values."""
    return v.groupBy(F.width_bucket("x", F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def first_dimensions(points: DataFrame, d: int) -> DataFrame:
    return points.select("id", F.slice("x", 1, d).alias("x"))


def permute(v: DataFrame, mapping: DataFrame) -> DataFrame:
    """v(id, ..) under the new ids of mapping(old, new)."""
    return v.join(mapping.select(F.col("old").alias("id"), "new"), "id").drop("id").withColumnRenamed("new", "id").select(*v.columns)


def differing(a: DataFrame, b: DataFrame, relative: float = 2.0**-26) -> DataFrame:
    """id and both values where two vectors differ by more than relative times the larger of 1 and their size, or one is missing."""
    both = a.select("id", F.col("x").alias("p")).join(b.select("id", F.col("x").alias("q")), "id", "full")
    near = F.abs(F.col("p") - F.col("q")) <= relative * F.greatest(F.lit(1.0), F.abs("p"), F.abs("q"))
    return both.where(~F.coalesce(near, F.lit(False)))


def largest_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("x").alias("p")).join(b.select("id", F.col("x").alias("q")), "id", "full")
    return both.agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("difference"))
