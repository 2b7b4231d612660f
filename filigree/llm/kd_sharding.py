"""K-d tree sharding.

The documents' metadata (size, source, language, doc_id) is a point set. A node is split at the weighted median (the
weights are bytes) of its widest dimension, in shares that fit the shards below, until a leaf is one shard of the
target bytes. Medians are found without sorting: histograms of all nodes of a level are gathered together and
narrowed to one value, and then to one doc_id among the rows with that value; so a source with a third of all rows
is split like any other. The driver holds only histogram bins, as many whatever the number of nodes, and the tree. Rows
carry the number of their node, so plans do not grow with the tree.

Law `bytes`: each split is off by half of one document at most. Null texts have size 1; rows with equal doc_id and
metadata stay together. Empty tables give no rows. Rows with null doc_id are dealt like those of doc_id -1, and come back
with null. Equal texts are not kept in one shard: a group of them may be larger than a shard. Further columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bins of a node's histogram, and of all nodes of a level together.
BINS, LEAST_BINS, MOST_BINS = 4096, 16, 1 << 18
DIMENSIONS = ("size", "source_key", "lang_key", "doc_id")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions of every row, without the texts."""
    text = F.col("text").cast("string")
    key = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)) if c in docs.columns else F.lit(0).cast("long")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
        F.col("doc_id").cast("long").isNotNull().alias("named"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key("source").alias("source_key"),
        key("lang").alias("lang_key"),
    )


#: Tables with a row for each node are sent to every executor up to this many rows.
BROADCAST_NODES = 1 << 20
#: Levels whose splits are joined one after the other before the rows are written.
CHAINED = 4


def _beside(rows: DataFrame, table: list[tuple], kind: str, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has a row for each node."""
    small = rows.sparkSession.createDataFrame(table, kind)
    return rows.join(F.broadcast(small) if len(table) <= BROADCAST_NODES else small, "node", how)


def _value(dimension: Column) -> Column:
    return F.element_at(F.array(*[F.col(c).cast("long") for c in DIMENSIONS]), dimension + 1)


_WITHIN = "node long, dimension int, tie int, tied long, low long, high long, width long"


@dataclass
class Search:
    """A dimension, the dimension and value that the rows are tied at (-1: none), bounds, the weight wanted, and the weight
    before and at the value found, which is low in the end."""

    dimension: int
    tie: int
    tied: int
    low: int
    high: int
    wanted: float
    before: float = 0.0
    at: float = 0.0


def _narrow(rows: DataFrame, searches: dict[int, Search]) -> None:
    """Narrow each node's search to the value of its dimension at which the running weight reaches what is wanted: by
    histograms of all nodes at once, which hold fewer bins for each the more nodes there are."""
    open_ = dict(searches)
    while open_:
        bins = max(LEAST_BINS, min(BINS, MOST_BINS // len(open_)))
        width = {k: max(1, -(-(s.high - s.low + 1) // bins)) for k, s in open_.items()}
        table = [(k, s.dimension, s.tie, s.tied, s.low, s.high, width[k]) for k, s in open_.items()]
        own = _beside(rows, table, _WITHIN).withColumn("value", _value(F.col("dimension"))).where("value between low and high")
        own = own.where((F.col("tie") < 0) | (_value(F.greatest("tie", F.lit(0))) == F.col("tied")))
        got = own.groupBy("node", F.expr("(value - low) div width").alias("bin")).agg(F.sum("size").alias("w")).toArrow()
        found: dict[int, list[tuple[int, int]]] = {k: [] for k in open_}
        for node, place, w in zip(*(got.column(c).to_pylist() for c in ("node", "bin", "w")), strict=True):
            found[node].append((place, w))
        for k, s in list(open_.items()):
            run = s.before
            for place, w in (ordered := sorted(found[k])):
                if run + w >= s.wanted or place == ordered[-1][0]:
                    s.before, s.at = run, w
                    s.low, s.high = s.low + place * width[k], min(s.high, s.low + (place + 1) * width[k] - 1)
                    break
                run += w
            if s.low == s.high or not ordered:
                del open_[k]


def grow(rows: DataFrame, shards: int) -> DataFrame:
    """rows with the shard that the tree puts them in. The driver holds the tree, and the bins of a level."""
    state = rows.withColumn("node", F.lit(0).cast("long"))
    live, leaves, span, level = {0: (shards, 0)}, {}, None, 0
    while True:
        leaves |= {k: first for k, (n, first) in live.items() if n == 1}
        live = {k: x for k, x in live.items() if x[0] > 1}
        if not live:
            return _beside(state, list(leaves.items()), "node long, shard int").drop("node")
        extremes = [f(c).alias(f"{c}_{f.__name__}") for c in DIMENSIONS for f in (F.min, F.max)]
        stats = {r.node: r for r in _beside(state.withColumn("_w", F.col("size")), [(k,) for k in live], "node long").groupBy("node").agg(F.sum("_w").alias("w"), *extremes).collect()}
        span = span or {c: max(1, r[f"{c}_max"] - r[f"{c}_min"]) for r in stats.values() for c in DIMENSIONS}
        searches = {}
        for k, s in stats.items():
            d = max(range(len(DIMENSIONS)), key=lambda i: (s[f"{DIMENSIONS[i]}_max"] - s[f"{DIMENSIONS[i]}_min"]) / span[DIMENSIONS[i]])  # noqa: B023
            searches[k] = Search(d, -1, 0, s[f"{DIMENSIONS[d]}_min"], s[f"{DIMENSIONS[d]}_max"], s.w * (live[k][0] // 2) / live[k][0])
        _narrow(state, searches)
        ids = len(DIMENSIONS) - 1
        ties = {k: Search(ids, s.dimension, s.low, stats[k].doc_id_min, stats[k].doc_id_max, s.wanted - s.before) for k, s in searches.items()}
        _narrow(state, ties)
        splits = []
        for k in live:
            if k not in searches:  # no rows
                splits.append((k, 0, 0, 0))
                continue
            s, t = searches[k], ties[k]
            left = s.before + t.before
            splits.append((k, s.dimension, s.low, t.low if abs(left + t.at - s.wanted) <= abs(left - s.wanted) else t.low - 1))
        value = _value(F.col("dimension"))
        right = F.when((value < F.col("cut")) | ((value == F.col("cut")) & (F.col("doc_id") <= F.col("last"))), 0).otherwise(1)
        node = F.when(F.col("dimension").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right)
        state = _beside(state, splits, "node long, dimension int, cut long, last long", "left").select(*rows.columns, node.alias("node"))
        live = {2 * k + 1 + side: (n // 2, first) if not side else (n - n // 2, first + n // 2) for k, (n, first) in live.items() for side in (0, 1)}
        level += 1
        if level % CHAINED == 0:
            state = written(state, "nodes")


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard, by doc_id) of every row.

    Give the number of shards, or the bytes that a shard should have.
    """
    rows = written(metadata(docs), "metadata")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 1
        shards = max(1, -(-total // target_bytes))
    placed = grow(rows, shards).select("doc_id", "named", "size", "text_crc32", "shard")
    dealt = placed.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id", "named", "text_crc32")
    numbered = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "placed")
    ends = numbered.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("shard", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    few = ends.count() <= BROADCAST_NODES  # one row for each shard and partition
    return numbered.join(F.broadcast(ends) if few else ends, ["shard", "_part"]).select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "size", "text_crc32", "shard", (F.col("_row") + F.col("_shift")).alias("slot"))
