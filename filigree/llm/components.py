"""Connected components of an edge table, by alternating large and small stars; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it is linked with) of all nodes of the edges (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        before, now = now, written(small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
    discard(now)
    return out
