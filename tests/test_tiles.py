"""Findings F39 and F10 of round 3: the descent of large graphs moves no edge in its steps, and starts few tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree import api
from filigree.operators import descent, tiles
from filigree.params import Params
from filigree.plans import queries


def _graph(spark, n=120):
    """Repeated edges, both ways, loops, and vertices without edges; ids below 0 too."""
    rng = np.random.default_rng(1)
    ends = rng.integers(0, n - 5, (900, 2)) * 7 - 200
    rows = [(int(a), int(b), float(w)) for (a, b), w in zip(ends, rng.integers(1, 4, len(ends)), strict=True)] + [(-200, -200, 3.0)]
    v = spark.range(n).select((F.col("id") * 7 - 200).alias("id"))
    return spark.createDataFrame(rows, "src long, dst long, w double"), v, v.select("id", F.sin(F.col("id") * 1.7).alias("y0"), F.cos(F.col("id") * 2.3).alias("y1"))


@pytest.mark.parametrize("blocks, lam, dense", [(False, 1.0, True), (False, 5.0, True), (True, 1.0, True), (True, 5.0, False)])
def test_tiles_equal_the_fused_descent(spark, monkeypatch, blocks, lam, dense):
    edges, v, y = _graph(spark)
    params = Params(max_iter=3, lam=lam, rate=20.0)
    want = descent.fused(api.joint(edges, params).cache(), y, params).toPandas().sort_values("id")
    monkeypatch.setattr(descent, "FUSED_POINTS", 10)
    monkeypatch.setattr(descent, "descend", None)  # its steps join edges with coordinates
    monkeypatch.setattr(tiles, "LEAST_BITS", 1)
    if blocks:
        monkeypatch.setattr(tiles, "WHOLE_PAIRS", 0)
    if not dense:
        monkeypatch.setattr(tiles, "DENSE_CELLS", 10)
    got = api.embed_graph(edges, params, v, y).toPandas().sort_values("id")
    assert len(got) == 120 and np.allclose(got, want, atol=1e-9)


def test_tiles_check_their_vertices(spark, monkeypatch):
    monkeypatch.setattr(descent, "FUSED_POINTS", 1)
    edges, v, y = _graph(spark)
    with pytest.raises(ValueError, match="edges end at -200"):
        api.embed_graph(edges, Params(max_iter=1), v.where("id > -200"), y)


def test_pairs_of_orders_sum_to_what_was_bought_together(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.bought_pairs(spark, sf).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    want = queries.bought_together(spark, sf)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
