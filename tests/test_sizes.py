"""Findings of round 3: queries beyond the sizes that they took before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigree.operators import forces, graph, linalg, neighbors, state
from filigree.plans.queries import canberra


def test_exact_repulsion_takes_more_points_than_20000(spark):
    y = np.random.default_rng(3).normal(size=(21_000, 2))
    coords = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "y0": y[:, 0], "y1": y[:, 1]}))
    got = forces.repulse_exact(coords).orderBy("id").toPandas()
    diff = y[:200, None] - y[None]
    q = 1 / (1 + (diff**2).sum(2))
    assert len(got) == len(y)
    assert np.allclose(got[["f0", "f1"]].to_numpy()[:200] * got.zeta[0], ((q**2)[:, :, None] * diff).sum(1), rtol=1e-9, atol=1e-9)
    zeta = sum((1 / (1 + ((y[k : k + 100, None] - y[None]) ** 2).sum(2))).sum() for k in range(0, len(y), 100)) - len(y)
    assert np.isclose(got.zeta[0], zeta, rtol=1e-12)


def test_exact_repulsion_of_a_few_points_of_one_place(spark):
    coords = spark.createDataFrame([(k, 5.0, 5.0) for k in range(4)], "id long, y0 double, y1 double")
    got = forces.repulse_exact(coords).toPandas()
    assert len(got) == 4 and np.isclose(got.zeta, 12).all() and np.allclose(got[["f0", "f1"]], 0)
    assert forces.repulse_exact(coords.limit(1)).count() == 0


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean", "cityblock", "minkowski", "chebychev", "cosine", "hamming", "jaccard", canberra])
@pytest.mark.parametrize("offset", [0.0, 3.0])
def test_tiles_of_pairs_find_the_nearest(metric, offset):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(600, 8)) + offset, rng.normal(size=(2500, 8)) + offset
    x[:40], y[100:400], x[50:80] = y[:40], y[100], y[100]
    if metric in ("hamming", "jaccard"):
        x, y = (np.round(a) if offset else (a > 0.1) * 1.0 for a in (x, y))
    src, dst = np.arange(600) * 7, np.arange(2500) * 3 + 1
    d = np.stack([neighbors._paired(metric, np.repeat(row[None], len(y), 0), y, 3.0) for row in x]) if metric == "cosine" else neighbors.block_distances(metric, x, y)
    for got, whole, own, other in zip(neighbors._nearest_of(metric, x, y, src, dst, 10, True), (d, d.T), (src, dst), (dst, src), strict=True):
        whole = np.where(own[:, None] == other[None, :], np.inf, whole)
        order = np.lexsort((np.broadcast_to(other, whole.shape), whole), axis=1)[:, :10]
        assert got.num_rows == 10 * len(own)  # ties are cut before a task sends them on
        assert (got.column("dst").to_numpy().reshape(-1, 10) == other[order]).all()
        assert (got.column("d").to_numpy().reshape(-1, 10) == np.take_along_axis(whole, order, 1)).all()


def test_nearest_beside_values_that_are_not_finite():
    x = np.random.default_rng(5).normal(size=(30, 4))
    x[3, 1], x[4, 2] = np.nan, np.inf
    ids = np.arange(30)
    for metric in ("euclidean", "minkowski", "cosine"):
        with np.errstate(invalid="ignore"):
            got = neighbors._nearest_of(metric, x, x, ids, ids, 5, False)[0].to_pandas()
        assert len(got) == 28 * 5 and not set(got.src) & {3, 4} and not set(got.dst) & {3, 4}


def test_leaves_grow_until_the_recall_is_reached(spark):
    x = np.random.default_rng(2).normal(size=(3000, 32))
    pts = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    got = neighbors.knn_approximate(pts, 10, trees=2, leaf_rows=64).toPandas()
    d = ((x[:, None] - x[None, :300]) ** 2).sum(2).T
    d[np.arange(300), np.arange(300)] = np.inf
    want = np.argsort(d, axis=1)[:, :10]
    hits = sum(len(set(want[s]) & set(g)) for s, g in got[got.src < 300].groupby("src").dst)
    assert len(got) == 30_000 and hits >= 0.9 * want.size


def test_vectors_of_matrices_are_not_broadcast(spark):
    ids = spark.range(200)
    v = ids.select("id", F.col("id").cast("double").alias("x"))
    plan = linalg.spmv(graph.banded(ids, 5), v)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_states_of_hubs_are_not_broadcast(spark, monkeypatch):
    plans, own = [], state.written
    monkeypatch.setattr(state, "written", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *a, **b))
    rows = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") / 100.0 + 0.1).alias("d"))
    got = graph.rescaling_of_hubs(rows, 2.0).collect()
    assert len(got) == 20 and all(abs(r.total - 2.0) < 1e-4 for r in got)
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
