"""Findings of round 3 on what grows faster than its input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigree.operators import factor, forces, linalg, neighbors, ordering, treecode
from filigree.plans import queries
from filigree.sources import files, matlab


def test_columns_of_a_product_without_the_product(spark):
    rng = np.random.default_rng(4)
    frame = lambda n: spark.createDataFrame(pd.DataFrame({"src": rng.integers(0, 40, n), "dst": rng.integers(0, 12, n), "w": rng.normal(size=n)}))
    a, b = frame(90), frame(90)
    a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w").cache()
    b.cache()
    want = linalg.spgemm(a, b).groupBy("src").agg(F.count("*").alias("n"), F.sum("w").alias("w")).orderBy("src").toPandas()
    got = linalg.product_columns(a, b).orderBy("src").toPandas()
    assert (got[["src", "n"]] == want[["src", "n"]]).all().all() and np.allclose(got.w, want.w)


def test_a_product_of_many_equal_columns_stays_small(spark):
    b = spark.range(60_000).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dst"), F.lit(1.0).alias("w"))
    got = linalg.product_columns(b.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), b)
    assert got.where("n = 60000 AND w = 300000").count() == 60_000  # 18 billion pairs


def test_sparse_matlab_slices(spark, tmp_path):
    """More columns than a file has entries, a column over several files, gaps, and values with any bytes."""
    rng = np.random.default_rng(8)
    e = np.unique(np.concatenate([rng.integers(0, 900, (700, 2)), np.stack([np.full(300, 7), np.arange(300)], 1), [[3_000_000, 5]]]), axis=0)
    frame = spark.createDataFrame(pd.DataFrame({"src": e[:, 0], "dst": e[:, 1], "w": rng.normal(size=len(e))}))
    matlab.write_mat_sparse(frame, str(tmp_path / "m"), "g.a", 100)
    assert len(list((tmp_path / "m").glob("part-*"))) >= 10
    got = matlab.read_mat_sparse(spark, str(tmp_path / "m"), "g.a")
    assert got.count() == len(e) and got.exceptAll(frame).isEmpty()


def test_matlab_neighbours_in_slices(spark, tmp_path):
    rows = [(3 * s, (s * 5 + r) % 40, r, s + r / 7) for s in range(40) for r in range(4)]
    files.write_mat_neighbours(spark.createDataFrame(rows, "src long, dst long, rank long, d double"), str(tmp_path / "k"), size=30)
    assert len(list((tmp_path / "k").glob("part-*"))) >= 5
    assert sorted(map(tuple, files.read_mat_neighbours(spark, str(tmp_path / "k")).collect())) == rows


def test_matrix_market_files_follow_one_another(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    edges = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("src"), F.col("id").alias("dst"), (F.col("id") + 0.5).alias("w"))
    files.write_matrix_market(edges, str(tmp_path / "g"), 5000)
    parts = sorted((tmp_path / "g").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().split("\n") if x]
    assert len(parts) > 1 and lines[0] == "5000 5000 5000"
    columns = [int(x.split()[1]) for x in lines[1:]]
    assert columns == sorted(columns) == list(range(1, 5001))
    assert files.read_matrix_market(spark, str(tmp_path / "g")).exceptAll(edges).isEmpty()


@pytest.mark.parametrize("grouped", [1 << 16, 150])
def test_dissection_in_groups_and_over_tables(spark, monkeypatch, grouped):
    """Both ways part a mesh with copies of a hub and lone vertices; a part that fits is cut in one round of few jobs."""
    monkeypatch.setattr(ordering, "GROUPED", grouped)
    calls, own = [], ordering._separated
    monkeypatch.setattr(ordering, "_separated", lambda *a: calls.append(1) or own(*a))
    n, width = 600, 20
    edges = ordering.mesh(spark.range(n), width).unionByName(spark.range(600, 640).select(F.lit(5).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    paths = ordering.nested_dissection(edges, spark.range(700), 100)
    got = paths.toPandas()
    assert sorted(got.id) == sorted(got.position) == list(range(700))
    assert ordering.crossing(edges, paths).isEmpty()
    pieces = got.path[~got.path.str.endswith("2")].str.len()
    assert pieces.min() >= 3 and (not calls if grouped > 700 else calls)


def test_halves_of_a_strip_are_even_and_their_cut_is_short():
    e = np.array([(a, a + 1) for a in range(4000) if (a + 1) % 8] + [(a, a + 8) for a in range(3992)])
    u, v = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    side = ordering._halved(4000, u, v, np.ones(len(u)), np.ones(4000))
    assert 1600 <= side.sum() <= 2400 and (side[u] != side[v]).sum() <= 2 * 24


def test_exact_tree_makes_no_pairs_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(treecode, "_walk", lambda *a: pytest.fail("pairs of leaves as rows"))
    coords = spark.range(300).select("id", (F.col("id") % 90 / 7.0).alias("y0"), F.sin(F.col("id") % 90).alias("y1"))
    got, want = (x.orderBy("id").toPandas() for x in (treecode.repulse_tree(coords, 0.0), forces.repulse_exact(coords)))
    assert np.allclose(got, want)
    assert treecode.repulse_tree(coords.limit(1), 0.0).select("f0", "f1", "zeta").collect() == [(0.0, 0.0, 0.0)]


@pytest.mark.parametrize("name", ["perplexity_joint", "perplexity_check", "perplexity_edges"])
def test_pairs_are_compared_once(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_joint_in_tiles(spark, monkeypatch):
    """no step holds all distances of a point or of a pair of groups; copies, whose precision doubles to the end, count as they are."""
    monkeypatch.setattr(neighbors, "knn_exact", None)  # it would hold all distances of a pair of groups
    x = np.random.default_rng(5).normal(size=(60, 3))
    x[50:] = x[49]
    got = neighbors.joint_exact(spark.createDataFrame(pd.DataFrame({"id": range(60), "x": x.tolist()})), 5.0, groups=2).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.zeros((60, 60))
    for i in range(60):
        near, b, lo, hi = np.delete(d[i], i), 1.0, None, None
        for _ in range(100):
            e = np.exp(-b * near)
            diff = b * (near * e).sum() / e.sum() + np.log(e.sum()) - np.log(5.0)
            if abs(diff) < 1e-5:
                break
            lo, hi = (b, hi) if diff > 0 else (lo, b)
            b = (b * 2 if hi is None else (b + hi) / 2) if diff > 0 else (b / 2 if lo is None else (b + lo) / 2)
        p[i, np.arange(60) != i] = np.exp(-b * near) / np.exp(-b * near).sum()
    want = (p + p.T) / 120
    assert len(got) == 60 * 59 and np.allclose(got.w, want[got.src, got.dst], rtol=1e-9, atol=1e-300)


def test_copies_are_taken_out_in_steps(monkeypatch):
    """in a tile of copies all pairs are candidates, whose vectors must not lie in memory at once."""
    most, paired = [], neighbors._paired
    monkeypatch.setattr(neighbors, "_paired", lambda metric, x, y, p: most.append(x.size) or paired(metric, x, y, p))
    x, ids = np.ones((1200, 64)), np.arange(1200)
    near = neighbors._nearest_of("sqeuclidean", x[:300], x[300:], ids[:300], ids[300:], 3, True)
    assert max(most) <= 1 << 20 and sum(most) > 1 << 20 and [t.num_rows for t in near] == [900, 2700]


def test_factor_by_subtrees(spark, monkeypatch):
    """F8 F12: fronts below the first cuts are factored and solved in one step, not in two for each cut."""
    n, b = 400, np.random.default_rng(6).normal(size=400)
    ids = spark.range(n)
    matrix = factor.laplacian(ordering.mesh(ids, 20), ids).cache()
    dense = np.zeros((n, n))
    for r in matrix.collect():
        dense[r.dst, r.src] = r.w
    for most, steps in ((100, 8), (n, 1)):
        monkeypatch.setattr(factor, "SUBTREE", most)
        made = factor.cholesky(matrix, ids)
        assert len(made.steps) <= steps
        low = np.zeros((n, n))
        for r in factor.lower_edges(made).collect():
            low[r.dst, r.src] = r.w
        assert np.allclose(low @ low.T, dense, atol=1e-12)
        got = factor.solve(made, spark.createDataFrame(pd.DataFrame({"id": range(n), "x": b}))).toPandas().sort_values("id")
        assert np.allclose(got.x, np.linalg.solve(dense, b))


def test_part_that_fits_a_group_is_not_cut_over_tables(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_separated", None)
    ids = spark.range(70_000)
    paths = ordering.nested_dissection(ordering.mesh(ids, 40), ids)
    got = paths.agg(F.count("*").alias("n"), F.countDistinct("position").alias("m"), F.max("position").alias("last")).first()
    assert (got.n, got.m, got.last) == (70_000, 70_000, 69_999)
    assert ordering.crossing(ordering.mesh(ids, 40), paths).isEmpty()
