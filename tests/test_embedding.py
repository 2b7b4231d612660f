"""The reference's two differential tests, invariants, files, and SQL twins of some queries."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from filigree import api
from filigree.operators import descent, forces, graph, linalg, neighbors
from filigree.params import CUSTOM, Params, check_points
from filigree.sources import files

SF = "/root/testdata/sf0.001"


def coords_frame(spark, y):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(y))} | {f"y{k}": y[:, k] for k in range(y.shape[1])}))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_attraction_against_brute_force(spark, d):
    n = 1000
    y = np.random.default_rng(d).random((n, d))
    p = graph.symmetrize(graph.random_graph(spark, n, 3))
    e = p.toPandas()
    diff = y[e.src] - y[e.dst]
    q = e.w.to_numpy() / (1 + (diff**2).sum(1))
    want = np.stack([np.bincount(e.src, q * diff[:, k], n) for k in range(d)], 1)
    got = forces.attract(p, coords_frame(spark, y)).toPandas().set_index("id").reindex(range(n)).fillna(0).to_numpy()
    assert np.abs(got - want).max() <= 1e-10


@pytest.mark.parametrize(("n", "d", "h"), [(1000, 1, 0.05), (2000, 2, 0.08), (1000, 3, 0.13)])
def test_gridded_repulsion_against_all_pairs(spark, n, d, h):
    y = np.random.default_rng(n + d).random((n, d))
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(2))
    zeta = q.sum() - n
    want = ((q**2)[:, :, None] * diff).sum(1) / zeta
    push, z = descent.repulsion(y, h)
    assert np.abs(push / z - want).max() <= 1e-7 and abs(z / zeta - 1) <= 1e-4
    if d < 3 or n <= 1000:
        got = forces.repulse_grid(coords_frame(spark, y), h).toPandas().sort_values("id")
        assert np.abs(got[[f"f{k}" for k in range(d)]].to_numpy() - want).max() <= 1e-7
        assert abs(got.zeta.iloc[0] / zeta - 1) <= 1e-4


def test_joint_is_a_symmetric_distribution(spark):
    p = api.joint(graph.random_graph(spark, 200, 1), Params(lam=2.0)).toPandas()
    assert abs(p.w.sum() - 1) < 1e-9
    both = p.merge(p, left_on=["src", "dst"], right_on=["dst", "src"], how="left")
    assert np.abs(both.w_x - both.w_y).max() < 1e-12


def test_grid_sizes():
    assert forces.smooth_size(14) == 14 and forces.smooth_size(10_000) == 510
    t = np.linspace(0, 1, 7)
    assert np.allclose(sum(forces.weights(t)), 1)


def test_leaf_loop_repeat_and_zero(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.5), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 3.0), (2, 3, 1.0)], "src long, dst long, w double")
    rows = {(r.src, r.dst): r.w for r in graph.rescale(graph.make_stochastic(graph.dedup_sum(e)), 1.5, drop_leaf=True).collect()}
    assert rows[0, 1] == 0.0 and rows[1, 1] == 0.0 and rows[2, 0] == 0.0
    assert abs(rows[2, 1] + rows[2, 3] - 1) < 1e-9


def test_descent_lowers_the_cost(spark):
    rows = [(i, j, 1.0) for b in range(2) for i in range(b * 20, b * 20 + 20) for j in range(b * 20, b * 20 + 20) if i != j]
    p = spark.createDataFrame(rows, "src long, dst long, w double")
    short, long_ = (api.embed_graph(p, Params(max_iter=m, early_iter=20, rate=5.0)).toPandas() for m in (1, 120))
    assert long_.cost.iloc[0] < short.cost.iloc[0]
    assert np.abs(long_[["y0", "y1"]].mean()).max() < 1e-8


def test_matrix_market_round_trip(spark, tmp_path):
    e = graph.dedup_sum(graph.random_graph(spark, 30, 2))
    files.write_matrix_market(e, str(tmp_path / "g"), 30)
    got = files.read_matrix_market(spark, str(tmp_path / "g"))
    assert got.join(e.withColumnRenamed("w", "v"), ["src", "dst"], "full").where(F.coalesce(F.abs(F.col("w") - F.col("v")), F.lit(1.0)) > 1e-12).count() == 0


def test_neighbours_need_no_clones(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, x array<double>")
    got = {(r.src, r.dst) for r in neighbors.knn_exact(pts, 1).collect()}
    assert got == {(0, 1), (1, 0), (2, 0)}


@pytest.mark.parametrize("scale", [0.01, 300.0])
def test_approximate_neighbours_recall(spark, scale):
    rng = np.random.default_rng(2)
    x = scale * np.concatenate([rng.normal(size=(250, 8)), 0.2 * rng.normal(size=(140, 8)) + 9, rng.normal(size=(10, 8)) * 60])
    pts = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    exact, got = neighbors.knn_exact(pts, 10).toPandas(), neighbors.knn_approximate(pts, 10, leaf_rows=64).toPandas()
    assert set(got.groupby("src").size()) == {10} and got.src.nunique() == len(x)
    assert len(exact.merge(got, on=["src", "dst"])) >= 0.9 * len(exact)


@pytest.mark.parametrize("metric", ["seuclidean", "mahalanobis"])
def test_scaled_metrics_against_brute_force(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ np.array([[50.0, 3, 0], [0, 1, 0.2], [0, 0, 0.01]])
    pts = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    cov = np.cov(x.T)
    inverse = np.linalg.inv(cov if metric == "mahalanobis" else np.diag(np.diag(cov)))
    diff = x[:, None] - x[None]
    d = np.sqrt(np.einsum("ijk,kl,ijl->ij", diff, inverse, diff)) + np.diag(np.full(60, np.inf))
    got = neighbors.knn_exact(pts, 4, metric).toPandas().sort_values(["src", "rank"])
    assert np.array_equal(got.dst.to_numpy().reshape(60, 4), np.argsort(d, axis=1)[:, :4])
    assert np.allclose(got.d.to_numpy().reshape(60, 4), np.sort(d, axis=1)[:, :4])


def test_seuclidean_twin(spark):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
        want = db.execute(__spark_entry__.oracle_sql()["knn_seuclidean"]).df()
    got = __spark_entry__.queries()["knn_seuclidean"](spark, SF).toPandas().merge(want, on=["src", "rank"])
    assert len(got) == len(want) and (got.dst_x == got.dst_y).all() and np.allclose(got.d_x, got.d_y, atol=2e-6)


def ring(spark, n):
    return spark.createDataFrame([(k, (k + s) % n, 1.0 / s) for k in range(n) for s in (1, 2, n - 1)], "src long, dst long, w double")


def test_descent_over_tables_equals_the_fused_one(spark):
    p, params = api.joint(ring(spark, 60), Params()), Params(max_iter=6, early_iter=3, step=0.3, rate=2.0)
    y = coords_frame(spark, np.random.default_rng(1).normal(size=(60, 2)))
    one = descent.fused(p, y, params).toPandas().sort_values("id")
    seen = []
    two = descent.with_cost(p, descent.descend(p, y, params, on_iteration=lambda i, state: seen.append((i, state.count()))), params).toPandas().sort_values("id")
    assert np.allclose(one[["y0", "y1", "cost"]], two[["y0", "y1", "cost"]], atol=1e-7)
    assert seen == [(k, 60) for k in range(6)]
    stopped = []
    descent.descend(p, y, CUSTOM.with_(max_iter=9, tolerance=1e9), on_iteration=lambda i, _: stopped.append(i))
    assert stopped == [0]


def test_large_graphs_descend_over_tables(spark, monkeypatch):
    edges, y = ring(spark, 30), coords_frame(spark, np.random.default_rng(2).normal(size=(30, 2)))
    params = Params(max_iter=4, rate=2.0)
    one = api.embed_graph(edges, params, y0=y).toPandas().sort_values("id")
    monkeypatch.setattr(descent, "FUSED_POINTS", 10)
    two = api.embed_graph(edges, params, y0=y).toPandas().sort_values("id")
    assert list(one.columns) == list(two.columns) and np.allclose(one, two, atol=1e-7)
    with pytest.raises(ValueError, match="descend"):
        descent.fused(edges, y, params)


def test_vertices_and_starts_are_checked(spark):
    edges, y = ring(spark, 5), coords_frame(spark, np.random.default_rng(2).normal(size=(5, 2)))
    with pytest.raises(ValueError, match="edges end at 4"):
        api.embed_graph(edges, Params(max_iter=1), spark.range(4))
    with pytest.raises(ValueError, match="no coordinates for 4"):
        api.embed_graph(edges, Params(max_iter=1), y0=y.where("id < 4"))
    with pytest.raises(ValueError, match="3 coordinates"):
        api.embed_graph(edges, Params(max_iter=1, dims=3), y0=y)
    with pytest.raises(ValueError, match="theta"):
        Params(theta=2.0)


def test_parameters_are_checked(spark):
    assert "max_iter=1000" in repr(Params()) and Params().with_(dims=None, lam=3.0) == Params(lam=3.0)
    assert check_points(9, 4, None) == 5 and check_points(100, 4, None) == 30
    for bad in ({"dims": 4}, {"lam": 0.0}, {"alpha": 0.5}, {"rate": 0.0}, {"max_iter": -1}, {"theta": -0.1}):
        with pytest.raises(ValueError):
            Params(**bad)
    for n, features, u, parts in ((10, 4, 11.0, 0), (10, 4, 0.0, 0), (10, 4, 3.0, 5), (10, 4, 3.0, 1)):
        with pytest.raises(ValueError):
            check_points(n, features, u, parts)
    pts = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0, 2.0]), (2, [float("inf"), 1.0])], "id long, x array<double>")
    assert [r.id for r in neighbors.clean(pts.where("id < 2")).collect()] == [1]
    with pytest.raises(Exception, match="infinite"):
        neighbors.clean(pts).collect()


def test_front_end_of_points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(20, 6)), rng.normal(size=(20, 6)) + 8])
    pts = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    seen = []
    got = api.embed_points(pts, 4.0, CUSTOM.with_(max_iter=3), scaled=True, components=3, metric="cityblock", on_iteration=lambda i, state: seen.append(i))
    assert got.count() == 40 and seen == [0, 1, 2] and got.columns == ["id", "y0", "y1", "cost"]
    assert api.embed_points(pts, 4.0, Params(max_iter=2), exact=False).count() == 40


def test_timings_file(spark, tmp_path):
    files.write_timings(spark, [("attract", 0.5), ("repulse", 1.25)], str(tmp_path / "t.csv"))
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True, inferSchema=True).collect()[1].seconds == 1.25


def test_matlab_files(spark, tmp_path):
    x = {"IDX": np.array([[2.0, 3], [1, 3], [1, 2]]), "D": np.array([[0.1, 0.2], [0.1, 0.3], [0.2, 0.3]])}
    for compressed in (False, True):
        assert all(np.array_equal(files.mat_arrays(files.mat_file(x, compressed))[k], v) for k, v in x.items())
    small = files.mat_file({"a": np.array([[1.0]])}, False).replace(b"\x01\x00\x00\x00\x01\x00\x00\x00a" + bytes(7), b"\x01\x00\x01\x00a" + bytes(3))  # the name as a small element
    assert files.mat_arrays(small)["a"] == 1
    files.write_mat(spark, x, str(tmp_path / "k.mat"))
    got = files.read_mat_neighbours(spark, str(tmp_path / "k.mat")).orderBy("src", "rank").collect()
    assert [tuple(r) for r in got][:3] == [(0, 1, 0, 0.1), (0, 2, 1, 0.2), (1, 0, 0, 0.1)]


def test_problem_file_without_seed(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    files.write_problem(spark, x, str(tmp_path / "p"), theta=0.3)
    head, rows = files.read_problem(spark, str(tmp_path / "p"))
    assert head["seed"] is None and head["theta"] == 0.3 and (head["n"], head["d"]) == (3, 2)
    assert [r.x for r in rows.orderBy("id").collect()] == x.tolist()


def test_hubs_are_bisected_over_tables(spark, monkeypatch):
    edges = graph.make_stochastic(graph.dedup_sum(graph.random_graph(spark, 40, 6).unionByName(spark.range(30).selectExpr("0L AS src", "id AS dst", "1.0 / (id + 1) AS w"))))
    want = {r.src: r for r in graph.rescaling(edges, 3.0).collect()}
    monkeypatch.setattr(graph, "ROW_NEIGHBOURS", 9)
    got = {r.src: r for r in graph.rescaling(edges, 3.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].g - want[k].g) < 1e-9 and got[k].degree == want[k].degree for k in want)


def test_copies_fall_into_leaves(spark):
    pts = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(90)], "id long, x array<double>")
    got = neighbors.leaves(pts, 2, 16).groupBy("tree", "leaf").count().toPandas()
    assert got["count"].max() <= 16 and set(got.groupby("tree")["count"].sum()) == {90}
    assert neighbors.knn_approximate(pts, 5, leaf_rows=16).where("d = 0").count() == 450


def test_vector_product(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(0, 5.0), (1, 7.0)], "id long, x double")
    assert [tuple(r) for r in linalg.spmv(e, v).collect()] == [(1, 31.0)]


@pytest.mark.parametrize("name", ["knn_cosine", "knn_spearman", "knn_function", "pca", "perplexity_beta", "perplexity_beta_normalised", "joint_exact", "normalize_joint", "rescale_distances", "rescaling_of_hubs", "offsets", "random_graph", "banded_limited", "banded_symmetric", "bit_helpers", "vectors", "top_level", "knn_mahalanobis", "attract_2d", "attract_bipartite", "repulse_grid_2d", "repulse_grid_fft_3d", "scatter_smooth", "update_step", "kl_cost", "descend_grid", "descend_custom", "embed_points", "embed_graph", "file_matrix_market", "file_dense", "file_problem", "file_result", "file_binary", "file_text", "file_mat"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(__spark_entry__.oracle_sql()[name]).df(), __spark_entry__.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and np.allclose(a.to_numpy(float), b.to_numpy(float), atol=2e-5)
