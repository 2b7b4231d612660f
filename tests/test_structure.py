"""The tree code, orderings, components, matchings and elimination trees against brute force and their SQL twins."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from filigree import api
from filigree.operators import blocks, descent, elimination, factor, forces, graph, leastsquares, ordering, spatial, state, strong, treecode
from filigree.params import Params
from filigree.sources import files, matlab

SF = "/root/testdata/sf0.001"


def coords_frame(spark, y):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(y))} | {f"y{k}": y[:, k] for k in range(y.shape[1])}))


def all_pairs(y):
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(2))
    zeta = q.sum() - len(y)
    return ((q**2)[:, :, None] * diff).sum(1) / zeta, zeta


@pytest.mark.parametrize("d", [1, 2, 3])
def test_tree_repulsion_nears_all_pairs(spark, d):
    """Clusters, exact and near copies: the error falls with theta, and is nothing but rounding at 0."""
    rng = np.random.default_rng(d)
    y = np.concatenate([rng.normal(size=(500, d)) * 5, rng.normal(size=(200, d)) * 1e-7 + 3])
    y[:80] = y[0]
    want, zeta = all_pairs(y)
    errors = []
    for theta in (0.0, 0.4, 0.9) if d == 2 else (0.0, 0.3):
        got = treecode.repulse_tree(coords_frame(spark, y), theta, 16).toPandas().sort_values("id")
        assert len(got) == len(y)
        errors.append((np.abs(got[[f"f{k}" for k in range(d)]].to_numpy() - want).max() / np.abs(want).max(), abs(got.zeta.iloc[0] / zeta - 1)))
    assert max(errors[0]) < 1e-12 and max(errors[1]) < 0.02
    assert d != 2 or errors[1][0] < errors[2][0] < 0.15


def test_tree_repulsion_of_few_points(spark):
    none = spark.createDataFrame([], "id long, y0 double, y1 double")
    assert treecode.repulse_tree(none).count() == 0
    one = treecode.repulse_tree(coords_frame(spark, np.zeros((1, 2)))).collect()
    assert [(r.id, r.f0, r.f1, r.zeta) for r in one] == [(0, 0.0, 0.0, 0.0)]
    same = treecode.repulse_tree(coords_frame(spark, np.ones((5, 2)))).collect()
    assert all((r.f0, r.f1, r.zeta) == (0.0, 0.0, 20.0) for r in same)


def test_tree_meets_few_cells(spark, monkeypatch):
    """Pairs grow with n log n, and leaves with many sources are dealt over groups."""
    counts = []
    for n in (1000, 4000):
        y = np.random.default_rng(n).random((n, 2))
        nodes = treecode.tree(treecode.positions(coords_frame(spark, y)), 16).persist()
        counts.append(sum(t.count() for t in treecode._walk(nodes, 2, 0.7)))
    assert counts[1] < 4 * 2 * counts[0]
    monkeypatch.setattr(treecode, "GROUP_ROWS", 50)
    monkeypatch.setattr(treecode, "BROADCAST_CELLS", 3)
    want, _ = all_pairs(y[:300])
    got = treecode.repulse_tree(coords_frame(spark, y[:300]), 0.0, 8).toPandas().sort_values("id")
    assert np.abs(got[["f0", "f1"]].to_numpy() - want).max() < 1e-14


def test_descent_by_the_tree(spark):
    """The tree stands in for the grid in whole embeddings, and what steps leave on the disk does not grow with their number."""
    edges = graph.random_graph(spark, 60, 2)
    start = coords_frame(spark, np.random.default_rng(0).normal(size=(60, 2)) * 1e-2)
    params = Params(max_iter=2, repulsion="tree", theta=0.0)
    got = api.embed_graph(edges, params, y0=start).toPandas().sort_values("id")
    want = api.embed_graph(edges, params.with_(repulsion="exact"), y0=start).toPandas().sort_values("id")
    assert np.abs(got[["y0", "y1"]].to_numpy() - want[["y0", "y1"]].to_numpy()).max() < 1e-9
    assert abs(got.cost.iloc[0] - want.cost.iloc[0]) < 1e-9
    home = graph.shared_folder(spark.sparkContext).removeprefix("file://").removeprefix("file:")
    left = lambda: len(glob.glob(f"{home}/filigree-steps/*/*"))
    before = left()
    p = api.joint(edges, Params())
    descent.descend(p, start, Params(max_iter=3), exact=True).count()
    assert left() - before == 1  # the coordinates
    with pytest.raises(ValueError, match="repulsion"):
        Params(repulsion="none")


def pairs_frame(spark, pairs):
    return spark.createDataFrame(pd.DataFrame(np.asarray(pairs, np.int64).reshape(-1, 2), columns=["src", "dst"]), "src long, dst long")


def ids_frame(spark, n):
    return spark.range(n).select("id")


# --- grids -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("d", "n"), [(2, 18), (3, 14)])
def test_planes_convolve_like_one_task(spark, d, n):
    """In chunks of three lines, from cells of which some are not there."""
    v = np.random.default_rng(d).normal(size=(d + 1, *[n + 2] * d))
    v[:, 3] = 0
    want = forces.convolve_fft(v, 0.37)
    at = np.indices([n + 2] * d).reshape(d, -1)
    cells = pd.DataFrame({f"g{k}": at[k].astype(np.int32) for k in range(d)} | {f"v{m}": v[m].ravel() for m in range(d + 1)})
    line = (d + 2) * (n + 2) * 16 * (n + 2 if d == 3 else 1)
    got = blocks.convolve_planes(spark.createDataFrame(cells[cells.g0 != 3]), d, n, 0.37, 3 * line).toPandas()
    out = np.zeros_like(want)
    for m in range(d + 1):
        out[m][tuple(got[f"g{k}"] for k in range(d))] = got[f"phi{m}"]
    assert len(got) == (n + 2) ** d and np.abs(out - want).max() < 1e-12


@pytest.mark.parametrize("d", [1, 2, 3])
def test_blocks_meet_at_their_borders(spark, d):
    """Blocks of eight cells, a crowd of equal points dealt over groups: the same sums and potentials as from one array."""
    y = np.random.default_rng(d).random((600, d)) * 25
    y[:200] = y[0]
    coords = coords_frame(spark, y)
    low, extent, n, h = forces.grid_of(coords, 1.0)
    placed = forces.cells(coords, low, extent, n)
    small = blocks.dealt(placed, d, 8, 50)
    assert small.where("way > 0").count() and small.groupBy("block", "way").count().agg({"count": "max"}).first()[0] < 120
    phi = forces.convolve_grid(blocks.scatter(small, d, block=8), d, n, h)
    got = blocks.gather(small, phi, d, block=8).toPandas().sort_values("id")
    z = got[[f"z{k}" for k in range(d)]].to_numpy()
    potentials = got[[f"phi{m}" for m in range(d + 1)]].to_numpy()
    push, zeta = descent.repulsion(y, 1.0)
    assert np.abs(z * potentials[:, :1] - potentials[:, 1:] - push).max() < 1e-9 * zeta
    whole = forces.repulse_grid(coords, 1.0, by_planes=d > 1).toPandas().sort_values("id")
    assert np.abs(whole[[f"f{k}" for k in range(d)]].to_numpy() - push / zeta).max() < 1e-12


# --- orderings -------------------------------------------------------------------------------------------------------
def brute_elimination(n, pairs):
    """Parents and column counts by elimination."""
    rows = [set() for _ in range(n)]
    for a, b in np.asarray(pairs).tolist():
        if a != b:
            rows[min(a, b)].add(max(a, b))
    parents, counts = [None] * n, []
    for j in range(n):
        counts.append(len(rows[j]) + 1)
        if rows[j]:
            parents[j] = min(rows[j])
            rows[parents[j]] |= rows[j] - {parents[j]}
    return parents, counts


def test_dissection_of_a_mesh_over_tables(spark):
    """A permutation; SQL finds no edge across a cut; fill is far below that of the natural and of a random order."""
    n, width = 900, 30
    edges = ordering.mesh(ids_frame(spark, n), width)
    got = ordering.nested_dissection(edges, ids_frame(spark, n), 400).toPandas()
    assert sorted(got.id) == sorted(got.position) == list(range(n))
    assert got.sort_values("position").path.is_monotonic_increasing
    e = edges.toPandas()
    con = duckdb.connect()
    con.register("e", e)
    con.register("o", got)
    first = "(SELECT min(k) FROM range(1, least(len(p.path), len(q.path)) + 1) r(k) WHERE substr(p.path, k, 1) <> substr(q.path, k, 1))"
    assert con.execute(f"SELECT count(*) FROM (SELECT p.path AS a, q.path AS b, {first} AS k FROM e JOIN o p ON src = p.id JOIN o q ON dst = q.id) WHERE substr(a, k, 1) IN ('0', '1') AND substr(b, k, 1) IN ('0', '1')").fetchone()[0] == 0
    place = got.set_index("id").position.sort_index().to_numpy()
    fill = [sum(brute_elimination(n, p[e[["src", "dst"]].to_numpy()])[1]) for p in (place, np.arange(n), np.random.default_rng(1).permutation(n))]
    assert fill[0] < 0.75 * fill[1] < fill[2]


def test_dissection_of_odd_graphs(spark):
    """A hub, vertices without edges, loops, repeats and no vertices at all; a complete graph ends although no cut parts it."""
    hub = [(0, k) for k in range(1, 120)]
    got = ordering.nested_dissection(pairs_frame(spark, [*hub, (5, 5), (0, 1), (1, 0)]), ids_frame(spark, 130), 100).toPandas()
    assert sorted(got.position) == list(range(130)) and sorted(got.id) == list(range(130))
    full = [(a, b) for a in range(40) for b in range(a)]
    got = ordering.nested_dissection(pairs_frame(spark, full), ids_frame(spark, 40), 20).toPandas()
    assert sorted(got.position) == list(range(40))
    assert ordering.nested_dissection(pairs_frame(spark, []), ids_frame(spark, 0)).count() == 0


@pytest.mark.parametrize(("n", "m"), [(200, 260), (60, 400)])
def test_elimination_against_brute_force(spark, monkeypatch, n, m):
    """In one range and in many; neighbours in one block and in many."""
    pairs = np.random.default_rng(n).integers(0, n, (m, 2))
    parents, counts = brute_elimination(n, pairs)
    edges, ids = pairs_frame(spark, pairs), ids_frame(spark, n)
    got = dict(map(tuple, elimination.tree(edges, ids).collect()))
    assert [got[k] for k in range(n)] == parents
    for name, value in (("RANGE", 32), ("BATCH", 50), ("BLOCK_BITS", 2)):
        monkeypatch.setattr(elimination, name, value)
    tree = elimination.tree(edges, ids)
    got = dict(map(tuple, tree.collect()))
    assert [got[k] for k in range(n)] == parents
    got = dict(map(tuple, elimination.column_counts(edges, ids, tree).collect()))
    assert [got[k] for k in range(n)] == counts


def test_elimination_without_edges(spark):
    assert sorted(map(tuple, elimination.column_counts(pairs_frame(spark, [(1, 1)]), ids_frame(spark, 3)).collect())) == [(0, 1), (1, 1), (2, 1)]
    assert elimination.tree(pairs_frame(spark, []), ids_frame(spark, 0)).count() == 0


def test_factor_and_solution(spark):
    """A random matrix with a dominant diagonal, cut over tables: L L' is the matrix, x solves it, unconnected vertices too."""
    n = 150
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, n - 5, (260, 2))
    edges = graph.symmetrize(pairs_frame(spark, pairs).where("src <> dst").selectExpr("src", "dst", "1.0D + (src * 7 + dst) % 3 AS w"))
    matrix = factor.laplacian(edges, ids_frame(spark, n), 0.5)
    dense = np.zeros((n, n))
    m = matrix.toPandas()
    dense[m.dst, m.src] = m.w
    made = factor.cholesky(matrix, ids_frame(spark, n), ordering.nested_dissection(edges, ids_frame(spark, n), 80))
    low = factor.lower_edges(made).toPandas()
    full = np.zeros((n, n))
    full[low.dst, low.src] = low.w
    assert np.abs(full @ full.T - dense).max() < 1e-10
    b = rng.normal(size=n)
    got = factor.solve(made, spark.createDataFrame(pd.DataFrame({"id": range(n), "x": b}))).toPandas().sort_values("id")
    assert np.abs(got.x - np.linalg.solve(dense, b)).max() < 1e-9
    made.close()
    wrong = pairs_frame(spark, [(0, 0), (1, 1)]).selectExpr("src", "dst", "-1.0D AS w")
    with pytest.raises(Exception, match="positive definite"):
        factor.cholesky(wrong, ids_frame(spark, 2))


# --- components and matchings ----------------------------------------------------------------------------------------
@pytest.mark.parametrize(("n", "m"), [(80, 95), (60, 130)])
def test_strong_components_against_closure(spark, n, m):
    pairs = np.random.default_rng(m).integers(0, n, (m, 2))
    ways = np.eye(n, dtype=bool)
    ways[pairs[:, 0], pairs[:, 1]] = True
    for k in range(n):
        ways |= ways[:, [k]] & ways[[k], :]
    want = [(k, int(np.flatnonzero(ways[k] & ways[:, k]).min())) for k in range(n)]
    assert sorted(map(tuple, strong.strong_components(pairs_frame(spark, pairs), ids_frame(spark, n)).collect())) == want


def test_strong_components_of_odd_graphs(spark):
    ring = [(k, (k + 1) % 12) for k in range(12)] + [(12, 12), (13, 0), (5, 14)]
    assert {(r.id, r.scc) for r in strong.strong_components(pairs_frame(spark, ring * 2), ids_frame(spark, 16)).collect()} == {(k, 0 if k < 12 else k) for k in range(16)}
    assert strong.strong_components(pairs_frame(spark, []), ids_frame(spark, 0)).count() == 0


def brute_matching(pairs):
    near, mate = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def grown(a, seen):
        for b in near[a] - seen:
            seen.add(b)
            if b not in mate or grown(mate[b], seen):
                mate[b] = a
                return True
        return False

    return sum(grown(a, set()) for a in list(near))


def test_matching_and_its_form(spark):
    """A matching of the greatest size; its cover by alternating ways proves it; edges go only from later parts to earlier ones."""
    rng = np.random.default_rng(8)
    pairs = sorted(set(zip(rng.integers(0, 50, 90).tolist(), rng.integers(0, 45, 90).tolist(), strict=True)))
    got = strong.maximum_matching(pairs_frame(spark, pairs)).toPandas()
    assert set(map(tuple, got[["src", "dst"]].to_numpy().tolist())) <= set(pairs)
    assert got.src.is_unique and got.dst.is_unique and len(got) == brute_matching(pairs)
    form = {(r.id, r.side): (r.part, r.block) for r in strong.dulmage_mendelsohn(pairs_frame(spark, pairs), ids_frame(spark, 52), ids_frame(spark, 47)).collect()}
    assert len(form) == 99 and form[51, "column"] == ("wide", None) and form[46, "row"] == ("tall", None)
    rank = {"wide": 0, "square": 1, "tall": 2}
    assert all(rank[form[a, "column"][0]] >= rank[form[b, "row"][0]] for a, b in pairs)
    cover = sum(p == "wide" for (_, side), (p, _) in form.items() if side == "row") + sum(p != "wide" for (_, side), (p, _) in form.items() if side == "column")
    assert cover == len(got)  # rows of the wide part and columns of the others touch every edge


def test_long_alternating_ways(spark, monkeypatch):
    """A path whose greedy matching has to be turned around as a whole, in lists of tables that are gathered."""
    monkeypatch.setattr(state, "TABLES", 3)
    pairs = [(k, k) for k in range(12)] + [(k + 1, k) for k in range(12)]
    monkeypatch.setattr(strong, "_greedy", lambda edges: state.written(edges.where("src = dst + 1"), "pairs"))
    got = strong.maximum_matching(pairs_frame(spark, [*pairs, (0, 20)]))
    assert got.count() == 13


# --- least squares, blocks over space, sparse files --------------------------------------------------------------------
def test_tall_factors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    points = spark.createDataFrame(pd.DataFrame({"id": range(500), "x": x.tolist(), "y": (x @ np.arange(6.0) + 0.1 * rng.normal(size=500)).tolist()})).repartition(7)
    r = leastsquares.tall_factor(points)
    assert np.allclose(np.triu(r), r) and (np.diag(r) >= 0).all() and np.abs(r.T @ r - x.T @ x).max() < 1e-9
    y = points.orderBy("id").toPandas().y.to_numpy()
    assert np.abs(leastsquares.fit_dense(points) - np.linalg.lstsq(x, y, rcond=None)[0]).max() < 1e-10
    few = leastsquares.tall_factor(points.where("id < 2"))
    assert few.shape == (6, 6) and np.abs(few.T @ few - x[:2].T @ x[:2]).max() < 1e-12
    assert leastsquares.tall_factor(points.where("id < 0")) is None and len(leastsquares.fit_dense(points.withColumn("y", F.lit(None).cast("double")))) == 0


def test_sparse_least_squares(spark):
    """An overdetermined matrix with a repeated entry; the residual is normal to its columns, and rows that b lacks count as 0."""
    rng = np.random.default_rng(3)
    e = pd.DataFrame({"src": rng.integers(0, 12, 120), "dst": rng.integers(0, 40, 120), "w": rng.normal(size=120)})
    a = np.zeros((40, 12))
    np.add.at(a, (e.dst, e.src), e.w)
    b = np.where(np.arange(40) < 35, rng.normal(size=40), 0)
    got = leastsquares.fit_sparse(spark.createDataFrame(e), spark.createDataFrame(pd.DataFrame({"id": range(35), "x": b[:35]})), 1e-11).toPandas().sort_values("id")
    assert np.abs(got.x.to_numpy() - np.linalg.lstsq(a, b, rcond=None)[0]).max() < 1e-7
    assert leastsquares.fit_sparse(spark.createDataFrame(e).where("src < 0"), spark.createDataFrame([(1, 2.0)], "id long, x double")).count() == 0


def test_blocks_hold_few_points_however_they_crowd(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.random((300, 2)), rng.random((300, 2)) * 1e-4 + 0.5])
    y[:5] = y[5]
    coords = coords_frame(spark, y)
    got = spatial.blocks(coords, 20).toPandas()
    places = got.assign(y0=y[got.id, 0], y1=y[got.id, 1]).drop_duplicates(["y0", "y1"])
    assert len(got) == 600 and places.groupby(["level", "cell", "merged"]).size().max() <= 20
    order = spatial.spatial_order(coords, 20).toPandas().sort_values("position")
    assert order.position.tolist() == list(range(600)) and (order.block != order.block.shift()).sum() == order.block.nunique() == got.groupby(["level", "cell", "merged"]).ngroups
    assert spatial.blocks(coords.limit(0), 20).count() == 0


@pytest.mark.parametrize("compressed", [False, True])
def test_sparse_matlab_files(spark, tmp_path, monkeypatch, compressed):
    """Sparse matrices by themselves, in a structure and in a cell in it, read by ranges (or, compressed, whole)."""
    monkeypatch.setattr(matlab, "RECORD", 64)
    rng = np.random.default_rng(6)
    made = {}
    for name, m, n in (("A", 40, 30), ("S.first", 5, 7), ("S.second{1}", 90, 60)):
        e = np.array(sorted({(int(c), int(r)) for c, r in zip(rng.integers(0, n, 150), rng.integers(0, m, 150), strict=True)}))
        made[name] = ((m, n), e[:, 0], e[:, 1], rng.normal(size=len(e)))
    inner = {"first": matlab.sparse_element("", *made["S.first"]), "second": matlab.container_element("", [matlab.sparse_element("", *made["S.second{1}"])])}
    whole = matlab.mat_of([files.mat_file({"full": np.eye(3)}, False)[128:], matlab.sparse_element("A", *made["A"]), matlab.container_element("S", inner)], compressed)
    (tmp_path / "x.mat").write_bytes(whole)
    for name, (_, columns, rows, values) in made.items():
        got = sorted(map(tuple, matlab.read_mat_sparse(spark, str(tmp_path / "x.mat"), name).collect()))
        assert got == sorted(zip(columns.tolist(), rows.tolist(), values.tolist(), strict=True))
    if not compressed:
        with pytest.raises(ValueError, match="no sparse matrix B"):
            matlab.read_mat_sparse(spark, str(tmp_path / "x.mat"), "B")


@pytest.mark.parametrize("name", ["repulse_tree_1d", "repulse_tree_exact", "strong_components", "maximum_matching", "dulmage_mendelsohn", "elimination_tree", "column_counts", "dissection_facts", "cholesky_solve", "spatial_blocks", "tall_factor", "file_mat_sparse"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(__spark_entry__.oracle_sql()[name]).df(), __spark_entry__.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c].astype(str) == b[c].astype(str)).all() if a[c].dtype == object else np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=2e-5)
