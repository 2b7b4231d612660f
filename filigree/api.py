"""Whole embeddings, and the gradient as a service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import descent, forces, graph, neighbors, tiles
from filigree.operators.state import discard, written
from filigree.params import Params, check_points, check_start


def stochastic(edges: DataFrame, params: Params) -> DataFrame:
    """The edges, repeated ones summed, as a column-stochastic matrix."""
    return graph.make_stochastic(graph.dedup_sum(edges.where("src <> dst") if params.drop_self_loops else edges))


def joint(edges: DataFrame, params: Params) -> DataFrame:
    """The symmetric joint distribution of a weighted digraph."""
    return _joint(stochastic(edges, params), params)


def _joint(rows: DataFrame, params: Params) -> DataFrame:
    return graph.normalize_joint(graph.symmetrize(graph.rescale(rows, params.lam, drop_leaf=params.drop_leaf)))


def embed_graph(edges: DataFrame, params: Params = Params(), vertices: DataFrame | None = None, y0: DataFrame | None = None, on_iteration: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """id, coordinates and cost of every vertex; isolated ones need the vertices table. y0 is joined by id and must hold
    every vertex. Graphs of a bounded size descend in one worker by the grid, larger ones by tiles of edges, and all with another
    repulsion, or with on_iteration, which gets the number and the state of each step, as DataFrames."""
    if on_iteration is not None or params.repulsion != "grid":
        return _by_tables(edges, params, vertices, y0, on_iteration)
    alone = params.lam == 1
    rows = edges.where("src <> dst") if params.drop_self_loops else edges
    packs = tiles.packed(rows if alone else graph.rescale_rows(rows, params.lam, params.drop_leaf), fold=not alone)
    coords = _start(tiles.ends(packs).select("id") if vertices is None else vertices.select("id").distinct(), params, y0)
    descent.checked_start(coords)
    if descent.fits_counts(coords.count(), 2 * tiles.pairs(packs)):
        rows = tiles.unpacked(packs)
        p = graph.normalize_joint(graph.symmetrize(stochastic(rows, params) if alone else rows)).persist()
        descent.checked_ends(p, coords)
        out = written(descent.fused(p, coords, params), "embedding")
        p.unpersist()
    else:
        out = tiles.descend(packs, coords, params, alone)
    discard(packs)
    return out


def _start(ids: DataFrame, params: Params, y0: DataFrame | None) -> DataFrame:
    return descent.start(ids, params) if y0 is None else ids.join(check_start(y0, params), "id", "left")


def _by_tables(edges: DataFrame, params: Params, vertices: DataFrame | None, y0: DataFrame | None, on_iteration: Callable[[int, DataFrame], None] | None) -> DataFrame:
    rows = stochastic(edges, params).persist()  # the rescaling reads them several times
    p = _joint(rows, params).persist()
    coords = _start(p.select(F.col("src").alias("id")).distinct() if vertices is None else vertices.select("id").distinct(), params, y0)
    descent.checked(p, coords)
    rows.unpersist()
    last = descent.descend(p, coords, params, on_iteration=on_iteration)
    out = written(descent.with_cost(p, last, params), "embedding")
    discard(last)
    p.unpersist()
    return out


def embed_points(points: DataFrame, perplexity: float | None = None, params: Params = Params(), y0: DataFrame | None = None, exact: bool | None = None, metric: neighbors.Metric = "sqeuclidean", components: int = 0, scaled: bool = False, on_iteration: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """The same for feature vectors, by their nearest neighbours at a perplexity: exact ones up to EXACT_POINTS points,
    unless exact says otherwise. Columns can be scaled, and reduced to principal components, before."""
    points = neighbors.clean(points).persist()
    u = check_points(points.count(), (points.select(F.size("x")).first() or [0])[0], perplexity, components, params.dims)
    exact = points.count() <= EXACT_POINTS if exact is None else exact
    rows = neighbors.standardize(points) if scaled else points
    if components:
        rows = neighbors.pca(rows, components, centre=scaled)
    knn = (neighbors.knn_exact if exact else neighbors.knn_approximate)(rows, neighbors.neighbour_count(u), metric)
    if metric != "sqeuclidean":
        knn = knn.withColumn("d", F.col("d") * F.col("d"))
    out = embed_graph(neighbors.perplexity_edges(knn, u), params.with_(lam=1.0), points.select("id"), y0, on_iteration)
    points.unpersist()
    return out


#: Points whose neighbours embed_points() finds by all pairs.
EXACT_POINTS = 50_000


class GradientService:
    """Holds a joint distribution, and answers with gradients and costs of coordinates."""

    def __init__(self, joint_edges: DataFrame | None, step: float | None = None, theta: float | None = None, held: tiles.Joint | None = None):
        self.edges, self.step, self.theta, self.held = joint_edges.cache() if joint_edges is not None else None, step, theta, held

    @classmethod
    def of(cls, edges: DataFrame, coords: DataFrame, step: float | None = None, theta: float | None = None) -> GradientService:
        """That of the joint distribution of weighted edges, repeated ones summed, for coordinates of the vertices that coords has: held
        in tiles, where all edges end at these."""
        held = tiles.Joint(edges, coords)
        return cls(joint(edges, Params()), step, theta) if held.lost else cls(None, step, theta, held)

    def gradient(self, coords: DataFrame, alpha: float = 1.0, scale: float = 1.0) -> DataFrame:
        pull = forces.attract(self.edges, coords) if self.held is None else self.held.pull(coords)
        return forces.gradient_of(pull, coords, alpha, self.step, scale, self.theta)

    def kl(self, coords: DataFrame, alpha: float = 1.0, stale_zeta: float | None = None) -> float | None:
        if self.held is None:
            return forces.kl_cost(self.edges, coords, alpha, stale_zeta, self.step, self.theta).first().cost
        if stale_zeta is None:
            push = forces.repulse(coords, self.step, self.theta)
            stale_zeta = push.agg(F.max("zeta")).first()[0]
            discard(push)
        return None if stale_zeta is None else self.held.cost(coords, stale_zeta, alpha)

    def close(self) -> None:
        if self.held is None:
            self.edges.unpersist()
        else:
            self.held.close()
