"""The optimiser: single steps as DataFrames, and the whole descent in numpy for graphs that fit one worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import forces
from filigree.operators.graph import uniform
from filigree.operators.state import discard, written
from filigree.params import Params

#: Vertices and edges that the fused descent takes in one worker.
FUSED_POINTS, FUSED_EDGES = 50_000, 500_000


def start(vertices: DataFrame, params: Params, seed: int = 0) -> DataFrame:
    """Normal coordinates times 1e-4, by id: from two uniform numbers each, in polar form."""
    u = lambda k: uniform(seed, F.col("id"), F.lit(k))
    return vertices.select("id", *[(1e-4 * F.sqrt(-2 * F.ln(1 - u(2 * k))) * F.cos(2 * np.pi * u(2 * k + 1))).alias(f"y{k}") for k in range(params.dims)])


def with_state(coords: DataFrame) -> DataFrame:
    """coords with velocity 0 and gain 1."""
    d = forces.dims(coords)
    return coords.select("id", *[f"y{k}" for k in range(d)], *[F.lit(0.0).alias(f"u{k}") for k in range(d)], *[F.lit(1.0).alias(f"g{k}") for k in range(d)])


def update(state: DataFrame, grad: DataFrame, momentum: float, params: Params) -> DataFrame:
    """One step: gains up where gradient and velocity differ in sign, else down; then velocity, position and mean."""
    d = forces.dims(state)
    out = state.join(grad.drop("zeta"), "id")
    for k in range(d):
        g = F.greatest(F.when(F.signum(f"d{k}") != F.signum(f"u{k}"), F.col(f"g{k}") + params.gain_up).otherwise(F.col(f"g{k}") * params.gain_down), F.lit(params.gain_floor))
        out = out.withColumn(f"g{k}", g).withColumn(f"u{k}", momentum * F.col(f"u{k}") - params.rate * F.col(f"g{k}") * F.col(f"d{k}")).withColumn(f"y{k}", F.col(f"y{k}") + F.col(f"u{k}"))
    out = out.select(*state.columns)
    if params.recenter:
        means = out.agg(*[F.avg(f"y{k}").alias(f"m{k}") for k in range(d)])
        out = out.join(F.broadcast(means)).select("id", *[(F.col(f"y{k}") - F.col(f"m{k}")).alias(f"y{k}") for k in range(d)], *state.columns[1 + d :])  # one row
    return out


def schedule(i: int, params: Params) -> tuple[float, float]:
    """alpha and momentum of iteration i; both switch after their iteration."""
    return params.alpha if i <= params.early_iter else 1.0, params.momentum[0 if i <= params.momentum_switch else 1]


def descend(edges: DataFrame, coords: DataFrame, params: Params, exact: bool = False, on_iteration: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """params.max_iter steps over DataFrames, for graphs of any size; forces are as params.repulsion says, or, exact, by all
    pairs. Every step's state is written, and the one before it deleted, so the disk holds two. It ends early where no gradient's absolute sum reaches params.tolerance, if there is one."""
    held = edges.is_cached  # by the caller, who releases it
    edges = edges if held else edges.persist()
    exact = exact or params.repulsion == "exact"
    state = written(with_state(coords), "state")
    for i in range(params.max_iter):
        alpha, momentum = schedule(i, params)
        own = state.select("id", *[f"y{k}" for k in range(params.dims)])
        made = forces.gradient(edges, own, alpha, None if exact else params.grid_step, theta=None if exact else params.opening)
        grad = written(made, "gradient")
        discard(made)
        if params.tolerance:
            most = grad.agg(F.max(sum((F.abs(f"d{k}") for k in range(params.dims)), F.lit(0.0))).alias("most")).first().most
        before, state = state, written(update(state, grad, momentum, params), "state")
        discard(before, grad)
        if on_iteration:
            on_iteration(i, state)
        if params.tolerance and (most is None or most < params.tolerance):
            break
    if not held:
        edges.unpersist()
    out = written(state.select("id", *[f"y{k}" for k in range(params.dims)]), "coordinates")
    discard(state)
    return out


def with_cost(edges: DataFrame, coords: DataFrame, params: Params, exact: bool = False) -> DataFrame:
    """coords with the cost on every row."""
    exact = exact or params.repulsion == "exact"
    cost = forces.kl_cost(edges, coords, step=None if exact else params.grid_step, theta=None if exact else params.opening)
    return coords.join(F.broadcast(cost))  # one row


def checked(edges: DataFrame, coords: DataFrame) -> None:
    """ValueError where an edge ends at no vertex, or a vertex has no or no finite coordinates."""
    checked_ends(edges, coords)
    checked_start(coords)


def checked_ends(edges: DataFrame, coords: DataFrame) -> None:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lost = ends.join(coords, "id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"edges end at {', '.join(str(r.id) for r in lost)}, which the vertices lack")


def checked_start(coords: DataFrame) -> None:
    bad = coords.where(~F.coalesce(sum((F.abs(f"y{k}") for k in range(forces.dims(coords))), F.lit(0.0)) < float("inf"), F.lit(False))).limit(3).collect()
    if bad:
        raise ValueError(f"no coordinates for {', '.join(str(r.id) for r in bad)}")


def repulsion(y: np.ndarray, step: float) -> tuple[np.ndarray, float]:
    """Gridded forces times zeta, and zeta, of an array of points."""
    n, d = y.shape
    z = y - y.min(0)
    extent = z.max() or 1.0
    size = forces.smooth_size(max(int(np.ceil(extent / step)), 14))
    eps = np.finfo(float).eps
    scaled = z / extent
    scaled = np.where(scaled >= 1, scaled - eps, scaled) * (size - 1)
    cell = np.floor(scaled).astype(np.int64)
    w = np.stack(forces.weights(scaled - cell), 2)
    total = np.ones((n, 1))
    place = np.zeros((n, 1), np.int64)
    for k in range(d):
        total = (total[:, :, None] * w[:, k, None, :]).reshape(n, -1)
        place = (place[:, :, None] * (size + 2) + cell[:, k, None, None] + np.arange(4)[None, None, :]).reshape(n, -1)
    charges = np.concatenate([np.ones((n, 1)), z], 1)
    grid = np.stack([np.bincount(place.ravel(), (total * charges[:, m, None]).ravel(), (size + 2) ** d) for m in range(d + 1)])
    phi = forces.convolve_fft(grid.reshape(d + 1, *[size + 2] * d), extent / (size - 1 - eps)).reshape(d + 1, -1)
    got = (phi[:, place] * total[None]).sum(2).T
    zeta = float(((1 + 2 * (z * z).sum(1)) * got[:, 0] - 2 * (z * got[:, 1:]).sum(1)).sum() - n)
    return z * got[:, :1] - got[:, 1:], zeta


def fits(edges: DataFrame, coords: DataFrame) -> bool:
    """Whether the graph is small enough for fused()."""
    return fits_counts(coords.count(), edges.count())


def fits_counts(points: int, edges: int) -> bool:
    return points <= FUSED_POINTS and edges <= FUSED_EDGES


def fused(edges: DataFrame, coords: DataFrame, params: Params) -> DataFrame:
    """The whole gridded descent of a bounded graph in one worker: id, coordinates, and cost (KL) on every row."""
    if not fits(edges, coords):
        raise ValueError(f"more than {FUSED_POINTS} vertices or {FUSED_EDGES} edges; use descend()")
    d = params.dims
    rows = edges.select(F.lit(1).alias("kind"), "src", "dst", "w", *[F.lit(0.0).alias(f"y{k}") for k in range(d)]).unionByName(coords.select(F.lit(0).alias("kind"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("w"), *[f"y{k}" for k in range(d)]))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        points = t[t.kind == 0].sort_values("src")
        ids, y = points.src.to_numpy(), points[[f"y{k}" for k in range(d)]].to_numpy()
        e = t[t.kind == 1]
        i, j, p = np.searchsorted(ids, e.src), np.searchsorted(ids, e.dst), e.w.to_numpy()
        u, gain, zeta = np.zeros_like(y), np.ones_like(y), 1.0
        for it in range(params.max_iter):
            alpha, momentum = schedule(it, params)
            diff = y[i] - y[j]
            q = alpha * p / (1 + (diff * diff).sum(1))
            pull = np.stack([np.bincount(i, q * diff[:, k], len(ids)) for k in range(d)], 1)
            push, zeta = repulsion(y, params.grid_step)
            dy = pull - push / zeta
            gain = np.maximum(np.where(np.sign(dy) != np.sign(u), gain + params.gain_up, gain * params.gain_down), params.gain_floor)
            u = momentum * u - params.rate * gain * dy
            y = y + u
            if params.recenter:
                y = y - y.mean(0)
            if params.tolerance and np.abs(dy).sum(1).max() < params.tolerance:
                break
        _, zeta = repulsion(y, params.grid_step)
        diff = y[i] - y[j]
        cost = float((p * np.log((p + forces.FLT_MIN) / (1 / (1 + (diff * diff).sum(1)) / zeta + forces.FLT_MIN))).sum())
        return pd.DataFrame({"id": ids} | {f"y{k}": y[:, k] for k in range(d)} | {"cost": cost})

    return rows.repartition(1).mapInPandas(lambda parts: iter([run(pd.concat(list(parts)))]), "id long, " + ", ".join(f"y{k} double" for k in range(d)) + ", cost double")
