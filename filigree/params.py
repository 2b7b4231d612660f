"""Parameters of an embedding, with the defaults that hold where nothing is given."""

from __future__ import annotations

from dataclasses import dataclass, replace

DEFAULT_STEP = {1: 0.5, 2: 0.7, 3: 1.2}


@dataclass(frozen=True)
class Params:
    """dims 1 to 3; lam rescales degrees (1: not at all); alpha is the early exaggeration of iterations 0 to early_iter;
    repulsion is by the grid, by a tree with the opening angle theta, or exact (by all pairs)."""

    dims: int = 2
    lam: float = 1.0
    alpha: float = 12.0
    max_iter: int = 1000
    early_iter: int = 250
    step: float | None = None
    drop_leaf: bool = False
    drop_self_loops: bool = False
    rate: float = 200.0
    momentum: tuple[float, float] = (0.5, 0.8)
    momentum_switch: int = 250
    gain_up: float = 0.2
    gain_down: float = 0.8
    gain_floor: float = 0.01
    recenter: bool = True
    tolerance: float | None = None
    theta: float = 0.5
    repulsion: str = "grid"

    def __post_init__(self) -> None:
        if self.dims not in DEFAULT_STEP:
            raise ValueError("dims must be 1, 2 or 3")
        if self.lam <= 0 or self.alpha < 1 or self.rate <= 0 or self.max_iter < 0:
            raise ValueError("lam and rate must be positive, alpha at least 1, max_iter at least 0")
        if not 0 <= self.theta <= 1:
            raise ValueError("theta must lie between 0 and 1")
        if self.repulsion not in ("grid", "tree", "exact"):
            raise ValueError("repulsion must be grid, tree or exact")

    @property
    def grid_step(self) -> float:
        return self.step if self.step and self.step > 0 else DEFAULT_STEP[self.dims]

    @property
    def opening(self) -> float | None:
        """theta where the repulsion is by the tree."""
        return self.theta if self.repulsion == "tree" else None

    def with_(self, **changes) -> Params:
        """A copy; a change to None keeps the default."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


#: The schedule of the feature-vector front end.
CUSTOM = Params(alpha=4.0, rate=500.0, gain_up=0.15, gain_down=0.85, momentum_switch=250, recenter=False, tolerance=1e-10)


def check_start(y0, params: Params):
    """y0 with its id and coordinates, or ValueError where it has not as many as the embedding has dimensions."""
    own = [c for c in ("y0", "y1", "y2") if c in y0.columns]
    if len(own) != params.dims or "id" not in y0.columns:
        raise ValueError(f"the start needs id and {params.dims} coordinates")
    return y0.select("id", *own)


def check_points(n: int, n_features: int, perplexity: float | None, pca: int = 0, dims: int = 2) -> float:
    """The perplexity to use for n points, or ValueError."""
    u = min((n + 1) // 2, 30) if perplexity is None else perplexity
    if not 0 < u <= n:
        raise ValueError("perplexity must be positive and at most the number of points")
    if pca and not dims <= pca <= n_features:
        raise ValueError("the number of components must lie between dims and the number of features")
    return u
