"""Root finding inside column expressions: a state folded over a sequence of steps by a higher-order function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def perplexity_beta_normalised(d2: Column, perplexity: float) -> Column:
    """The vector front end's search: the entropy is taken of the normalised weights, a hundred steps at most, and the last
    precision counts, evaluated or not."""
    return perplexity_beta(d2, perplexity, steps=100, result="b")


def _higher(st: Column) -> Column:
    """The precision to try after one, b, whose entropy is too large, in a bracket lo, hi."""
    return F.when(st["hi"].isNull(), st["b"] * 2).otherwise((st["b"] + st["hi"]) / 2)


def _lower(st: Column) -> Column:
    return F.when(st["lo"].isNull(), st["b"] / 2).otherwise((st["b"] + st["lo"]) / 2)


#: The least normal double, which guards sums against 0.
_TINY = 2.2250738585072014e-308


def perplexity_candidates(b: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int) -> np.ndarray:
    """The precisions that so many steps from b, in a bracket (nan: none), can try: after number k come 2 k + 1, higher, and 2 k + 2."""
    tree = [(b, lo, hi)]
    for k in range(2 ** (steps - 1) - 1):
        b, lo, hi = tree[k]
        tree += [(np.where(np.isnan(hi), b * 2, (b + hi) / 2), b, hi), (np.where(np.isnan(lo), b / 2, (b + lo) / 2), lo, b)]
    return np.stack([b for b, _, _ in tree], 1)


def perplexity_advance(st: Column, s: Column, t: Column, perplexity: float, steps: int, tolerance: float = 1e-5) -> Column:
    """The state after so many steps of perplexity_beta(), from the sums s of exp(-b * d2) and t of d2 * exp(-b * d2) for
    each of perplexity_candidates(). A state that is done has the s of its b."""
    target = F.ln(F.lit(float(perplexity)))

    def step(st: Column, _: Column) -> Column:
        def moved(own: Column) -> Column:
            diff = st["b"] * own["t"] / (own["s"] + _TINY) + F.ln(own["s"] + _TINY) - target
            state = lambda b, lo, hi, done, at: F.struct(b.alias("b"), lo.alias("lo"), hi.alias("hi"), own["s"].alias("s"), F.lit(done).alias("done"), at.cast("int").alias("at"))
            up, down = state(_higher(st), st["b"], st["hi"], False, 2 * st["at"] + 1), state(_lower(st), st["lo"], st["b"], False, 2 * st["at"] + 2)
            return F.when(F.abs(diff) < tolerance, state(st["b"], st["lo"], st["hi"], True, st["at"])).when(diff > 0, up).otherwise(down)

        return F.when(st["done"], st).otherwise(_let(F.struct(F.get(s, st["at"]).alias("s"), F.get(t, st["at"]).alias("t")), moved))

    start = F.struct(*[st[c].alias(c) for c in ("b", "lo", "hi", "s", "done")], F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda v: F.struct(*[v[c].alias(c) for c in ("b", "lo", "hi", "s", "done")]))


def perplexity_beta(d2: Column, perplexity: float, steps: int = 200, tolerance: float = 1e-5, result: str = "used") -> Column:
    """The precision at which exp(-beta * d2), normalised, has the entropy ln(perplexity): bracket from 1 by doubling or
    halving, then bisection. The result is the last precision whose entropy was evaluated."""
    target = F.ln(F.lit(float(perplexity)))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(1.0).alias("b"), none.alias("lo"), none.alias("hi"), F.lit(1.0).alias("used"), F.lit(False).alias("done"))

    def entropy(b: Column) -> Column:
        sums = F.struct(_total(d2, lambda x: F.exp(-b * x)).alias("s"), _total(d2, lambda x: x * F.exp(-b * x)).alias("t"))
        return _let(sums, lambda v: b * v["t"] / (v["s"] + _TINY) + F.ln(v["s"] + _TINY))

    def step(st: Column, _: Column) -> Column:
        def moved(diff: Column) -> Column:
            up = F.struct(_higher(st).alias("b"), st["b"].alias("lo"), st["hi"].alias("hi"), st["b"].alias("used"), F.lit(False).alias("done"))
            down = F.struct(_lower(st).alias("b"), st["lo"].alias("lo"), st["b"].alias("hi"), st["b"].alias("used"), F.lit(False).alias("done"))
            end = F.struct(st["b"].alias("b"), st["lo"].alias("lo"), st["hi"].alias("hi"), st["b"].alias("used"), F.lit(True).alias("done"))
            return F.when(F.abs(diff) < tolerance, end).when(diff > 0, up).otherwise(down)

        return F.when(st["done"], st).otherwise(_let(entropy(st["b"]) - target, moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda st: st[result])


def rescaling_exponent(delta: Column, lam: float, steps: int = 100, tolerance: float = 1e-5) -> Column:
    """g with sum(exp(-g * delta)) = lam by bisection from 1 between -1000 and no bound."""
    start = F.struct(F.lit(1.0).alias("g"), F.lit(-1000.0).alias("lo"), F.lit(None).cast("double").alias("hi"), (_total(delta, lambda x: F.exp(-x)) - lam).alias("f"))

    def step(st: Column, _: Column) -> Column:
        def moved(v: Column) -> Column:
            return F.struct(v["g"].alias("g"), v["lo"].alias("lo"), v["hi"].alias("hi"), (_total(delta, lambda x: F.exp(-v["g"] * x)) - lam).alias("f"))

        g, lo, hi = st["g"], st["lo"], st["hi"]
        more = F.struct(F.when(hi.isNull(), g * 2).otherwise((g + hi) / 2).alias("g"), g.alias("lo"), hi.alias("hi"))
        less = F.struct(((lo + g) / 2).alias("g"), lo.alias("lo"), g.alias("hi"))
        return F.when(F.abs(st["f"]) <= tolerance, st).otherwise(_let(F.when(st["f"] > 0, more).otherwise(less), moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda st: st["g"])


def rescaling_exponents(delta: np.ndarray, of: np.ndarray, n: int, lam: float, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """rescaling_exponent() of n sources at once: delta, each with the number of its source."""
    g, lo, hi = np.ones(n), np.full(n, -1000.0), np.full(n, np.nan)
    own, number, rows, d = np.arange(n), of, of, delta  # sources that go on, and their deltas
    with np.errstate(over="ignore"):
        for k in range(steps + 1):
            f = np.bincount(rows, np.exp(-g[number] * d), len(own)) - lam
            on = ~(np.abs(f) <= tolerance)
            if k == steps or not on.any():
                return g
            place = np.cumsum(on) - 1
            keep = on[rows]
            own, f = own[on], f[on]
            number, rows, d = number[keep], place[rows[keep]], d[keep]
            more, at = f > 0, g[own]
            lo[own], hi[own] = np.where(more, at, lo[own]), np.where(more, hi[own], at)
            g[own] = np.where(more, np.where(np.isnan(hi[own]), at * 2, (at + hi[own]) / 2), (lo[own] + at) / 2)
    return g
