"""Exact repulsion by nodes: the digits of all pairs at a cost that grows with the points, and once for a gradient and its cost."""

import numpy as np
import pandas as pd
import pytest

from filigree.operators import forces, nodes
from filigree.plans import queries


@pytest.mark.parametrize(("d", "n"), [(1, 3000), (2, 12_000)])
def test_repulsion_by_nodes(spark, d, n):
    y = np.random.default_rng(d).uniform(-1, 0.99, (n, d)) + 40
    y[1] = y[0]  # two at one place
    coords = spark.createDataFrame(pd.DataFrame({"id": np.arange(n)} | {f"y{k}": y[:, k] for k in range(d)}))
    assert nodes.boxes_of(coords, d) is not None
    got, want = (x.toPandas().sort_values("id") for x in (forces.repulse(coords), forces.repulse_exact(coords)))
    assert len(got) == len(want) == n
    assert abs(got.zeta.iloc[0] / want.zeta.iloc[0] - 1) < 1e-13
    for k in range(d):
        assert np.abs(got[f"f{k}"].to_numpy() - want[f"f{k}"].to_numpy()).max() < 1e-13 * np.abs(want[f"f{k}"]).max() * n**0.5


def test_boxes(spark):
    """Few points, wide extents and unknown places go by all pairs."""
    few = spark.range(60).selectExpr("id", "id * 0.01 AS y0")
    wide = spark.range(20_000).selectExpr("id", "id * 1.0 AS y0")
    lost = spark.range(20_000).selectExpr("id", "IF(id = 7, NULL, id / 20000) AS y0")
    assert nodes.boxes_of(few, 1) is None and nodes.boxes_of(wide, 1) is None and nodes.boxes_of(lost, 1) is None
    assert nodes.boxes_of(few.limit(0), 1) is None


def test_service_repulses_once(spark, monkeypatch):
    calls, real = [], forces.repulse
    monkeypatch.setattr(forces, "repulse", lambda *a: calls.append(1) or real(*a))
    assert queries.QUERIES["gradient_service"](spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1


def test_service_in_tiles(spark, monkeypatch):
    """Gradients and costs of a graph without its edges' joins, for coordinates given before or after; edges that end at no vertex
    take the joins."""
    from filigree import api
    from filigree.operators import graph
    from filigree.params import Params

    edges = graph.random_graph(spark, 300, 5).where("src <> dst")
    one = graph.random_coordinates(spark.range(310), 2, 1)
    two = graph.random_coordinates(spark.range(310), 2, 2)
    service, plain = api.GradientService.of(edges, one), api.GradientService(api.joint(edges, Params()))
    for coords in (one, two):
        got, want = (s.gradient(coords, 12.0, 2.0).toPandas().sort_values("id") for s in (service, plain))
        assert len(got) == len(want) == 310
        assert np.abs(got[["d0", "d1", "zeta"]].to_numpy() / want[["d0", "d1", "zeta"]].to_numpy() - 1).max() < 1e-8
        assert abs(service.kl(coords, 3.0) - plain.kl(coords, 3.0)) < 1e-10
    monkeypatch.setattr(forces, "attract", None)  # the tiles do without
    assert service.gradient(one).count() == 310
    monkeypatch.undo()
    with pytest.raises(Exception, match="other vertices"):
        service.gradient(two.where("id <> 3")).count()
    service.close()
    few = one.where("id < 290")
    service = api.GradientService.of(edges, few)
    assert service.held is None
    assert abs(service.kl(few) - plain.kl(few)) < 1e-12
    service.close()
    plain.close()
    none = api.GradientService.of(edges.limit(0), one)
    assert none.kl(one) is None and none.gradient(one).count() == 310
