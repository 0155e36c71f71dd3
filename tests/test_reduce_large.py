"""Reductions of many cells give what the driver's kernels give."""

import numpy as np
import pytest

from dendrospark.operators import order, preprocess, reduce, trajectory
from dendrospark.sources import from_matrix


@pytest.mark.parametrize("dim", [2, 3])
def test_tree_of_many_points_is_prims(dim):
    rng = np.random.default_rng(dim)
    p = np.concatenate([rng.normal(c, 0.3, (400, dim)) for c in (0, 2, 9)])
    p = p[rng.integers(0, len(p), 1500)]  # many points are equal
    one, two = reduce._prim(p), reduce._boruvka(p, size=16)
    key = lambda edges: sorted((min(e[:2]), max(e[:2]), round(e[2], 12)) for e in edges)
    assert key(one) == key(two)


def test_trees_have_no_limit_of_20000_points(spark):
    rng = np.random.default_rng(0)
    t = rng.random(20_500)
    got = order.order_cells(spark, list(range(len(t))), np.stack([t, 0 * t], 1), np.array([[0.0, 0.0], [1.0, 0.0]]), [(0, 1, 1.0)], (t > 0.5).astype(int), root=0).toPandas()
    assert len(got) == len(t) and np.corrcoef(got.sort_values("cell_id").Pseudotime, t)[0, 1] > 0.99


def test_ddrtree_of_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t = rng.random((300, 1))
    x = rng.poisson(np.exp(1 + t @ rng.normal(0, 1, (1, 20)) + (t > 0.5) * rng.normal(0, 1, (1, 20)))).astype(float)
    cds = preprocess.with_dispersion(preprocess.estimate_size_factors(from_matrix(spark, x)), 0.05, 1.0)
    cds = cds.with_(cells=cds.cells.cache(), expr=cds.expr.cache())
    held = trajectory.reduce_dimension(cds)
    monkeypatch.setattr(trajectory, "DRIVER_ENTRIES", 0)
    monkeypatch.setattr(reduce, "PACK", 64)
    spread = trajectory.reduce_dimension(cds)
    a, b = held.state("graph"), spread.state("graph")
    assert a.cell_ids == b.cell_ids and (a.closest == b.closest).all() and np.allclose(a.nodes, b.nodes, atol=1e-6)
    assert {e[:2] for e in a.edges} == {e[:2] for e in b.edges}
    assert np.allclose(held.state("ddrtree")["objective"], spread.state("ddrtree")["objective"], rtol=1e-8)
    one, two = (v.state("X_dr").orderBy("cell_id").toPandas().coords.tolist() for v in (held, spread))
    assert np.allclose(one, two, atol=1e-6)
    one, two = (trajectory.order_cells(v).cells.orderBy("cell_id").toPandas() for v in (held, spread))
    assert np.allclose(one.Pseudotime, two.Pseudotime, atol=1e-4) and (one.State == two.State).all()
