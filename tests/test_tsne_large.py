"""t-SNE of many points: neighbours, forces and the whole number of iterations."""

import inspect

import numpy as np

from dendrospark.operators import cluster, preprocess, reduce, trajectory
from dendrospark.plans import catalogue
from dendrospark.sources import from_matrix


def test_neighbours_and_forces(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 16)
    monkeypatch.setattr(cluster, "SIDE", 60)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    got = cluster.neighbours(spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)], "cell_id string, coords array<double>"), 15)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for r in got.collect():
        i = int(r.cell_id[1:])
        assert [int(v[1:]) for v in r.ids] == np.argsort(d[i])[:15].tolist() and np.allclose(r.squares, np.sort(d[i])[:15])
    for scale, error in ((1e-4, 1e-9), (3.0, 1e-3), (10.0, 1e-2), (40.0, 5e-2)):
        y = rng.normal(size=(400, 2)) * scale
        gap = y[:, None] - y[None]
        q = 1 / (1 + (gap**2).sum(axis=2)) - np.eye(400)
        force, total = reduce.repulsion(y)
        want = ((q**2)[:, :, None] * gap).sum(axis=1)
        assert abs(total / q.sum() - 1) < error and np.linalg.norm(force - want) < error * np.linalg.norm(want)
    near, p = rng.integers(0, 400, (400, 7)), rng.random((400, 7))
    want = np.zeros((400, 2))
    for i in range(400):
        for j, v in zip(near[i], p[i], strict=True):
            f = v * (q[i, j] if i != j else 1) * (y[i] - y[j]) / 800
            want[i] += f
            want[j] -= f
    assert np.allclose(reduce.attraction(y, near, p, rows=64), want)


def test_tsne_of_many_cells_and_the_whole_query(spark, monkeypatch):
    rng = np.random.default_rng(1)
    group = np.arange(240) % 3
    x = rng.poisson(np.exp(1 + rng.normal(0, 1, (3, 20)))[group]).astype(float)
    cds = preprocess.with_dispersion(preprocess.estimate_size_factors(from_matrix(spark, x, )), 0.05, 1.0)
    cds = cds.with_(cells=cds.cells.cache(), expr=cds.expr.cache())
    monkeypatch.setattr(reduce, "EXACT_TSNE", 100)
    got = trajectory.reduce_dimension(cds, reduction_method="tSNE", iterations=300).state("X_dr").toPandas()
    y = np.array(got.coords.tolist())
    own = group[[int(c[1:]) for c in got.cell_id]]
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert (own[d.argmin(axis=1)] == own).mean() > 0.95
    # the query runs the operator's own number of dimensions and iterations
    seen = {}
    monkeypatch.setattr(catalogue.trajectory, "reduce_dimension", lambda cds, **more: seen.update(more) or cds.with_(meta={"X_dr": None}))
    monkeypatch.setattr(catalogue, "sized", lambda s, d: cds)
    catalogue.QUERIES["reduce_tsne"](spark, "")
    assert seen == {"reduction_method": "tSNE"}
    assert inspect.signature(reduce.tsne).parameters["iterations"].default == inspect.signature(reduce.tsne_of).parameters["iterations"].default == 1000
