"""All-pairs steps against brute force, over several blocks and tiles, with equal points and ties."""

import numpy as np
import pytest

from dendrospark.operators import cluster


@pytest.fixture(params=[(2, 0.0), (16, 0.0), (16, 1e4)])
def cloud(request, spark, monkeypatch):
    dim, offset = request.param
    monkeypatch.setattr(cluster, "TILE", 16)
    monkeypatch.setattr(cluster, "SIDE", 60)
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(c, 0.5, (60, dim)) for c in (0, 3, 6)]) + offset
    x[30:40] = x[20]  # equal points
    x[70:100] = np.round(x[70:100])
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(1000)[: len(x)]
    label = np.arange(len(x)) % 3
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label, strict=True)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return spark.createDataFrame(rows, "cell_id long, coords array<double>, label int"), ids, x, d


def test_all_pairs(cloud, spark, monkeypatch):
    points, ids, x, d = cloud
    n, other = len(ids), ~np.eye(len(ids), dtype=bool)
    dc = float(np.quantile(d[other], 0.1))
    got = {r.cell_id: r.rho for r in cluster.local_density(points, dc).collect()}
    rho = np.where(other, np.exp(-((d / dc) ** 2)), 0).sum(axis=1)
    assert np.allclose([got[i] for i in ids], rho, rtol=1e-9)
    cutoff = float(d[5, 3])  # a distance itself: not nearer than it
    got = {r.cell_id: r.rho for r in cluster.local_density(points, cutoff, False).collect()}
    counts = ((d < cutoff) & other).sum(axis=1)
    assert [got[i] for i in ids] == counts.tolist()
    # few values of rho, so that many points share one and several have the largest
    rank = (counts // 8).astype(float)
    known = points.join(spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, rank, strict=True)], "cell_id long, rho double"), "cell_id")
    got = {r.cell_id: (r.delta, r.nearest, r.has_denser) for r in cluster.nearest_denser(known).collect()}
    for k, i in enumerate(ids):
        up = np.flatnonzero(rank > rank[k])
        if len(up):
            want = min((d[k, j], ids[j]) for j in up)
        else:
            want = min((-d[k, j], ids[j]) for j in range(n) if j != k)
        assert got[i] == (abs(want[0]), want[1], bool(len(up)))
    sums = {r.label: (r.n, r.total) for r in cluster.distance_sums(points).collect()}
    for k in range(3):
        assert sums[k][0] == 60 * (n - 1) and abs(sums[k][1] - d[np.arange(n) % 3 == k].sum()) < 1e-9 * sums[k][1]
    group = np.where(np.arange(n) % 7 == 0, -1, np.arange(n) // 60 % 2)
    named = known.join(spark.createDataFrame([(int(i), int(v)) for i, v in zip(ids, group, strict=True)], "cell_id long, cluster int"), "cell_id")
    reach = float(d[0, 61])
    got = {r.cell_id: r.halo for r in cluster.halo(named, reach).collect()}
    cross = (d <= reach) & (group[:, None] != group[None]) & (group[:, None] != -1) & (group[None] != -1)
    border = {g: np.max(np.where(cross, (rank[:, None] + rank[None]) / 2, -np.inf)[group == g], initial=-np.inf) for g in (0, 1)}
    border = {g: v if np.isfinite(v) else 0.0 for g, v in border.items()}
    assert all(got[i] == (group[k] != -1 and rank[k] < border[int(group[k])]) for k, i in enumerate(ids))
    got = {r.cell_id: r.cluster for r in cluster.adopt(named).collect()}
    for k, i in enumerate(ids):
        assert got[i] == (group[k] if group[k] != -1 else group[min((d[k, j], ids[j], j) for j in np.flatnonzero(group != -1))[2]])


@pytest.mark.parametrize("levels", [2, 10])
def test_dc_is_the_bisections_and_takes_few_passes(cloud, monkeypatch, levels):
    points, ids, x, d = cloud
    n = len(ids)
    pairs = d[np.triu_indices(n, 1)]
    passes = []
    run = cluster._over_pairs
    monkeypatch.setattr(cluster, "_over_pairs", lambda *a: passes.append(1) or run(*a))
    low, high, steps = pairs.min(), pairs.max(), 0
    while True:
        steps += 1
        dc = (low + high) / 2
        rate = ((((pairs < dc).sum() * 2 + n) / n) - 1) / n
        if 0.03 <= rate <= 0.03 + 1e-3:
            break
        low, high = (dc, high) if rate < 0.03 else (low, dc)
        if steps == 60:
            pytest.skip("these points have no such cutoff")
    assert cluster.estimate_dc(points, 0.03, 0.031, levels=levels) == dc
    assert len(passes) == 1 + -(-steps // levels)
