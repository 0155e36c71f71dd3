import math

import numpy as np
import pandas as pd
import pytest

from dendrospark.functions.density import density, lowess
from dendrospark.functions.families import family_from_name
from dendrospark.functions.formula import Design, formula_terms, normalize_formula, ns_basis
from dendrospark.functions.glm import chi2_sf, fit_glm, fit_joint_nb, fit_tobit, lrt
from dendrospark.operators.preprocess import cal_ncenter, parametric_dispersion_fit
from dendrospark.operators.reduce import ddrtree, minimum_spanning_tree, tsne, ward_clusters


def test_saturated_glm_is_the_group_mean():
    rng = np.random.default_rng(0)
    g = np.repeat([0, 1, 2], 30)
    y = rng.poisson(5 + 3 * g).astype(float)
    x = np.stack([np.ones(90), g == 1, g == 2], axis=1).astype(float)
    fit = fit_glm(y, x, "nb", 0.4)
    assert np.allclose([fit.predict(x)[g == k][0] for k in range(3)], [y[g == k].mean() for k in range(3)])
    stat, df, p = lrt(fit, fit_glm(y, x[:, :1], "nb", 0.4))
    assert stat > 0 and df == 2 and abs(p - math.exp(-stat / 2)) < 1e-12
    b = (y > 8).astype(float)
    assert np.allclose(fit_glm(b, x, "binomial").predict(x)[g == 2][0], b[g == 2].mean(), atol=1e-6)


def test_joint_nb_and_tobit_beat_their_neighbours():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 2, 200)
    x = np.stack([np.ones(200), t], axis=1)
    mu = np.exp(1 + 0.5 * t)
    y = rng.negative_binomial(2, 2 / (2 + mu)).astype(float)
    joint = fit_joint_nb(y, x)
    assert all(joint.llf >= fit_glm(y, x, "nb", joint.extra * f).llf - 1e-9 for f in (0.8, 1.25)) and 0.2 < joint.extra < 1.2
    z = np.maximum(1 + 0.7 * t + rng.normal(0, 0.4, 200), 1.2)
    fit = fit_tobit(z, x, 1.2)
    assert abs(fit.params[1] - 0.7) < 0.15 and abs(fit.extra - math.log(0.4)) < 0.2


def test_chi2_tail():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(chi2_sf(7.814727903251179, 3) - 0.05) < 1e-10
    assert abs(chi2_sf(9.487729036781154, 4) - 0.05) < 1e-10


def test_natural_spline():
    x = np.linspace(0, 10, 101)
    b = ns_basis(np.append(x, [12.0, 14.0, np.nan]), np.array([3.0, 6.0]), (0.0, 10.0))
    assert b.shape == (104, 3) and np.isnan(b[-1]).all()
    slope = (b[102] - b[101]) / 2
    assert np.allclose(b[101] - b[100], slope * 2) and np.linalg.matrix_rank(b[:101]) == 3


def test_formula():
    assert normalize_formula("sm.ns(Pseudotime, df=3)*Branch") == "~ns(Pseudotime, df=3)*Branch"
    assert formula_terms("~sm.ns(Pseudotime, df=3)*Branch + batch") == ["Pseudotime", "Branch", "batch"]
    d = pd.DataFrame({"Pseudotime": np.linspace(0, 9, 30), "Branch": ["a", "b"] * 15})
    design = Design("~sm.ns(Pseudotime, df=3)*Branch")
    assert design.matrix(d).shape == (30, 8)
    assert design.matrix(d.head(4)).shape == (4, 8)
    with pytest.raises(ValueError):
        Design("~nothing").matrix(d)


def test_dispersion_fit_recovers_the_curve():
    mu = np.exp(np.linspace(0, 6, 200))
    a, b = parametric_dispersion_fit(mu, 0.3 + 2 / mu)
    assert abs(a - 0.3) < 1e-4 and abs(b - 2) < 1e-3
    assert cal_ncenter(500) == 115


def test_trees_and_layouts():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(40, 3))
    total = sum(e[2] for e in minimum_spanning_tree(p))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    comp, kruskal = list(range(40)), 0.0
    for i, j in sorted(((i, j) for i in range(40) for j in range(i)), key=lambda e: d[e]):
        if comp[i] != comp[j]:
            kruskal += d[i, j]
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    assert abs(total - kruskal) < 1e-9
    got = ddrtree(rng.normal(size=(10, 60)), ncenter=20)
    assert len(got["edges"]) == 19 and got["Z"].shape == (2, 60) and all(np.isfinite(got["objective"]))
    blobs = np.concatenate([rng.normal(c, 0.1, (15, 4)) for c in (0, 3)])
    y = tsne(blobs, iterations=200, perplexity=5)
    assert np.linalg.norm(y[:15].mean(0) - y[15:].mean(0)) > y[:15].std()
    dd = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(2))
    assert ward_clusters(dd, 2).tolist() == [1] * 15 + [2] * 15


def test_density_and_lowess():
    rng = np.random.default_rng(3)
    grid, y = density(rng.normal(size=500))
    assert abs(np.sum(y) * (grid[1] - grid[0]) - 1) < 0.01
    x = np.linspace(0, 1, 30)
    assert np.allclose(lowess(x, 2 * x + 1), 2 * x + 1, atol=1e-6)


def test_family_names():
    assert family_from_name("tobit", lower=0.1).lower == 0.1
    for bad in ("gaussianff", "zzz"):
        with pytest.raises(ValueError):
            family_from_name(bad)
