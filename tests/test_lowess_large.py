"""LOWESS of many points by intervals equals the one point by point."""

import time

import numpy as np
import pytest

from dendrospark.functions import density


@pytest.mark.parametrize("kind", ["even", "gaps", "equal"])
@pytest.mark.parametrize("frac", [2 / 3, 0.05, 1.0])
def test_same_as_point_by_point(monkeypatch, kind, frac):
    rng = np.random.default_rng(0)
    x = {"even": rng.random(700), "gaps": np.concatenate([rng.random(300), 50 + rng.random(400) ** 4]), "equal": np.round(rng.random(700), 1) * 1e4}[kind]
    x = np.sort(x)
    y = np.sin(x * 6 / x.max()) + rng.normal(0, 0.2, 700) + (rng.random(700) < 0.05) * 8
    want = density.lowess(x, y, frac)
    monkeypatch.setattr(density, "MANY", 10)
    assert np.allclose(density.lowess(x, y, frac), want, rtol=1e-7, atol=1e-8)


def test_time_grows_like_the_points():
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(40_000))
    began = time.time()
    fit = density.lowess(x, np.sin(6 * x) + rng.normal(0, 0.3, len(x)), 0.1)
    assert np.abs(fit - np.sin(6 * x))[1000:-1000].max() < 0.1 and time.time() - began < 60
