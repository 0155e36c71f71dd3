"""Per-gene fits run once, whatever is read of them, and are spread over tasks."""

import numpy as np
import pandas as pd

from dendrospark.functions import glm
from dendrospark.operators import models, preprocess
from dendrospark.sources import from_matrix


def test_fits_are_not_part_of_later_plans(spark):
    x = np.random.default_rng(0).poisson(9, (40, 12)).astype(float)
    cells = pd.DataFrame({"Pseudotime": np.linspace(0, 1, 40)}, index=[f"C{i:02d}" for i in range(40)])
    cds = preprocess.with_dispersion(preprocess.estimate_size_factors(from_matrix(spark, x, cells)), 0.05, 1.0)
    curves = models.smooth_curves(cds, pd.DataFrame({"Pseudotime": np.linspace(0, 1, 5)}))
    assert "FlatMapGroupsInPandas" not in curves._jdf.queryExecution().analyzed().toString()
    assert curves.count() == 60
    fits, _ = models.fit_models(cds, "~sm.ns(Pseudotime, df=3)")
    assert len(fits.inputFiles()) > 2  # small genes, yet not all in one task


def test_likelihood_with_its_constant(monkeypatch):
    y, x = np.random.default_rng(1).poisson(4, 200).astype(float), np.ones((200, 1))
    calls = []
    constant = glm.nb_constant
    monkeypatch.setattr(glm, "nb_constant", lambda *a: calls.append(1) or constant(*a))
    for alpha in (0.0, 0.3):
        calls.clear()
        fit = glm.fit_glm(y, x, "nb", alpha)
        assert len(calls) == 1 and abs(fit.llf - glm.nb_loglik(y, fit.predict(x), alpha)) < 1e-9
