"""Per-gene model fits and tests for any formula: one Arrow batch of a gene's cells at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import Design, formula_terms
from ..functions.glm import Fit, fit_tobit, fit_with_fallback, lrt
from ..sources.dataset import CellDataset
from ..store import cut
from .differential import bh_adjust

#: A design row a cell travels with every gene's cells; the frame of covariates is on the driver up to this many cells.
MOST_CELLS = 5_000_000


def _covariates(cds: CellDataset, formulas: list[str]) -> pd.DataFrame:
    names = list(dict.fromkeys(n for f in formulas for n in formula_terms(f)))
    missing = [n for n in names if n not in cds.cells.columns]
    if missing:
        raise ValueError(f"not columns of cells: {missing}")
    frame = cds.cells.select("cell_id", "size_factor", *names).limit(MOST_CELLS + 1).orderBy("cell_id").toPandas()
    if len(frame) > MOST_CELLS:
        raise ValueError("more cells than a broadcast design may have")
    for n in names:
        if frame[n].isna().any() or (pd.api.types.is_numeric_dtype(frame[n]) and not np.isfinite(frame[n].astype(float)).all()):
            raise ValueError(f"{n!r} has missing or infinite values")
    return frame


def _response(value: np.ndarray, family: str, size: np.ndarray, relative: bool) -> np.ndarray:
    if family.startswith("negbinomial"):
        return np.rint(value / size if relative else value)
    return value if family in ("uninormal", "binomialff") else np.log10(np.maximum(value, 1e-300))


def _fit(y: np.ndarray, x: np.ndarray, cds_family, alpha: float) -> Fit | None:
    kind = cds_family.vfamily
    if kind == "Tobit":
        try:
            return fit_tobit(np.maximum(y, cds_family.lower), x, cds_family.lower, cds_family.upper)
        except (FloatingPointError, np.linalg.LinAlgError, OverflowError, ValueError):
            return None
    name = {"uninormal": "gaussian", "binomialff": "binomial"}.get(kind, "nb")
    return fit_with_fallback(y, x, name, alpha)


def _alpha(raw: np.ndarray, disp: tuple[float, float] | None, family) -> float:
    if disp is not None:
        m = float(np.rint(raw).mean())
        return disp[0] + disp[1] / m if m > 0 else 0.0
    if family.vfamily == "negbinomial":
        return 1.0
    size = getattr(family, "size", math.inf)
    return 1 / size if math.isfinite(size) else 0.0


def _per_gene(cds: CellDataset, designs: list[np.ndarray], cells: pd.DataFrame, relative: bool, body, schema: str) -> DataFrame:
    fits = cds.meta.get("dispersion", {}).get("blind")
    disp = (fits["asymptDisp"], fits["extraPois"]) if fits else None
    if relative and cds.family.vfamily.startswith("negbinomial") and cells["size_factor"].isna().any():
        raise ValueError("size factors are missing; run estimate_size_factors first")
    shared = cds.expr.sparkSession.sparkContext.broadcast((cells["cell_id"].to_numpy(), cells["size_factor"].to_numpy(), designs))
    family = cds.family

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, size, xs = shared.value
        raw = np.zeros(len(ids))
        raw[np.searchsorted(ids, part["cell_id"].to_numpy())] = part["value"].to_numpy()
        y = _response(raw, family.vfamily, size, relative)
        a = _alpha(raw, disp, family)
        return body(part["gene_id"].iloc[0], [_fit(y, x, family, a) for x in xs])

    spark = cds.expr.sparkSession
    # a number of partitions of its own, or adaptive execution puts all genes into one task; fits are cut, as whoever reads them does so many times
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = cds.expr.join(cds.genes.select("gene_id"), "gene_id", "left_semi").repartition(parts, "gene_id")
    return cut(rows.groupBy("gene_id").applyInPandas(run, schema), "fits")


def differential_gene_test(cds: CellDataset, full: str = "~sm.ns(Pseudotime, df=3)", reduced: str = "~1", relative_expr: bool = True) -> DataFrame:
    """gene_id, status, family, pval, qval and the gene columns; a failed gene has p = q = 1."""
    cells = _covariates(cds, [full, reduced])
    designs = [Design(f).matrix(cells) for f in (full, reduced)]
    kind = cds.family.vfamily

    def body(gene, fits):
        ok = all(f is not None for f in fits)
        p = lrt(*fits)[2] if ok else 1.0
        return pd.DataFrame({"gene_id": [gene], "status": ["OK" if ok and not math.isnan(p) else "FAIL"], "family": [kind], "pval": [1.0 if math.isnan(p) else p]})

    tested = _per_gene(cds, designs, cells, relative_expr, body, "gene_id string, status string, family string, pval double")
    whole = cds.genes.join(tested, "gene_id", "left").fillna({"status": "FAIL", "family": kind, "pval": 1.0})
    return bh_adjust(whole.withColumn("_ok", F.col("status") == "OK"), ok="_ok").drop("_ok")


def fit_models(cds: CellDataset, formula: str, relative_expr: bool = True) -> tuple[DataFrame, Design]:
    """(gene_id, status, params, llf, kind; the design that remembers training knots and levels)."""
    cells = _covariates(cds, [formula])
    design = Design(formula)
    x = design.matrix(cells)

    def body(gene, fits):
        f = fits[0]
        return pd.DataFrame({"gene_id": [gene], "status": ["OK" if f else "FAIL"], "params": [None if f is None else f.params.tolist()], "llf": [None if f is None else f.llf], "kind": [None if f is None else f.kind]})

    return _per_gene(cds, [x], cells, relative_expr, body, "gene_id string, status string, params array<double>, llf double, kind string"), design


def response_matrix(models: DataFrame, design: Design, new_data: pd.DataFrame, knots: str = "training") -> DataFrame:
    """gene_id, point_idx, expectation on new data; failed fits give NaN. knots="newdata" places splines anew."""
    if not models.where("status = 'OK'").limit(1).count():
        raise RuntimeError("no model could be fitted")
    x = (design if knots == "training" else Design(design.formula)).matrix(new_data)
    grid = models.sparkSession.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point_idx int, x array<double>")
    eta = F.aggregate(F.zip_with("params", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    mean = F.when(F.col("kind") == "log", F.exp(eta)).when(F.col("kind") == "logit", 1 / (1 + F.exp(-eta))).when(F.col("kind") == "log10", F.pow(F.lit(10.0), eta)).otherwise(eta)
    return models.crossJoin(F.broadcast(grid)).select("gene_id", "point_idx", F.coalesce(mean, F.lit(float("nan"))).alias("expectation"))


def smooth_curves(cds: CellDataset, new_data: pd.DataFrame, formula: str = "~sm.ns(Pseudotime, df=3)", relative_expr: bool = True) -> DataFrame:
    return response_matrix(*fit_models(cds, formula, relative_expr), new_data)


def beam(cds: CellDataset, full: str = "~sm.ns(Pseudotime, df=3)*Branch", reduced: str = "~sm.ns(Pseudotime, df=3)") -> DataFrame:
    """Branch-dependent expression on a dataset whose cells have what the formulas name; ``trajectory.beam`` builds the branches too."""
    return differential_gene_test(cds, full, reduced)
