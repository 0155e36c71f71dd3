"""Size factors, detection, dispersion moments and curve, variance stabilisation.

Sums run over stored entries; zeros enter by counting, so nothing is densified.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import CellDataset

METHODS = ("mean-geometric-mean-total", "geometric-mean-total", "median-geometric-mean", "weighted-median", "median")


def size_factors(cds: CellDataset, method: str = METHODS[0], round_exprs: bool = True) -> DataFrame:
    """cell_id, size_factor."""
    if method == "mode":
        raise NotImplementedError("size factors by mode are not supported")
    if method not in METHODS:
        raise ValueError(f"size factors have no method {method!r}")
    x = cds.expr.select("cell_id", "gene_id", (F.rint("value") if round_exprs else F.col("value")).alias("x"))
    cells = cds.cells.select("cell_id")
    n = cells.count()
    if method.endswith("-total"):
        totals = cells.join(x.groupBy("cell_id").agg(F.sum("x").alias("total")), "cell_id", "left").fillna(0.0, "total")
        mean = totals.agg(F.avg(F.when(F.col("total") > 0, F.ln("total")).otherwise(float("-inf"))).alias("m"))
        joined = totals.crossJoin(F.broadcast(mean))
        # an empty cell makes the mean -infinity: its own factor is 0/0 and becomes 1, those of others are infinite; by logarithms it is the other way round
        logs = F.when(F.col("total") > 0, F.ln("total")).otherwise(float("-inf"))
        plain = F.when(F.exp("m") > 0, F.try_divide("total", F.exp("m"))).when(F.col("total") > 0, float("inf"))
        ratio = F.when(F.col("m") != 0, logs / F.col("m")).when(logs != 0, F.signum(logs) * float("inf"))
        value = plain if method == METHODS[0] else ratio
        return joined.select("cell_id", _or_one(value).alias("size_factor"))
    if method == "median-geometric-mean":
        means = x.where("x > 0").groupBy("gene_id").agg(F.avg(F.ln("x")).alias("m"), F.count(F.lit(1)).alias("nnz")).where(F.col("nnz") == n)
        per = x.where("x > 0").join(means, "gene_id").groupBy("cell_id").agg(F.exp(F.median(F.ln("x") - F.col("m"))).alias("s"))
    elif method == "weighted-median":
        loc = _medians(x, "gene_id", n).where("med > 0")
        per = x.where("x > 0").join(loc, "gene_id").groupBy("cell_id").agg(F.exp(F.avg(F.col("nnz") / F.lit(float(n)) * (F.ln("x") - F.ln("med")))).alias("s"))
    else:
        med = _medians(x, "gene_id", n).select("gene_id", "med")
        grid = cells.crossJoin(F.broadcast(med)).join(x, ["cell_id", "gene_id"], "left")
        per = grid.groupBy("cell_id").agg(F.median(F.coalesce("x", F.lit(0.0)) - F.col("med")).alias("s"))
    return cells.join(per, "cell_id", "left").select("cell_id", _or_one(F.col("s")).alias("size_factor"))


def _or_one(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), 1.0).otherwise(value)


def _medians(x: DataFrame, key: str, n: int) -> DataFrame:
    """Per key the median over n places of which only non-zero ones are stored, and how many are positive."""
    stats = x.where("x <> 0").groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("v"), F.count_if(F.col("x") > 0).alias("nnz"))

    def at(i: int) -> Column:
        zeros = F.lit(n) - F.size("v")
        below = F.size(F.filter("v", lambda y: y < 0))
        return F.when(F.lit(i) <= below, F.try_element_at("v", F.lit(i))).when(F.lit(i) <= below + zeros, 0.0).otherwise(F.try_element_at("v", (F.lit(i) - zeros).cast("int")))

    return stats.select(key, "nnz", ((at((n + 1) // 2) + at(n // 2 + 1)) / 2).alias("med"))


def estimate_size_factors(cds: CellDataset, method: str = METHODS[0], round_exprs: bool = True) -> CellDataset:
    return cds.with_(cells=cds.cells.drop("size_factor").join(size_factors(cds, method, round_exprs), "cell_id", "left"))


def detect_genes(cds: CellDataset, min_expr: float | None = None) -> CellDataset:
    limit = cds.lower_detection_limit if min_expr is None else min_expr
    if limit < 0:
        raise ValueError("a detection limit below zero would count absent entries")
    hit = cds.expr.where(F.col("value") > limit)
    per_gene = hit.groupBy("gene_id").agg(F.count(F.lit(1)).alias("num_cells_expressed"))
    per_cell = hit.groupBy("cell_id").agg(F.count(F.lit(1)).alias("num_genes_expressed"))
    genes = cds.genes.drop("num_cells_expressed").join(per_gene, "gene_id", "left").fillna(0, "num_cells_expressed")
    cells = cds.cells.drop("num_genes_expressed").join(per_cell, "cell_id", "left").fillna(0, "num_genes_expressed")
    return cds.with_(genes=genes, cells=cells)


def dispersion_moments(cds: CellDataset, min_cells_detected: int = 1, by: list[str] | None = None) -> DataFrame:
    """[by...,] gene_id, mu, disp: moments of rounded counts over size factors, zeros counted in."""
    by = by or []
    cells = cds.cells.select("cell_id", "size_factor", *by)
    if cells.where(F.isnan("size_factor") | F.col("size_factor").isNull()).limit(1).count():
        raise ValueError("size factors are missing; run estimate_size_factors first")
    sized = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("size_factor")).alias("xim"))
    x = cds.expr.join(cells, "cell_id").withColumn("r", F.rint("value")).withColumn("x", F.col("r") / F.col("size_factor"))
    sums = x.groupBy(*by, "gene_id").agg(F.count_if(F.col("r") > cds.lower_detection_limit).alias("detected"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("nnz"), F.var_pop("x").alias("v"), F.avg("x").alias("m"))
    sums = (sums.join(sized, by) if by else sums.crossJoin(F.broadcast(sized))).where(F.col("detected") > min_cells_detected)
    mu = F.col("s") / F.col("n")
    # second moment about mu: stored entries about their own mean, moved to mu, and the zeros
    var = (F.col("nnz") * (F.col("v") + (F.col("m") - mu) * (F.col("m") - mu)) + (F.col("n") - F.col("nnz")) * mu * mu) / F.col("n")
    disp = F.greatest(F.lit(0.0), (var - F.col("xim") * mu) / (mu * mu))
    return sums.where("s > 0").select(*by, "gene_id", mu.alias("mu"), disp.alias("disp"))


def gamma_identity_fit(mu: np.ndarray, disp: np.ndarray, start: tuple[float, float], eps: float = 1e-8, maxit: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """IRLS for disp ~ a + b/mu under a Gamma family with identity link: coefficients and fitted values."""
    x = np.stack([np.ones_like(mu), 1 / mu], axis=1)
    deviance = lambda f: 2 * np.sum(-np.log(disp / f) + (disp - f) / f)
    beta = np.array(start, dtype=float)
    fit = x @ beta
    old = deviance(fit)
    for _ in range(maxit):
        w = 1 / fit**2
        new = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * disp))
        for _ in range(20):
            f = x @ new
            if (f > 0).all() and np.isfinite(deviance(f)):
                break
            new = (new + beta) / 2
        beta, fit = new, x @ new
        now = deviance(fit)
        if abs(now - old) / (0.1 + abs(now)) < eps:
            break
        old = now
    return beta, fit


def parametric_dispersion_fit(mu: np.ndarray, disp: np.ndarray, max_iter: int = 11) -> tuple[float, float]:
    """asymptDisp and extraPois; residuals outside (1e-6, 1e4) of the curve leave the fit."""
    coef = np.array([1e-6, 1.0])
    for _ in range(max_iter):
        ratio = disp / (coef[0] + coef[1] / mu)
        good = (ratio > 1e-6) & (ratio < 1e4)
        new, _ = gamma_identity_fit(mu[good], disp[good], tuple(coef))
        new[0] = max(new[0], 1e-6)
        if new[1] < 0:
            raise RuntimeError("parametric dispersion fit failed: negative extraPois")
        if np.sum(np.log(new / coef) ** 2) < 1e-6:
            return float(new[0]), float(new[1])
        coef = new
    return float(coef[0]), float(coef[1])


def cooks_distance(mu: np.ndarray, disp: np.ndarray, coef: tuple[float, float]) -> np.ndarray:
    x = np.stack([np.ones_like(mu), 1 / mu], axis=1)
    fit = x @ np.array(coef)
    w = 1 / fit**2
    h = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ (x * w[:, None])), x)
    pearson = (disp - fit) / fit
    phi = np.sum(pearson**2) / max(1, len(mu) - 2)
    return (pearson / (1 - h)) ** 2 * h / (phi * 2)


def estimate_dispersions(cds: CellDataset, min_cells_detected: int = 1, remove_outliers: bool = True, by: list[str] | None = None, model: str = "blind") -> CellDataset:
    """Moments in Spark; the curve on the driver over one (mu, disp) pair a gene and group."""
    if not cds.family.vfamily.startswith("negbinomial"):
        raise ValueError("dispersions need a negative binomial family")
    table = dispersion_moments(cds, min_cells_detected, by)
    rows = table.select("mu", "disp").toPandas()
    if not len(rows):
        raise RuntimeError("no gene is detected in enough cells for dispersions")
    mu, disp = rows["mu"].to_numpy(), rows["disp"].to_numpy()
    use = disp > 0
    coef = parametric_dispersion_fit(mu[use], disp[use])
    if remove_outliers:
        ratio = disp / (coef[0] + coef[1] / mu)
        kept = use & (ratio > 1e-6) & (ratio < 1e4)
        d = cooks_distance(mu[kept], disp[kept], coef)
        good = d <= 4 / len(mu)
        coef = parametric_dispersion_fit(mu[kept][good], disp[kept][good])
    fits = cds.meta.get("dispersion", {}) | {model: {"asymptDisp": coef[0], "extraPois": coef[1]}}
    return cds.with_(meta=cds.meta | {"dispersion": fits, f"dispersion_table_{model}": table})


def with_dispersion(cds: CellDataset, asympt: float, extra: float, model: str = "blind") -> CellDataset:
    return cds.with_(meta=cds.meta | {"dispersion": cds.meta.get("dispersion", {}) | {model: {"asymptDisp": asympt, "extraPois": extra}}})


def dispersion_at(cds: CellDataset, q: Column, model: str = "blind") -> Column:
    fit = cds.state("dispersion")[model]
    return F.lit(fit["asymptDisp"]) + F.lit(fit["extraPois"]) / q


def disp_table(cds: CellDataset, moments: DataFrame, model: str = "blind") -> DataFrame:
    return moments.select("gene_id", F.col("mu").alias("mean_expression"), dispersion_at(cds, F.col("mu"), model).alias("dispersion_fit"), F.col("disp").alias("dispersion_empirical"))


def vst(q: Column, asympt: float, extra: float) -> Column:
    inner = 1 + extra + 2 * asympt * q + 2 * F.sqrt(asympt * q * (1 + extra + asympt * q))
    return F.log2(inner / (4 * asympt))


def vst_exprs(cds: CellDataset, model: str = "blind", round_vals: bool = True) -> DataFrame:
    """cell_id, gene_id, value for stored entries; an absent one is ``vst_zero``."""
    fit = cds.state("dispersion")[model]
    q = F.col("value") / F.col("size_factor")
    x = cds.expr.join(cds.cells.select("cell_id", "size_factor"), "cell_id")
    return x.select("cell_id", "gene_id", vst(F.rint(q) if round_vals else q, fit["asymptDisp"], fit["extraPois"]).alias("value"))


def vst_zero(asympt: float, extra: float) -> float:
    return math.log2((1 + extra) / (4 * asympt))


def cal_ncenter(n: int, limit: int = 100) -> int:
    return int(round(2 * limit * math.log(n) / (math.log(n) + math.log(limit))))


def set_ordering_filter(cds: CellDataset, ordering_genes: DataFrame) -> CellDataset:
    marks = ordering_genes.select(F.col("gene_id").cast("string").alias("_g")).distinct()
    found = cds.genes.drop("use_for_ordering").join(marks, F.col("gene_id").cast("string") == F.col("_g"), "left")
    return cds.with_(genes=found.withColumn("use_for_ordering", F.col("_g").isNotNull()).drop("_g"))


def qc_filter(cds: CellDataset, sds: float = 2.0) -> DataFrame:
    """Cells whose log10 total lies within ``sds`` sample deviations of the mean."""
    totals = cds.expr.groupBy("cell_id").agg(F.sum("value").alias("total")).where("total > 0").withColumn("t", F.log10("total"))
    bounds = totals.agg(F.avg("t").alias("m"), F.stddev_samp("t").alias("s"))
    return totals.crossJoin(F.broadcast(bounds)).where(F.abs(F.col("t") - F.col("m")) < sds * F.col("s")).select("cell_id", "total")
