"""Normalisation: family x method matrix, zero-deviation filter, z-scores, batch residuals, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import CellDataset
from .preprocess import vst


def normalize_expr(cds: CellDataset, norm_method: str = "log", pseudo_expr: float = 1.0, relative_expr: bool = True) -> DataFrame:
    """cell_id, gene_id, value over the dense grid of ordering genes (all genes if none is marked)."""
    genes = cds.genes
    if "use_for_ordering" in genes.columns:
        marked = genes.where("use_for_ordering")
        genes = marked if marked.limit(1).count() else genes
    kind = cds.family.vfamily
    if norm_method not in ("log", "vstExprs", "none"):
        raise ValueError(f"unknown norm_method {norm_method!r}")
    if (kind in ("uninormal", "binomialff") and norm_method != "none") or (kind == "Tobit" and norm_method == "vstExprs"):
        raise ValueError(f"norm_method {norm_method!r} doesn't go with family {kind!r}")
    if kind == "binomialff":
        return tf_idf(cds.with_(genes=genes))
    x = cds.dense(genes)
    if kind.startswith("negbinomial") and (relative_expr or norm_method != "log"):
        x = x.join(cds.cells.select("cell_id", "size_factor"), "cell_id").withColumn("value", F.col("value") / F.col("size_factor"))
    if norm_method == "vstExprs":
        fit = cds.state("dispersion")["blind"]
        value = vst(F.col("value"), fit["asymptDisp"], fit["extraPois"])
    else:
        value = F.col("value") + pseudo_expr
        value = F.log2(value) if norm_method == "log" else value
    return x.select("cell_id", "gene_id", value.alias("value"))


def tf_idf(cds: CellDataset) -> DataFrame:
    """1[x > 0] * ln(1 + cells / detecting cells); genes that no cell has are absent."""
    n = cds.cells.count()
    hit = cds.expr.where("value > 0")
    df = hit.groupBy("gene_id").agg(F.count(F.lit(1)).alias("df"))
    return hit.join(df, "gene_id").select("cell_id", "gene_id", F.log1p(F.lit(float(n)) / F.col("df")).alias("value"))


def drop_zero_sd(x: DataFrame) -> DataFrame:
    """Genes of a dense x whose population deviation is positive."""
    return x.join(x.groupBy("gene_id").agg(F.stddev_pop("value").alias("sd")).where("sd > 0").select("gene_id"), "gene_id", "left_semi")


def drop_nonfinite(x: DataFrame) -> DataFrame:
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return x.join(x.groupBy("gene_id").agg(F.min(fine.cast("int")).alias("ok")).where("ok = 1").select("gene_id"), "gene_id", "left_semi")


def zscore(x: DataFrame) -> DataFrame:
    stats = x.groupBy("gene_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return x.join(stats, "gene_id").select("cell_id", "gene_id", ((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("value"))


def batch_residual(x: DataFrame, cells: DataFrame, batch: str) -> DataFrame:
    """Ordinary least squares on one factor, non-intercept part removed: x - (mean of level - mean of first level)."""
    y = x.join(cells.select("cell_id", batch), "cell_id")
    means = y.groupBy("gene_id", batch).agg(F.avg("value").alias("m"))
    first = cells.agg(F.min(batch)).first()[0]
    base = means.where(F.col(batch) == F.lit(first)).select("gene_id", F.col("m").alias("m0"))
    return y.join(means, ["gene_id", batch]).join(base, "gene_id").select("cell_id", "gene_id", (F.col("value") - (F.col("m") - F.col("m0"))).alias("value"))
