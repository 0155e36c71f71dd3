"""The frames behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dataset import CellDataset
from .normalize import zscore


def expression_long(cds: CellDataset) -> DataFrame:
    """f_id, cell, expression over the dense grid; counts are over size factors and rounded."""
    x = cds.dense()
    if cds.family.vfamily.startswith("negbinomial"):
        x = x.join(cds.cells.select("cell_id", "size_factor"), "cell_id").withColumn("value", F.rint(F.col("value") / F.col("size_factor")))
    return x.select(F.col("gene_id").alias("f_id"), F.col("cell_id").alias("cell"), F.col("value").alias("expression"))


def markers(cds: CellDataset, wanted: DataFrame) -> DataFrame:
    """Genes whose id or short name is in the one column of ``wanted``: two equi semi-joins, not an OR join."""
    names = wanted.select(F.col(wanted.columns[0]).alias("_w")).distinct()
    hit = [cds.genes.join(names, F.col(c).cast("string") == F.col("_w"), "left_semi") for c in ("gene_id", "gene_short_name")]
    return hit[0].union(hit[1]).dropDuplicates(["gene_id"])


def row_scale_clip(x: DataFrame, low: float, high: float) -> DataFrame:
    z = zscore(x)
    return z.withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("value")))))


def correlation_distance(curves: DataFrame) -> DataFrame:
    """gene_a < gene_b, (1 - correlation) / 2 over curves(gene_id, point_idx, value); undefined correlations give 1."""
    a, b = (curves.select("point_idx", F.col("gene_id").alias(f"gene_{k}"), F.col("value").alias(k)) for k in "ab")
    pair = a.join(b, "point_idx").where("gene_a < gene_b").groupBy("gene_a", "gene_b").agg(F.corr("a", "b").alias("r"))
    return pair.select("gene_a", "gene_b", F.when(F.col("r").isNull() | F.isnan("r"), 1.0).otherwise((1 - F.col("r")) / 2).alias("distance"))


def crosstab(cells: DataFrame, row: str, column: str) -> DataFrame:
    n = cells.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def gene_set_score(cds: CellDataset, up: DataFrame, down: DataFrame) -> DataFrame:
    """cell_id, score: mean over the first set minus mean over the second, absent entries counting as 0."""
    sets = up.select("gene_id", F.lit(1).alias("k")).union(down.select("gene_id", F.lit(0).alias("k")))
    n1, n0 = up.count(), down.count()
    sums = cds.expr.join(sets, "gene_id").groupBy("cell_id").agg(F.sum(F.when(F.col("k") == 1, F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("k") == 0, F.col("value")).otherwise(0.0)).alias("b"))
    got = cds.cells.select("cell_id").join(sums, "cell_id", "left").fillna(0.0, ["a", "b"])
    return got.select("cell_id", (F.col("a") / F.lit(float(n1)) - F.col("b") / F.lit(float(n0))).alias("score"))


def rescale(cells: DataFrame, group: str, value: str) -> DataFrame:
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return cells.withColumn(value, F.when(high > low, 100 * (F.col(value) - low) / (high - low)).otherwise(F.col(value)))


def log_ratio(curves: DataFrame, limit: float) -> DataFrame:
    ratio = F.log2((F.col("a") + 1) / (F.col("b") + 1))
    return curves.withColumn("ilr", F.greatest(F.lit(-limit), F.least(F.lit(limit), ratio)))


def area_between(curves: DataFrame) -> DataFrame:
    """gene_id, abc: signed trapezoid area of a - b over points spread on 0..100."""
    d = curves.select("gene_id", "point_idx", (F.col("a") - F.col("b")).alias("d"))
    s = d.groupBy("gene_id").agg(F.sum("d").alias("s"), F.min_by("d", "point_idx").alias("first"), F.max_by("d", "point_idx").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return s.select("gene_id", F.round((F.col("s") - (F.col("first") + F.col("last")) / 2) * 100 / (F.col("n") - 1), 3).alias("abc"))
