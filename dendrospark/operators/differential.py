"""Likelihood-ratio tests.

A design that is saturated in one factor has group means as its fitted means for every family with fixed
dispersion, so that test is one grouped aggregate in Catalyst.  Other designs fit gene by gene in ``models``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dataset import CellDataset
from .preprocess import dispersion_at


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def chi2_tail(stat: Column, df: Column) -> Column:
    """P(X > stat) as the finite sum of a whole number of degrees of freedom; odd ones by an erfc series (absolute error under 2e-7)."""
    z = F.sqrt(stat / 2)
    t = 1 / (1 + 0.5 * z)
    # Chebyshev coefficients of a public rational erfc approximation.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    erfc = t * F.exp(-z * z + poly)
    e = F.exp(-stat / 2)
    odd = df % 2
    # terms (stat/2)**(j + odd/2) / gamma(j + 1 + odd/2), each from the one before
    first = F.when(odd == 1, F.sqrt(2 * stat / F.lit(3.141592653589793))).otherwise(F.lit(1.0))
    many = F.greatest(F.floor((df - odd) / 2).cast("int"), F.lit(0))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, j: F.struct((s["term"] * (stat / 2) / (j + odd / 2)).alias("term"), (s["total"] + s["term"]).alias("total"))
    steps = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    return F.when(odd == 1, erfc).otherwise(F.lit(0.0)) + e * F.aggregate(steps, start, step)["total"]


def bh_adjust(tests: DataFrame, p: str = "pval", ok: str | None = None) -> DataFrame:
    """Adds qval: Benjamini-Hochberg over the rows where ``ok`` holds; others keep 1."""
    good = F.col(ok) if ok else F.lit(True)
    part = Window.partitionBy(good)
    m = F.count(F.lit(1)).over(part)
    rank = F.row_number().over(part.orderBy(p))
    back = part.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tests.withColumn("_m", m).withColumn("_rn", rank)
    out = out.withColumn("qval", F.when(good, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rn")).over(back))).otherwise(1.0))
    return out.drop("_m", "_rn")


def group_lrt(cds: CellDataset, group: str, family: str, asympt: float | None = None, extra: float | None = None) -> DataFrame:
    """gene_id, stat, df, pval, qval for ~group against ~1, zeros counted in.

    nb: rounded counts over size factors with dispersion asympt + extra / mean(rounded raw count); poisson: the same counts; gaussian:
    raw values with the ML scale; binomial: detection.
    """
    cells = cds.cells.select("cell_id", "size_factor", F.col(group).alias("_g"))
    sized = cells.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    x = cds.expr.join(cells, "cell_id")
    if family in ("nb", "poisson"):
        y = F.rint(F.col("value") / F.col("size_factor"))
    elif family == "gaussian":
        y = F.col("value")
    elif family == "binomial":
        y = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown family {family!r}")
    x = x.withColumn("y", y)
    sums = x.groupBy("gene_id", "_g").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.sum(F.rint("value")).alias("raw"))
    grid = cds.genes.select("gene_id").distinct().crossJoin(F.broadcast(sized)).join(sums, ["gene_id", "_g"], "left").fillna(0.0, ["s", "ss", "raw"])
    gene = grid.groupBy("gene_id").agg(F.sum("s").alias("tot_s"), F.sum("ss").alias("tot_ss"), F.sum("n").alias("tot_n"), F.sum("raw").alias("tot_r"), F.count(F.lit(1)).alias("k"))
    j = grid.join(gene, "gene_id")
    mu, mu0 = F.col("s") / F.col("n"), F.col("tot_s") / F.col("tot_n")
    if family == "poisson":
        part = 2 * (_xlogy(F.col("s"), mu) - _xlogy(F.col("s"), mu0) - F.col("s") + F.col("n") * mu0)
    elif family == "nb":
        mean = F.col("tot_r") / F.col("tot_n")
        a = F.lit(asympt) + F.lit(extra) / mean if asympt is not None else dispersion_at(cds, mean)
        ll = lambda m: _xlogy(F.col("s"), m) - (F.col("s") + F.col("n") / a) * F.ln(1 + a * m)
        part = F.when(F.col("tot_r") > 0, 2 * (ll(mu) - ll(mu0))).otherwise(0.0)
    elif family == "binomial":
        ll = lambda m: _xlogy(F.col("s"), m) + _xlogy(F.col("n") - F.col("s"), 1 - m)
        part = 2 * (ll(mu) - ll(mu0))
    else:
        part = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    got = j.groupBy("gene_id").agg(F.sum(part).alias("v"), F.first("tot_s").alias("tot_s"), F.first("tot_ss").alias("tot_ss"), F.first("tot_n").alias("tot_n"), (F.first("k") - 1).alias("df"))
    if family == "gaussian":
        # a gene without deviations has no test
        stat = F.when((F.col("v") > 0), F.col("tot_n") * F.ln(F.try_divide(F.col("tot_ss") - F.col("tot_s") * F.col("tot_s") / F.col("tot_n"), F.col("v"))))
    else:
        stat = F.col("v")
    tested = got.select("gene_id", F.when(stat.isNotNull(), F.greatest(F.lit(0.0), stat)).alias("stat"), "df")
    tested = tested.withColumn("pval", F.coalesce(chi2_tail(F.col("stat"), F.col("df")), F.lit(1.0))).withColumn("_ok", F.col("stat").isNotNull())
    return bh_adjust(tested, ok="_ok").drop("_ok")
