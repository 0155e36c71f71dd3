"""Relative to absolute counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.density import dmode
from ..sources.dataset import CellDataset


def estimate_t(cds: CellDataset, thresh: float = 0.1) -> DataFrame:
    """cell_id, t: 10 to the mode of log10 expression above the threshold, by a kernel density a cell; 1 for a cell without such values."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": part["cell_id"].iloc[:1], "t": [10 ** dmode(np.sort(np.log10(part["value"].to_numpy())))]})

    kind = cds.expr.schema["cell_id"].dataType.simpleString()
    found = cds.expr.where(F.col("value") > thresh).groupBy("cell_id").applyInPandas(run, f"cell_id {kind}, t double")
    return cds.cells.select("cell_id").join(found, "cell_id", "left").fillna(1.0, "t")


def total_proposal(cds: CellDataset, t: DataFrame, capture_rate: float = 0.25, thresh: float = 0.1) -> DataFrame:
    """cell_id, total: n(x <= t) / frac(x <= t) / capture over values above the threshold; 0 where none is at most t."""
    x = cds.expr.where(F.col("value") > thresh).join(t, "cell_id")
    got = x.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") <= F.col("t")).alias("below"))
    return got.select("cell_id", F.when(F.lit(capture_rate > 0) & (F.col("below") > 0), F.col("n") / capture_rate).otherwise(0.0).alias("total"))


def relative2abs(cds: CellDataset, t: DataFrame | None = None, expected_capture_rate: float = 0.25, method: str = "num_genes") -> DataFrame:
    """cell_id, gene_id, value."""
    if method != "num_genes":
        raise NotImplementedError(f"method {method!r} is not supported")
    t = estimate_t(cds) if t is None else t
    if not np.isfinite(expected_capture_rate) or t.where(F.isnan("t") | F.col("t").isNull() | (F.abs("t") == float("inf"))).limit(1).count():
        raise ValueError("t estimates and the capture rate must be finite")
    totals = cds.expr.groupBy("cell_id").agg(F.sum("value").alias("s"))
    x = cds.expr.join(totals, "cell_id").join(total_proposal(cds, t, expected_capture_rate), "cell_id", "left")
    return x.select("cell_id", "gene_id", (F.coalesce(F.try_divide("value", "s"), F.lit(0.0)) * F.coalesce("total", F.lit(0.0))).alias("value"))
