"""Frames of the plots, ready to draw: one row a mark. Rendering is left to the caller.

Curves, joins and scaling are Spark's; clustering of heatmap rows needs their distances together and is limited to ``MOST_ROWS`` genes (checked).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density import lowess
from ..functions.formula import formula_terms
from ..sources.dataset import CellDataset
from . import models, order, plotdata, preprocess, reduce, trajectory

MOST_ROWS = 5000
POINTS = 100


# ---- embeddings and trees


def rotated(x: Column, y: Column, theta: float) -> tuple[Column, Column]:
    """Coordinates turned by theta degrees, counter-clockwise."""
    c, s = math.cos(math.radians(theta)), math.sin(math.radians(theta))
    return x * c - y * s, x * s + y * c


def embedding_points(points: DataFrame, color: DataFrame) -> DataFrame:
    """cell_id, x, y and the columns of color(cell_id, ...), by the first two coordinates."""
    at = points.select("cell_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    return at.join(color, "cell_id")


def trajectory_points(cds: CellDataset, theta: float = 0.0) -> DataFrame:
    """cell_id, x, y, State, Pseudotime."""
    at = embedding_points(cds.state("X_dr"), cds.cells.select("cell_id", "State", "Pseudotime"))
    x, y = rotated(F.col("x"), F.col("y"), theta)
    return at.withColumn("_x", x).withColumn("y", y).drop("x").withColumnRenamed("_x", "x").select("cell_id", "x", "y", "State", "Pseudotime")


def trajectory_segments(cds: CellDataset, theta: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(the graph's edges as x, y, x_end, y_end; its branch points as x, y, branch_point_idx)."""
    graph = cds.state("graph")
    nodes, edges, _ = graph.frames(cds.cells)
    x, y = rotated(F.col("coords")[0], F.col("coords")[1], theta)
    at = nodes.select("node", x.alias("x"), y.alias("y"))
    lines = edges.join(at.withColumnRenamed("node", "src"), "src").join(at.select(F.col("node").alias("dst"), F.col("x").alias("x_end"), F.col("y").alias("y_end")), "dst")
    marks = at.sparkSession.createDataFrame([(v, i) for i, v in enumerate(graph.branch_points(), 1)], "node long, branch_point_idx int")
    return lines.select("x", "y", "x_end", "y_end"), at.join(marks, "node").select("x", "y", "branch_point_idx")


def tree_layout(cds: CellDataset, root: int | None = None) -> DataFrame:
    """cell_id, x, y: cells on a layered drawing of the graph; leaves are spread evenly, other nodes stand over the middle of theirs, depth goes down."""
    graph = cds.state("graph")
    near = graph.near()
    root = cds.state("ordering")["root_node"] if root is None else root
    parent = order.distances_from(near, root)[1]
    depth, below, walk = {root: 0}, {}, [root]
    for v in walk:
        below[v] = [u for u in near[v] if u != parent[v]]
        for u in below[v]:
            depth[u] = depth[v] + 1
            walk.append(u)
    x: dict[int, float] = {}
    todo, leaves = [root], 0
    while todo:
        v = todo.pop()
        if not below[v]:
            x[v], leaves = float(leaves), leaves + 1
        todo += reversed(below[v])
    for v in reversed(walk):
        if below[v]:
            ends = [x[u] for u in below[v]]
            x[v] = (min(ends) + max(ends)) / 2
    place = cds.expr.sparkSession.createDataFrame([(v, x[v], float(-depth[v])) for v in walk], "node long, x double, y double")
    return graph.frames(cds.cells)[2].join(place, "node").select("cell_id", "x", "y")


def rho_delta(points: DataFrame, rho: float, delta: float) -> DataFrame:
    return points.select("cell_id", "rho", "delta", ((F.col("rho") > rho) & (F.col("delta") > delta)).alias("peaks"))


def with_markers(frame: DataFrame, cds: CellDataset, wanted: DataFrame, linear: bool = False) -> DataFrame:
    """frame(cell_id, ...) with a row for each marker gene: feature_label, value (log10(value + 0.1) unless linear)."""
    genes = plotdata.markers(cds, wanted)
    x = plotdata.expression_long(cds.with_(genes=genes)).join(genes.select(F.col("gene_id").alias("f_id"), feature_label(genes).alias("feature_label")), "f_id")
    value = F.col("expression") if linear else F.log10(F.col("expression") + 0.1)
    return frame.join(x.select(F.col("cell").alias("cell_id"), "feature_label", value.alias("value")), "cell_id")


def feature_label(genes: DataFrame) -> Column:
    """The short name, the id where there is none."""
    return F.coalesce("gene_short_name", F.col("gene_id").cast("string")) if "gene_short_name" in genes.columns else F.col("gene_id").cast("string")


# ---- genes along pseudotime


def floored(value: str, least: float) -> Column:
    return F.when(F.col(value).isNull() | F.isnan(value) | (F.col(value) < least), least).otherwise(F.col(value)).alias(value)


def _expectation(cds: CellDataset, formula: str, name: str) -> DataFrame:
    """cell_id, gene_id, and the fitted value at every cell."""
    terms = formula_terms(formula)
    cells = cds.cells.select("cell_id", *terms).limit(models.MOST_CELLS + 1).orderBy("cell_id").toPandas()
    if len(cells) > models.MOST_CELLS:
        raise ValueError("more cells than a broadcast design may have")
    kind = cds.cells.schema["cell_id"].dataType.simpleString()
    place = cds.expr.sparkSession.createDataFrame(list(zip(range(len(cells)), cells["cell_id"].tolist(), strict=True)), f"point_idx int, cell_id {kind}")
    return models.smooth_curves(cds, cells[terms], formula).join(place, "point_idx").select("cell_id", "gene_id", F.col("expectation").alias(name))


def genes_in_pseudotime(cds: CellDataset, genes: DataFrame, formula: str = "~sm.ns(Pseudotime, df=3)", min_expr: float | None = None) -> DataFrame:
    """cell_id, gene_id, feature_label, Pseudotime, expression, expectation, both at least min_expr (the detection limit)."""
    least = cds.lower_detection_limit if min_expr is None else min_expr
    few = cds.with_(genes=cds.genes.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))
    long = plotdata.expression_long(few).select(F.col("cell").alias("cell_id"), F.col("f_id").alias("gene_id"), "expression")
    long = long.join(few.cells.select("cell_id", "Pseudotime"), "cell_id").join(_expectation(few, formula, "expectation"), ["cell_id", "gene_id"], "left")
    long = long.join(few.genes.select("gene_id", feature_label(few.genes).alias("feature_label")), "gene_id")
    return long.select("cell_id", "gene_id", "feature_label", "Pseudotime", floored("expression", least), floored("expectation", least))


def genes_branched(cds: CellDataset, genes: DataFrame, formula: str = "~sm.ns(Pseudotime, df=3)*Branch", reduced: str | None = None, min_expr: float | None = None, **branches) -> DataFrame:
    """The same on the branch dataset: Branch, full_expectation, and reduced_expectation (NULL without a reduced formula)."""
    least = cds.lower_detection_limit if min_expr is None else min_expr
    few = cds.with_(genes=cds.genes.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))
    few = trajectory.build_branch_cell_dataset(few, **branches)
    few = few.with_(expr=few.expr.join(few.genes.select("gene_id"), "gene_id", "left_semi"))
    long = plotdata.expression_long(few).select(F.col("cell").alias("cell_id"), F.col("f_id").alias("gene_id"), "expression")
    long = long.join(few.cells.select("cell_id", "Pseudotime", "Branch"), "cell_id").join(_expectation(few, formula, "full_expectation"), ["cell_id", "gene_id"], "left")
    long = long.join(few.genes.select("gene_id", feature_label(few.genes).alias("feature_label")), "gene_id")
    if reduced is None:
        last = F.lit(None).cast("double").alias("reduced_expectation")
    else:
        long, last = long.join(_expectation(few, reduced, "reduced_expectation"), ["cell_id", "gene_id"], "left"), floored("reduced_expectation", least)
    return long.select("cell_id", "gene_id", "feature_label", "Branch", "Pseudotime", floored("expression", least), floored("full_expectation", least), last)


def _on_branch(cds: CellDataset, state: int) -> DataFrame:
    """The cells of the nodes on the way from the root to a tip of the state."""
    graph = cds.state("graph")
    near = graph.near()
    known = cds.cells.select("cell_id", "State").orderBy("cell_id").toPandas()["State"].to_numpy()
    if not (known == state).any():
        raise RuntimeError(f"no cell is in state {state}")
    nodes = sorted(set(graph.closest[known == state].tolist()))
    tip = next((v for v in nodes if len(near[v]) == 1), nodes[0])
    parent = order.distances_from(near, cds.state("ordering")["root_node"])[1]
    return graph.frames(cds.cells)[2].where(F.col("node").isin(order.path(parent, tip))).select("cell_id")


def branches_in_pseudotime(cds: CellDataset, genes: DataFrame, states: list[int], labels: list[str] | None = None, norm_method: str = "raw", frac: float = 2 / 3) -> DataFrame:
    """cell_id, gene_id, feature_label, Branch, Pseudotime (0 to 100 on each branch), expression: LOWESS of each gene on each branch.

    A task holds one gene's cells of one branch, at most ``reduce.MOST_POINTS`` (checked); its time is that of sorting them but for a factor.
    """
    few = cds.with_(genes=cds.genes.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))
    grid = few.dense().join(few.cells.select("cell_id", "Pseudotime"), "cell_id")
    parts = [grid.join(_on_branch(cds, s), "cell_id", "left_semi").withColumn("Branch", F.lit(str(b))) for s, b in zip(states, labels or states, strict=True)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    most = reduce.MOST_POINTS

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most:
            raise ValueError("more cells on a branch than LOWESS may have")
        part = part.sort_values(["Pseudotime", "cell_id"], kind="stable")
        return part.assign(expression=lowess(part["Pseudotime"].to_numpy(dtype=float), part["value"].to_numpy(dtype=float), frac))[["cell_id", "gene_id", "Branch", "Pseudotime", "expression"]]

    kinds = [f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("cell_id", "gene_id", "Branch", "Pseudotime")]
    smooth = whole.groupBy("gene_id", "Branch").applyInPandas(run, ", ".join([*kinds, "expression double"]))
    if norm_method != "raw":
        smooth = smooth.withColumn("expression", scaled_value(cds, F.col("expression"), norm_method))
    smooth = plotdata.rescale(smooth, "Branch", "Pseudotime")
    return smooth.join(few.genes.select("gene_id", feature_label(few.genes).alias("feature_label")), "gene_id").select("cell_id", "gene_id", "feature_label", "Branch", "Pseudotime", "expression")


# ---- heatmaps


def scaled_value(cds: CellDataset, value: Column, norm_method: str) -> Column:
    """log10(value + 1), or the variance stabilised value, for which dispersions must have been fitted."""
    if norm_method == "log":
        return F.log10(value + 1)
    if norm_method != "vstExprs":
        raise ValueError(f"no norm method {norm_method!r}")
    fit = cds.state("dispersion")["blind"]
    return preprocess.vst(value, fit["asymptDisp"], fit["extraPois"])


def _heatmap(cds: CellDataset, curves: DataFrame, norm_method: str, low: float, high: float, num_clusters: int) -> DataFrame:
    """curves(gene_id, column, value) -> gene_id, feature_label, column, value (scaled by gene, held within low and high), cluster (Ward on correlation distances)."""
    whole = curves.groupBy("gene_id").agg(F.sum("value").alias("s")).where("s <> 0 and not isnan(s)").select("gene_id")
    x = curves.join(whole, "gene_id", "left_semi").withColumn("value", scaled_value(cds, F.col("value"), norm_method))
    x = x.select("gene_id", F.col("column").alias("cell_id"), "value")
    flat = x.groupBy("gene_id").agg(F.stddev_samp("value").alias("s")).where("s > 0").select("gene_id")
    x = plotdata.row_scale_clip(x.join(flat, "gene_id", "left_semi"), low, high).withColumn("value", F.when(F.isnan("value") | F.col("value").isNull(), 0.0).otherwise(F.col("value"))).cache()
    if x.select("gene_id").distinct().limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a heatmap may have {MOST_ROWS} genes")
    wide = x.toPandas().pivot(index="gene_id", columns="cell_id", values="value").sort_index()
    with np.errstate(all="ignore"):
        far = (1 - np.corrcoef(wide.to_numpy())) / 2 if len(wide) > 1 else np.zeros((len(wide), len(wide)))
    far = np.where(np.isnan(far), 1.0, far)
    label = reduce.ward_clusters(far, num_clusters)
    named = cds.expr.sparkSession.createDataFrame([(g, int(c)) for g, c in zip(wide.index.tolist(), label, strict=True)], "gene_id string, cluster int")
    shown = cds.genes.select("gene_id", feature_label(cds.genes).alias("feature_label"))
    return x.join(named, "gene_id").join(shown, "gene_id").select("gene_id", "feature_label", F.col("cell_id").alias("column"), "value", "cluster")


def pseudotime_heatmap(cds: CellDataset, formula: str = "~sm.ns(Pseudotime, df=3)", norm_method: str = "log", scale_min: float = -3.0, scale_max: float = 3.0, num_clusters: int = 6) -> DataFrame:
    """Curves on 100 points from the first to the last pseudotime."""
    low, high = cds.cells.agg(F.min("Pseudotime"), F.max("Pseudotime")).first()
    curves = models.smooth_curves(cds, pd.DataFrame({"Pseudotime": np.linspace(low, high, POINTS)}), formula)
    return _heatmap(cds, curves.select("gene_id", (F.col("point_idx") + 1).alias("column"), F.col("expectation").alias("value")), norm_method, scale_min, scale_max, num_clusters)


def branched_heatmap(cds: CellDataset, formula: str = "~sm.ns(Pseudotime, df=3)*Branch", norm_method: str = "log", scale_min: float = -3.0, scale_max: float = 3.0, num_clusters: int = 6, **branches) -> DataFrame:
    """The first branch backwards in columns 1 to 100, the second one in 101 to 200: both leave the middle."""
    c = trajectory.branch_curves(cds, formula, POINTS, **branches)
    both = c.select("gene_id", (POINTS - F.col("point_idx")).alias("column"), F.col("a").alias("value")).union(c.select("gene_id", POINTS + 1 + F.col("point_idx"), "b"))
    return _heatmap(cds, both, norm_method, scale_min, scale_max, num_clusters)


def branches_heatmap(cds: CellDataset, states: list[int], formula: str = "~sm.ns(Pseudotime, df=3)", norm_method: str = "log", scale_min: float = -3.0, scale_max: float = 3.0, num_clusters: int = 6) -> DataFrame:
    """Curves of the cells from the root to each state side by side, 100 columns each."""
    parts = []
    for i, s in enumerate(states):
        here = _on_branch(cds, s)
        one = cds.with_(cells=cds.cells.join(here, "cell_id", "left_semi"), expr=cds.expr.join(here, "cell_id", "left_semi"))
        last = one.cells.agg(F.max("Pseudotime")).first()[0]
        curves = models.smooth_curves(one, pd.DataFrame({"Pseudotime": np.linspace(0.0, last, POINTS)}), formula)
        parts.append(curves.select("gene_id", (F.col("point_idx") + 1 + POINTS * i).alias("column"), F.col("expectation").alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return _heatmap(cds, whole, norm_method, scale_min, scale_max, num_clusters)


# Middle, width of the top and width of the foot of each colour's trapezoid.
RAMP = {"red": (0.8, 0.2, 1.0), "green": (0.5, 0.4, 0.8), "blue": (0.2, 0.2, 1.0)}


def color_ramp(spark: SparkSession, n: int) -> DataFrame:
    """i from 0, red, green, blue from 0 to 1 and their hex: blue over green to red. Corners stand on whole steps."""
    i = F.col("i")
    shares = {}
    for name, (mid, top, foot) in RAMP.items():
        at = lambda x: round((n - 1) * x)
        rise, left, right, fall = at(mid - foot / 2), max(0, at(mid - top / 2)), min(n - 1, at(mid + top / 2)), at(mid + foot / 2)
        up, down = (i - rise) / max(left - rise, 1), (fall - i) / max(fall - right, 1)
        shares[name] = F.when(i.between(left, right), 1.0).otherwise(F.greatest(F.lit(0.0), F.when(i < left, up).otherwise(down)))
    frame = spark.range(n).select(F.col("id").cast("int").alias("i")).select("i", *(v.alias(k) for k, v in shares.items()))
    return frame.withColumn("hex", F.format_string("#%02X%02X%02X", *(F.round(F.col(k) * 255).cast("int") for k in RAMP)))
