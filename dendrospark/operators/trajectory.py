"""The trajectory path on a dataset: reduce, cluster, order, split at a branch, test and compare branches.

Matrices, pairs of cells and per-gene fits stay in Spark.  The principal graph has few nodes and lives in ``meta["graph"]`` on the driver, as do the
cells' coordinates where a method needs them together (at most ``reduce.MOST_POINTS`` cells, checked; more raise an error).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import Design, formula_terms
from ..sources.dataset import CellDataset
from ..store import cut, drop
from . import cluster, models, normalize, order, plotdata, preprocess, reduce

#: Up to so many entries of a genes x cells matrix DDRTree runs on the driver; above, Spark sums what it needs of the cells.
DRIVER_ENTRIES = 2_000_000


@dataclass(frozen=True)
class Graph:
    """A principal graph: nodes (n x d), tree edges (i, j, length), and each cell's nearest node, by cell_id in rising order."""

    nodes: np.ndarray
    edges: list[tuple[int, int, float]]
    cell_ids: list
    closest: np.ndarray

    def near(self) -> list[dict[int, float]]:
        return order.adjacency(len(self.nodes), self.edges)

    def branch_points(self) -> list[int]:
        return [i for i, x in enumerate(self.near()) if len(x) > 2]

    def frames(self, like: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes(node, coords), edges(src, dst, weight) and cells(cell_id, node)."""
        spark = like.sparkSession
        kind = like.schema["cell_id"].dataType.simpleString()
        nodes = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(self.nodes)], "node long, coords array<double>")
        edges = spark.createDataFrame([(int(i), int(j), float(w)) for i, j, w in self.edges], "src long, dst long, weight double")
        cells = spark.createDataFrame(pa.table({"cell_id": pa.array(self.cell_ids), "node": pa.array(np.asarray(self.closest, dtype=np.int64))}))
        return nodes, edges, cells.select(F.col("cell_id").cast(kind).alias("cell_id"), "node")


def _coords(cds: CellDataset) -> tuple[list, np.ndarray]:
    got = cds.state("X_dr").select("cell_id", "coords").limit(reduce.MOST_POINTS + 1).toArrow().sort_by("cell_id")
    if len(got) > reduce.MOST_POINTS:
        raise ValueError("too many cells for a tree on the driver")
    flat = got.column("coords").combine_chunks()
    return got.column("cell_id").to_pylist(), flat.flatten().to_numpy().reshape(len(got), -1)


def _coords_frame(like: DataFrame, ids: list, z: np.ndarray) -> DataFrame:
    kind = like.schema["cell_id"].dataType.simpleString()
    return like.sparkSession.createDataFrame([(c, [float(v) for v in x]) for c, x in zip(ids, z, strict=True)], f"cell_id {kind}, coords array<double>")


# ---- reduce


def residuals(x: DataFrame, cells: DataFrame, formula: str) -> DataFrame:
    """Ordinary least squares of every gene on any formula over cells; all but the intercept's part is taken off.

    The coefficients need each gene's products with the design's columns, one aggregate; the design of the cells is joined by cell_id.
    """
    names = formula_terms(formula)
    frame = cells.select("cell_id", *names).limit(models.MOST_CELLS + 1).orderBy("cell_id").toPandas()
    if len(frame) > models.MOST_CELLS:
        raise ValueError("more cells than a broadcast design may have")
    design = np.asarray(Design(formula).matrix(frame), dtype=float)
    gram = np.linalg.pinv(design.T @ design)
    kind = cells.schema["cell_id"].dataType.simpleString()
    rows = cells.sparkSession.createDataFrame([(c, r.tolist()) for c, r in zip(frame["cell_id"].tolist(), design, strict=True)], f"cell_id {kind}, d array<double>")
    wide = x.join(rows, "cell_id")
    k = design.shape[1]
    sums = wide.groupBy("gene_id").agg(*(F.sum(F.col("value") * F.col("d")[i]).alias(f"s{i}") for i in range(k)))
    beta = F.array(*(sum((F.col(f"s{i}") * float(gram[j, i]) for i in range(k)), F.lit(0.0)) for j in range(1, k)))
    off = F.aggregate(F.zip_with("beta", F.slice("d", 2, k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) if k > 1 else F.lit(0.0)
    return wide.join(sums.select("gene_id", beta.alias("beta") if k > 1 else F.array().alias("beta")), "gene_id").select("cell_id", "gene_id", (F.col("value") - off).alias("value"))


def reduction_matrix(cds: CellDataset, norm_method: str = "log", residual_formula: str | None = None, pseudo_expr: float = 1.0, relative_expr: bool = True, scaling: bool = True) -> DataFrame:
    """cell_id, gene_id, value as a reduction sees it: normalised, without constant genes, without batch effects, scaled, finite."""
    x = normalize.normalize_expr(cds, norm_method, pseudo_expr, relative_expr)
    if cds.family.vfamily == "binomialff":  # the sparse form: absent entries are zeros
        genes = x.select("gene_id").distinct()
        x = cds.with_(expr=x, genes=genes).dense(genes)
    x = normalize.drop_zero_sd(x)
    if residual_formula is not None:
        x = residuals(x, cds.cells, residual_formula)
    return normalize.drop_nonfinite(normalize.zscore(x) if scaling else x)


def reduce_dimension(cds: CellDataset, max_components: int = 2, reduction_method: str = "DDRTree", norm_method: str = "log", residual_formula: str | None = None, pseudo_expr: float = 1.0, relative_expr: bool = True, auto_param_selection: bool = True, scaling: bool = True, num_dim: int = 50, random_state: int = 2016, **more) -> CellDataset:
    """Adds ``X_dr`` (cell_id, coords), for DDRTree also ``graph`` and ``ddrtree`` (W, objective, genes)."""
    if reduction_method not in ("DDRTree", "tSNE"):
        raise ValueError(f"no reduction method {reduction_method!r}")
    x = cut(reduction_matrix(cds, norm_method, residual_formula, pseudo_expr, relative_expr, scaling), "reduction")
    n_cells, n_genes = cds.cells.count(), x.select("gene_id").distinct().count()
    if not n_genes:
        raise RuntimeError("no gene varies between cells")
    if reduction_method == "tSNE":
        k = min(num_dim, n_genes, n_cells)
        if n_cells > reduce.EXACT_TSNE and max_components == 2:
            genes = sorted(r[0] for r in x.select("gene_id").distinct().limit(reduce.MOST_GENES + 1).collect())
            if len(genes) > reduce.MOST_GENES:
                raise ValueError("more genes than a covariance on the driver may have")
            ids, z = reduce.tsne_of(reduce.pca_of(reduce.packed(x, genes, n_cells), len(genes), k), seed=random_state, **more)
            return cds.with_(meta=cds.meta | {"X_dr": _coords_frame(cds.cells, ids, z), "reduction": "tSNE"})
        got = reduce.pca(x, k)[0].orderBy("cell_id").limit(5001).toPandas()
        z = reduce.tsne(np.array(got["coords"].tolist()), max_components, seed=random_state, **more)
        return cds.with_(meta=cds.meta | {"X_dr": _coords_frame(cds.cells, got["cell_id"].tolist(), z), "reduction": "tSNE"})
    if auto_param_selection and "ncenter" not in more and n_cells >= 100:
        more["ncenter"] = preprocess.cal_ncenter(n_cells)
    if n_cells * n_genes > DRIVER_ENTRIES:
        genes = sorted(r[0] for r in x.select("gene_id").distinct().limit(reduce.MOST_GENES + 1).collect())
        if len(genes) > reduce.MOST_GENES or n_cells > reduce.MOST_POINTS:
            raise ValueError("more genes or cells than DDRTree's matrices may have")
        table = reduce.packed(x, genes, n_cells)
        drop(x)
        fit = reduce.ddrtree_of(table, len(genes), max_components, seed=random_state, **more)
        drop(table)
        near = fit["cells"].select("cell_id", "node").toArrow().sort_by("cell_id")
        graph = Graph(fit["Y"].T, fit["edges"], near.column("cell_id").to_pylist(), near.column("node").to_numpy())
        kept = {"W": fit["W"].tolist(), "objective": fit["objective"], "genes": genes}
        return cds.with_(meta=cds.meta | {"X_dr": fit["cells"].select("cell_id", "coords"), "graph": graph, "ddrtree": kept, "reduction": "DDRTree"})
    wide = x.toPandas().pivot(index="gene_id", columns="cell_id", values="value").sort_index().sort_index(axis=1)
    drop(x)
    fit = reduce.ddrtree(wide.to_numpy(), max_components, seed=random_state, **more)
    graph = Graph(fit["Y"].T, fit["edges"], wide.columns.tolist(), fit["closest"])
    kept = {"W": fit["W"].tolist(), "objective": [float(v) for v in fit["objective"]], "genes": wide.index.tolist()}
    return cds.with_(meta=cds.meta | {"X_dr": _coords_frame(cds.cells, graph.cell_ids, fit["Z"].T), "graph": graph, "ddrtree": kept, "reduction": "DDRTree"})


# ---- cluster


def cluster_cells(cds: CellDataset, num_clusters: int | None = None, rho_threshold: float | None = None, delta_threshold: float | None = None, peaks: DataFrame | None = None, gaussian: bool = True, skip_rho_sigma: bool = False, method: str = "densityPeak") -> CellDataset:
    """Adds Cluster, peaks, halo, rho, delta and nearest to cells, and the cutoff and thresholds to ``density_peak``.

    Peaks: the given cells, or those over both thresholds, which are the given ones, or the num_clusters-th largest delta, or the 95 % points. Cells
    that no peak reaches take the cluster of the nearest cell that has one.
    """
    if method != "densityPeak":
        raise NotImplementedError(f"clustering by {method!r} is not supported")
    if "X_dr" not in cds.meta:
        raise RuntimeError("reduce_dimension comes before cluster_cells")
    points, known = cds.state("X_dr"), cds.meta.get("density_peak", {})
    columns = ("rho", "delta", "nearest", "has_denser")
    if skip_rho_sigma and "dc" in known and set(columns) <= set(cds.cells.columns):
        dc, near = known["dc"], points.join(cds.cells.select("cell_id", *columns), "cell_id")
    else:
        dc = cluster.estimate_dc(points)
        dense = cut(points.join(cluster.local_density(points, dc, gaussian), "cell_id"), "density")
        near = dense.join(cluster.nearest_denser(dense), "cell_id")
    near = cut(near, "density")
    if num_clusters is not None and (rho_threshold is None or delta_threshold is None):
        rho_threshold = 0.0
        top = [r.delta for r in near.orderBy(F.desc("delta")).limit(num_clusters).select("delta").collect()]
        # the machine's epsilon is lost on a large delta: the strict comparison then leaves fewer peaks, as the reference has it
        delta_threshold = top[-1] - float(np.finfo(float).eps)
    elif rho_threshold is None or delta_threshold is None:
        rho_threshold, delta_threshold = near.agg(F.percentile("rho", 0.95), F.percentile("delta", 0.95)).first()
    if peaks is None:
        marked = near.withColumn("peaks", (F.col("rho") > rho_threshold) & (F.col("delta") > delta_threshold))
    else:
        chosen = peaks.select("cell_id").distinct().withColumn("peaks", F.lit(True))
        marked = near.join(chosen, "cell_id", "left").withColumn("peaks", F.coalesce("peaks", F.lit(False)))
    if not marked.where("peaks").limit(1).count():
        raise RuntimeError("no cell is a density peak; lower the thresholds")
    named = cut(cluster.follow_peaks(marked), "clusters")
    edge = cluster.halo(named, dc)
    whole = cluster.adopt(named).join(edge, "cell_id")
    out = whole.select("cell_id", F.col("cluster").cast("string").alias("Cluster"), "peaks", "halo", *columns)
    cells = cds.cells.drop("Cluster", "peaks", "halo", *columns).join(out, "cell_id", "left")
    return cds.with_(cells=cells, meta=cds.meta | {"density_peak": {"dc": float(dc), "rho": float(rho_threshold), "delta": float(delta_threshold)}})


# ---- order


def _root_of_state(cds: CellDataset, graph: Graph, z: np.ndarray, root_state: int, reverse: bool) -> int:
    """The node of one end of the state's own longest path: the early end if the state holds the last root or on request, else the late end."""
    if not {"State", "Pseudotime"} <= set(cds.cells.columns):
        raise RuntimeError("order the cells without a root state first")
    known = cds.cells.select("cell_id", "State", "Pseudotime").orderBy("cell_id").toPandas()
    inside = np.flatnonzero(known["State"].to_numpy() == root_state)
    if not len(inside):
        raise RuntimeError(f"no cell is in state {root_state}")
    if len(inside) == 1:
        return int(graph.closest[inside[0]])
    walk = inside[order.diameter(order.adjacency(len(inside), reduce.minimum_spanning_tree(z[inside])))]
    at = known["Pseudotime"].to_numpy()[walk]
    last = cds.meta.get("ordering", {}).get("root_node")
    early = reverse or (last is not None and bool((known["State"].to_numpy()[graph.closest == last] == root_state).any()))
    return int(graph.closest[walk[at.argmin() if early else at.argmax()]])


def order_cells(cds: CellDataset, root_state: int | None = None, reverse: bool = False) -> CellDataset:
    """Adds Pseudotime, State and Parent to cells. A new root leaves the states of an earlier call as they are."""
    if "reduction" not in cds.meta:
        raise RuntimeError("reduce_dimension comes before order_cells")
    if cds.meta["reduction"] != "DDRTree":
        raise NotImplementedError(f"cells can't be ordered on {cds.meta['reduction']!r}")
    graph: Graph = cds.state("graph")
    ids, z = _coords(cds)
    root = None if root_state is None else _root_of_state(cds, graph, z, root_state, reverse)
    if root is None:
        ends = order.diameter(graph.near())
        root = ends[0] if reverse else ends[-1]
    found = order.order_cells(cds.expr.sparkSession, ids, z, graph.nodes, graph.edges, graph.closest, root=root)
    keep = root_state is not None and "State" in cds.cells.columns
    cells = cds.cells.drop("Pseudotime", "Parent", *([] if keep else ["State"])).join(found.drop("State") if keep else found, "cell_id", "left")
    first = found.where("Parent = ''").first()["cell_id"]
    return cds.with_(cells=cells, meta=cds.meta | {"ordering": {"root_node": root, "root_cell": first, "branch_points": graph.branch_points()}})


# ---- branches


def branch_nodes(cds: CellDataset, branch_states: list[int] | None = None, branch_point: int = 1) -> dict[str, set[int]]:
    """The nodes of two branches, each with its way from the root: towards a tip of each state, or beyond the k-th branch point by pseudotime."""
    graph: Graph = cds.state("graph")
    near = graph.near()
    known = cds.cells.select("cell_id", "State", "Pseudotime").orderBy("cell_id").toPandas()
    state, pt = known["State"].to_numpy(), known["Pseudotime"].to_numpy()

    def tip(mask: np.ndarray) -> int:
        nodes = sorted(set(graph.closest[mask].tolist()))
        return next((v for v in nodes if len(near[v]) == 1), nodes[0])

    root_state = state[known["cell_id"].tolist().index(cds.state("ordering")["root_cell"])]
    root = tip(state == root_state)
    parent = order.distances_from(near, root)[1]
    if branch_states is not None:
        if any(not (state == s).any() for s in branch_states):
            raise RuntimeError(f"some of the states {branch_states} have no cell")
        out = {str(s): set(order.path(parent, tip(state == s))) for s in branch_states}
    else:
        points = graph.branch_points()
        if not 1 <= branch_point <= len(points):
            raise RuntimeError(f"branch point {branch_point} is asked for and there are {len(points)}")
        earliest = {v: np.min(pt[graph.closest == v], initial=np.inf) for v in points}
        node = sorted(points, key=lambda v: (earliest[v], v))[branch_point - 1]
        trunk = set(order.path(parent, node))
        out = {f"Y_{u + 1}": trunk | order.component(near, u, node) for u in near[node] if u not in trunk}
    if len(out) != 2:
        raise RuntimeError(f"a branch analysis needs exactly 2 branches, here are {len(out)}")
    return out


def build_branch_cell_dataset(cds: CellDataset, progenitor_method: str = "sequential_split", branch_states: list[int] | None = None, branch_point: int = 1, branch_labels: list[str] | None = None, stretch: bool = True) -> CellDataset:
    """The cells of two branches with columns Branch and original_cell_id (cell_id becomes a string) and stretched Pseudotime.

    Cells before the split are on both branches as copies (duplicate), or take turns by pseudotime (sequential_split), the first one on the second branch too as
    ``duplicate_root``.
    """
    if progenitor_method not in ("duplicate", "sequential_split"):
        raise ValueError(f"no progenitor method {progenitor_method!r}")
    if not {"State", "Pseudotime"} <= set(cds.cells.columns):
        raise RuntimeError("order_cells comes before a branch dataset")
    paths = branch_nodes(cds, branch_states, branch_point)
    labels = list(paths) if branch_labels is None else [str(b) for b in branch_labels]
    if len(labels) != 2:
        raise RuntimeError("two branches need two labels")
    graph: Graph = cds.state("graph")
    one, two = paths.values()
    where = graph.frames(cds.cells)[2]
    side = F.when(F.col("node").isin(sorted(one & two)), 0).when(F.col("node").isin(sorted(one)), 1).when(F.col("node").isin(sorted(two)), 2)
    cells = cds.cells.join(where.withColumn("_side", side).where("_side is not null").select("cell_id", "_side"), "cell_id").cache()
    if not cells.where("_side = 0").limit(1).count():
        raise RuntimeError("the two branches share no cell on the way from the root")
    if stretch:
        top = {r["_side"]: r["m"] for r in cells.groupBy("_side").agg(F.max("Pseudotime").alias("m")).collect()}
        longest, split = max(top.values()), top[0]
        own = F.col("Pseudotime")
        for s in (1, 2):
            # a branch whose last cell is a shared one isn't stretched
            end = max(top.get(s, split), split)
            factor = (longest - split) / (end - split) if end != split else 1.0
            own = F.when(F.col("_side") == s, split + (F.col("Pseudotime") - split) * factor).otherwise(own)
        cells = cells.withColumn("Pseudotime", own * (100.0 / longest) if longest > 0 else own)
    cells = cells.withColumn("original_cell_id", F.col("cell_id"))
    label = F.when(F.col("_side") == 1, labels[0]).when(F.col("_side") == 2, labels[1])
    rest = cells.where("_side > 0").withColumn("Branch", label).withColumn("cell_id", F.col("cell_id").cast("string"))
    turn = F.row_number().over(Window.orderBy(*(["cell_id"] if progenitor_method == "duplicate" else ["Pseudotime", "cell_id"])))
    shared = cells.where("_side = 0").withColumn("_k", turn)
    if progenitor_method == "duplicate":
        copies = [shared.withColumn("Branch", F.lit(b)).withColumn("cell_id", F.concat(F.lit(f"duplicate_{i}_"), F.col("_k").cast("string"))) for i, b in enumerate(labels, 1)]
    else:
        own = shared.withColumn("Branch", F.when(F.col("_k") % 2 == 1, labels[0]).otherwise(labels[1])).withColumn("cell_id", F.col("cell_id").cast("string"))
        copies = [own, shared.where("_k = 1").withColumn("Branch", F.lit(labels[1])).withColumn("cell_id", F.lit("duplicate_root"))]
    whole = rest.unionByName(copies[0].drop("_k")).unionByName(copies[1].drop("_k")).drop("_side")
    names = whole.select("cell_id", F.col("original_cell_id").alias("_o"))
    expr = cds.expr.withColumnRenamed("cell_id", "_o").join(names, "_o").select("cell_id", "gene_id", "value")
    return cds.with_(expr=expr, cells=whole, meta=cds.meta | {"branches": labels})


def branch_test(cds: CellDataset, full: str = "~sm.ns(Pseudotime, df=3)*Branch", reduced: str = "~sm.ns(Pseudotime, df=3)", relative_expr: bool = True, **branches) -> DataFrame:
    """The likelihood-ratio test on the branch dataset, or on the dataset as it is if the full formula has no Branch."""
    data = build_branch_cell_dataset(cds, **branches) if "Branch" in formula_terms(full) and "Branch" not in cds.cells.columns else cds
    return models.differential_gene_test(data, full, reduced, relative_expr)


def beam(cds: CellDataset, full: str = "~sm.ns(Pseudotime, df=3)*Branch", reduced: str = "~sm.ns(Pseudotime, df=3)", **more) -> DataFrame:
    """status, family, pval, qval of every gene and the gene columns."""
    return branch_test(cds, full, reduced, **more)


def branch_curves(cds: CellDataset, formula: str = "~sm.ns(Pseudotime, df=3)*Branch", n_points: int = 100, branch_states: list[int] | None = None, relative_expr: bool = True, **branches) -> DataFrame:
    """gene_id, point_idx, pseudotime, a, b: fitted curves of the two branches on a grid from 0 to the last pseudotime."""
    if branch_states is not None and len(branch_states) != 2:
        raise ValueError("curves compare two branches")
    data = build_branch_cell_dataset(cds, "duplicate", branch_states, **branches)
    labels = data.meta["branches"]
    name = next((v for v in formula_terms(formula) if v in data.cells.columns and v != "Pseudotime"), "Branch")
    grid = np.linspace(0.0, float(data.cells.agg(F.max("Pseudotime")).first()[0]), n_points)
    new = pd.DataFrame({"Pseudotime": np.tile(grid, 2), name: pd.Categorical(np.repeat(labels, n_points), categories=labels)})
    curves = models.smooth_curves(data, new, formula, relative_expr)
    at = F.col("point_idx") % n_points
    side = lambda k: F.max(F.when(F.floor(F.col("point_idx") / n_points) == k, F.col("expectation")))
    pt = F.element_at(F.array(*(F.lit(float(v)) for v in grid)), F.col("point_idx") + 1) if n_points <= 1000 else F.col("point_idx") * F.lit(float(grid[-1] / max(n_points - 1, 1)))
    got = curves.groupBy("gene_id", at.alias("point_idx")).agg(side(0).alias("a"), side(1).alias("b"))
    return got.select("gene_id", "point_idx", pt.alias("pseudotime"), "a", "b")


def cal_ilrs(cds: CellDataset, formula: str = "~sm.ns(Pseudotime, df=3)*Branch", limit: float = 3.0, use_vst: bool = False, output_type: str = "all", n_points: int = 100, branch_states: list[int] | None = None, **more) -> DataFrame:
    """gene_id, point_idx, ilr (log ratio of the branches, held within the limit) and the further frames' columns: a, b, raw_div, norm_div, norm_ilr.

    after_bifurcation starts at the first pseudotime of the two states.
    """
    c = branch_curves(cds, formula, n_points, branch_states, **more)
    if use_vst:
        fit = cds.state("dispersion")["blind"]
        ratio = preprocess.vst(F.col("a"), fit["asymptDisp"], fit["extraPois"]) - preprocess.vst(F.col("b"), fit["asymptDisp"], fit["extraPois"])
    else:
        ratio = F.log2((F.col("a") + 1) / (F.col("b") + 1))
    held = F.when(F.isnan(ratio), ratio).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), ratio)))
    gene = Window.partitionBy("gene_id")
    most = lambda v: F.max(F.when(~F.isnan(v), F.abs(v))).over(gene)
    c = c.withColumn("ilr", held).withColumn("raw_div", F.col("a") - F.col("b")).withColumn("_log", F.log2((F.col("a") + 0.1) / (F.col("b") + 0.1)))
    c = c.withColumn("norm_div", F.try_divide("raw_div", most(F.col("raw_div")))).withColumn("norm_ilr", F.try_divide("ilr", most(F.col("_log")))).drop("_log")
    if output_type == "after_bifurcation":
        states = [str(s) for s in branch_states or []]
        start = cds.cells.where(F.col("State").cast("string").isin(states)).agg(F.min("Pseudotime")).first()[0] if states else None
        last = c.agg(F.max("pseudotime")).first()[0]
        if start is not None and last:
            c = c.where(F.col("point_idx") >= max(0, min(int(100 * start / last), n_points - 1)))
    return c


def cal_abcs(cds: CellDataset, formula: str = "~sm.ns(Pseudotime, df=3)*Branch", num: int = 5000, branch_states: list[int] | None = None, **more) -> DataFrame:
    """gene_id, ABCs (area between the branches' curves, three decimals) and the gene columns."""
    area = plotdata.area_between(branch_curves(cds, formula, num, branch_states, **more))
    return area.withColumnRenamed("abc", "ABCs").join(cds.genes, "gene_id", "left")
