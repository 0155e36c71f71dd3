"""The composed trajectory path, and operators on awkward data, against brute force and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dendrospark.functions.families import Family, family_from_name
from dendrospark.operators import census, cluster, differential, models, order, plots, preprocess, trajectory
from dendrospark.sources import CellDataset, from_frames, from_matrix, load, resolve_path, verify_sha256


@pytest.fixture(scope="module")
def branching(spark):
    """Cells on a Y: a trunk and two arms, some genes only on one arm."""
    rng = np.random.default_rng(1)
    t = np.tile(np.linspace(0, 1, 30), 3)
    arm = np.repeat([0, 1, 2], 30)
    at = np.stack([np.where(arm == 0, t, 1), np.select([arm == 1, arm == 2], [t, -t], 0.0)], axis=1)
    mean = np.clip(at @ rng.normal(0, 4, (2, 24)) + 12 + 30 * ((arm == 1) * t)[:, None] * (np.arange(24) < 5), 0.5, None)
    x = rng.poisson(mean).astype(float)
    cells = pd.DataFrame({"arm": arm}, index=[f"C{i:02d}" for i in range(90)])
    genes = pd.DataFrame({"gene_short_name": [f"g{i}" for i in range(24)]}, index=[f"G{i:02d}" for i in range(24)])
    cds = preprocess.with_dispersion(preprocess.estimate_size_factors(from_matrix(spark, x, cells, genes)), 0.05, 1.0)
    return cds.with_(cells=cds.cells.cache(), expr=cds.expr.cache())


@pytest.fixture(scope="module")
def ordered(branching):
    cds = trajectory.order_cells(trajectory.reduce_dimension(branching, ncenter=15))
    return cds.with_(cells=cds.cells.cache())


def test_reduction_and_order(ordered):
    graph = ordered.state("graph")
    assert graph.nodes.shape == (15, 2) and len(graph.edges) == 14
    cells = ordered.cells.toPandas()
    assert (cells.Pseudotime == 0).sum() == 1 and (cells.Parent == "").sum() == 1 and (cells.Pseudotime >= 0).all()
    first = ordered.state("ordering")["root_node"]
    assert len(graph.near()[first]) == 1
    other = trajectory.order_cells(ordered, reverse=True)
    assert other.state("ordering")["root_node"] == order.diameter(graph.near())[0] != first
    # a new root by state keeps the states
    state = int(cells.State.max())
    again = trajectory.order_cells(ordered, root_state=state)
    assert again.cells.join(ordered.cells.select("cell_id", F.col("State").alias("s")), "cell_id").where("State <> s").count() == 0
    with pytest.raises(RuntimeError):
        trajectory.order_cells(ordered, root_state=99)
    with pytest.raises(RuntimeError):
        trajectory.order_cells(ordered.with_(meta={}))
    with pytest.raises(ValueError):
        trajectory.reduce_dimension(ordered, reduction_method="ICA")


def on_y(cds):
    """The same cells on a given graph, so that branches are known."""
    ids = sorted(r.cell_id for r in cds.cells.select("cell_id").collect())
    closest = np.repeat([0, 1, 2, 3, 4, 5], 15)
    graph = trajectory.Graph(np.zeros((6, 2)), [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 5, 1.0)], ids, closest)
    known = pd.DataFrame({"cell_id": ids, "Pseudotime": np.where(np.arange(90) < 30, np.arange(90), np.where(np.arange(90) < 60, np.arange(90), np.arange(90) * 0.5 + 10.0)).astype(float), "State": np.repeat([1, 2, 3], 30)})
    cells = cds.cells.drop("Pseudotime", "State", "Parent").join(cds.cells.sparkSession.createDataFrame(known), "cell_id")
    return cds.with_(cells=cells.cache(), meta=cds.meta | {"graph": graph, "ordering": {"root_node": 0, "root_cell": ids[0], "branch_points": [1]}})


def test_branch_datasets(branching):
    cds = on_y(branching)
    split = trajectory.build_branch_cell_dataset(cds, branch_labels=["A", "B"]).cells.toPandas()
    assert len(split) == 91 and (split.cell_id == "duplicate_root").sum() == 1
    assert split[split.cell_id == "duplicate_root"].Branch.item() == "B" and split.Pseudotime.max() == 100
    turns = split[(split.State == 1) & (split.cell_id != "duplicate_root")].sort_values("Pseudotime").Branch.tolist()
    assert turns == ["A", "B"] * 15
    both = trajectory.build_branch_cell_dataset(cds, "duplicate", branch_states=[2, 3])
    assert both.cells.count() == 120 and both.expr.count() == cds.expr.count() + cds.expr.join(cds.cells.where("State = 1"), "cell_id").count()
    ends = both.cells.groupBy("Branch").agg(F.max("Pseudotime").alias("m")).toPandas()
    assert np.allclose(ends.m, 100)
    for bad in ({"branch_point": 2}, {"branch_states": [2, 9]}):
        with pytest.raises(RuntimeError):
            trajectory.build_branch_cell_dataset(cds, **bad)
    with pytest.raises(ValueError):
        trajectory.build_branch_cell_dataset(cds, "both")


def test_beam_ilrs_and_abcs_find_the_branch_genes(branching):
    cds = on_y(branching)
    tested = trajectory.beam(cds).toPandas().set_index("gene_id")
    assert (tested.status == "OK").all() and tested.pval.between(0, 1).all()
    assert (tested.loc[[f"G{i:02d}" for i in range(5)], "pval"] < 0.01).sum() >= 3
    plain = trajectory.beam(cds, full="~sm.ns(Pseudotime, df=3)", reduced="~1")
    assert plain.count() == 24
    curves = trajectory.branch_curves(cds, n_points=30).toPandas()
    ilr = trajectory.cal_ilrs(cds, n_points=30, limit=2.0).toPandas()
    both = curves.merge(ilr[["gene_id", "point_idx", "ilr", "norm_div"]], on=["gene_id", "point_idx"])
    assert np.allclose(both.ilr, np.clip(np.log2((both.a + 1) / (both.b + 1)), -2, 2))
    top = (both.a - both.b).abs().groupby(both.gene_id).transform("max")
    assert np.allclose(both.norm_div, (both.a - both.b) / top)
    abc = trajectory.cal_abcs(cds, num=30).toPandas().set_index("gene_id").ABCs
    for gene, part in both.sort_values("point_idx").groupby("gene_id"):
        d = (part.a - part.b).to_numpy()
        assert abs(abc[gene] - (0.5 * (d[1:] + d[:-1]) * 100 / 29).sum()) < 1e-3
    with pytest.raises(ValueError):
        trajectory.cal_abcs(cds, branch_states=[1, 2, 3])


def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (0, 10), (10, 0), (10, 10))])
    return x, spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "cell_id long, coords array<double>")


def test_cluster_cells(spark):
    x, points = blobs(spark)
    empty = spark.createDataFrame([], "cell_id long, gene_id string, value double")
    cds = CellDataset(empty, points.select("cell_id"), spark.createDataFrame([], "gene_id string"), meta={"X_dr": points})
    got = trajectory.cluster_cells(cds, rho_threshold=0.0, delta_threshold=5.0)
    cells = got.cells.orderBy("cell_id").toPandas()
    assert cells.Cluster.nunique() == 4 and all(cells.Cluster[60 * k : 60 * k + 60].nunique() == 1 for k in range(4))
    least = np.sort(cells.delta)[-4] - np.finfo(float).eps
    again = trajectory.cluster_cells(got, num_clusters=4, skip_rho_sigma=True).cells.where("peaks").count()
    assert again == ((cells.delta > least) & (cells.rho > 0)).sum()
    # the cutoff: the share of near pairs lies in the wanted range
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    dc = got.state("density_peak")["dc"]
    near = (d[np.triu_indices(240, 1)] < dc).sum()
    assert 0.01 <= ((near * 2 + 240) / 240 - 1) / 240 <= 0.02
    assert np.allclose(cells.rho, np.exp(-((d / dc) ** 2)).sum(axis=1) - 1)
    with pytest.raises(RuntimeError):
        trajectory.cluster_cells(cds, rho_threshold=1e9, delta_threshold=5.0)
    with pytest.raises(NotImplementedError):
        trajectory.cluster_cells(cds, method="louvain")


def test_unassigned_points_make_no_halo_and_are_adopted(spark):
    rows = [(0, [0.0], 5.0, 1), (1, [0.1], 4.0, 1), (2, [0.2], 3.0, -1), (3, [0.3], 2.0, -1)]
    points = spark.createDataFrame(rows, "cell_id long, coords array<double>, rho double, cluster int")
    assert cluster.halo(points, 1.0).where("halo").count() == 0
    assert {r.cell_id: r.cluster for r in cluster.adopt(points).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    two = spark.createDataFrame([(0, [0.0], 5.0, 1), (1, [0.1], 1.0, 1), (2, [0.2], 4.0, 2)], points.schema)
    got = {r.cell_id: r.halo for r in cluster.halo(two, 1.0).collect()}
    assert got == {0: False, 1: True, 2: True}  # the border is (5 + 4) / 2 on both sides


def test_size_factors_of_an_empty_cell(spark):
    cds = from_frames(spark.createDataFrame([("a", "g", 4.0), ("b", "g", 9.0)], "cell_id string, gene_id string, value double"), spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string"))
    got = {r.cell_id: r.size_factor for r in preprocess.size_factors(cds).collect()}
    assert got == {"a": math.inf, "b": math.inf, "c": 1.0}
    assert preprocess.size_factors(cds, "geometric-mean-total").count() == 3


def test_gaussian_test_of_a_gene_without_deviations(spark):
    rows = [(i, "flat", 2.0) for i in range(8)] + [(i, "some", float(i % 4)) for i in range(8)]
    cells = spark.createDataFrame([(i, i % 2, 1.0) for i in range(8)], "cell_id int, g int, size_factor double")
    cds = from_frames(spark.createDataFrame(rows, "cell_id int, gene_id string, value double"), cells)
    got = {r.gene_id: r for r in differential.group_lrt(cds, "g", "gaussian").collect()}
    assert got["flat"].pval == got["flat"].qval == 1.0 and got["some"].pval < 1


def test_chi2_tail_of_any_whole_df(spark):
    def tail(x, df):  # by series of the lower incomplete gamma function
        a, s, term = df / 2, 0.0, 1.0 / math.gamma(df / 2 + 1)
        for k in range(400):
            s += term
            term *= (x / 2) / (a + k + 1)
        return 1 - s * (x / 2) ** a * math.exp(-x / 2)

    rows = [(x, d) for x in (0.3, 2.0, 9.0) for d in range(1, 13)]
    got = spark.createDataFrame(rows, "x double, d long").select("x", "d", differential.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect()
    assert all(abs(r.p - tail(r.x, r.d)) < 1e-6 for r in got)


def test_census_gives_cells_without_values_one(spark):
    x = [("a", f"g{i}", float(v)) for i, v in enumerate([1, 1.1, 1.2, 5])]
    cds = from_frames(spark.createDataFrame(x, "cell_id string, gene_id string, value double"), spark.createDataFrame([("a",), ("b",)], "cell_id string"))
    got = {r.cell_id: r.t for r in census.estimate_t(cds).collect()}
    assert got["b"] == 1.0 and 1 < got["a"] < 1.3


def test_residuals_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"cell_id": range(20), "b": rng.choice(["x", "y", "z"], 20), "t": rng.normal(size=20)})
    y = rng.normal(size=20)
    x = spark.createDataFrame([(int(i), "g", float(v)) for i, v in enumerate(y)], "cell_id int, gene_id string, value double")
    got = trajectory.residuals(x, spark.createDataFrame(frame), "~b + t").orderBy("cell_id").toPandas().value
    d = np.column_stack([np.ones(20), frame.b == "y", frame.b == "z", frame.t]).astype(float)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert np.allclose(got, y - d[:, 1:] @ beta[1:])


def test_sources_check_shapes_and_repeats(spark, tmp_path):
    with pytest.raises(TypeError):
        from_matrix(spark, "text")
    with pytest.raises(ValueError):
        from_matrix(spark, np.ones((2, 2)), pd.DataFrame(index=["a"]))
    twice = spark.createDataFrame([("a", "g", 1.0), ("a", "g", 2.0)], "cell_id string, gene_id string, value double")
    with pytest.raises(ValueError):
        from_frames(twice)
    assert from_frames(twice, repeats="sum").expr.first().value == 3.0
    (tmp_path / "f.txt").write_text("x")
    assert resolve_path(spark, "f.txt", str(tmp_path)).endswith("f.txt")
    with pytest.raises(FileNotFoundError):
        resolve_path(spark, "no.txt", str(tmp_path))
    with pytest.raises(RuntimeError):
        verify_sha256(spark, str(tmp_path / "f.txt"), "00")
    assert not (tmp_path / "f.txt").exists()


def test_state_survives_a_round_trip(ordered, spark, tmp_path):
    ordered.save(str(tmp_path / "cds"))
    back = load(spark, str(tmp_path / "cds"))
    assert back.state("X_dr").count() == 90 and back.state("graph").edges == [(int(i), int(j), float(w)) for i, j, w in ordered.state("graph").edges]
    assert back.state("ordering")["root_node"] == ordered.state("ordering")["root_node"] and back.family == Family()
    with pytest.raises(KeyError):
        back.state("nothing")


def test_families():
    assert family_from_name("tobit", lower=0.1).params() == {"lower": 0.1, "upper": math.inf}
    assert models._alpha(np.ones(3), None, family_from_name("negbinomial")) == 1.0
    for name, error in (("gaussianff", ValueError), ("what", ValueError)):
        with pytest.raises(error):
            family_from_name(name)
    with pytest.raises(TypeError):
        family_from_name("uninormal", lower=1)


def test_a_large_limit_of_cells_takes_no_memory(branching, monkeypatch):
    cds = on_y(branching)
    few = cds.genes.orderBy("gene_id").limit(1).select("gene_id")
    monkeypatch.setattr(models, "MOST_CELLS", 10**9)
    assert plots.genes_in_pseudotime(cds, few).count() == 90
    monkeypatch.setattr(models, "MOST_CELLS", 89)
    with pytest.raises(ValueError, match="more cells"):
        plots.genes_in_pseudotime(cds, few)


def test_plot_frames(branching, ordered, spark):
    cds = on_y(branching)
    at = plots.trajectory_points(ordered, 90.0).toPandas().set_index("cell_id")
    z = ordered.state("X_dr").toPandas().set_index("cell_id").coords
    assert np.allclose(at.x, [-z[c][1] for c in at.index]) and np.allclose(at.y, [z[c][0] for c in at.index])
    lines, marks = plots.trajectory_segments(ordered)
    assert lines.count() == 14 and marks.count() == len(ordered.state("graph").branch_points())
    layout = plots.tree_layout(cds).toPandas()
    assert layout.y.min() == -3 and len(layout) == 90
    few = cds.genes.orderBy("gene_id").limit(2).select("gene_id")
    long = plots.genes_in_pseudotime(cds, few).toPandas()
    assert len(long) == 180 and (long.expression >= 0.1).all() and (long.expectation >= 0.1).all()
    smooth = plots.branches_in_pseudotime(cds, few, [2, 3]).toPandas()
    assert set(smooth.Branch) == {"2", "3"} and smooth.Pseudotime.min() == 0 and abs(smooth.Pseudotime.max() - 100) < 1e-9
    heat = plots.branched_heatmap(cds, num_clusters=3).toPandas()
    assert heat.cluster.nunique() == 3 and heat.value.between(-3, 3).all() and heat.column.nunique() == 200
    with pytest.raises(KeyError):
        plots.pseudotime_heatmap(cds.with_(meta={}), norm_method="vstExprs")
    ramp = plots.color_ramp(spark, 62).toPandas()
    assert len(ramp) == 62 and ramp.hex.str.fullmatch("#[0-9A-F]{6}").all()
