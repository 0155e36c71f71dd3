"""The cells x genes dataset as DataFrames, and its sources and sinks.

``expr(cell_id, gene_id, value)`` holds the stored entries; an absent one is 0.  ``cells`` and ``genes`` are keyed by
``cell_id`` and ``gene_id`` and may carry any columns.  A dataset is immutable: operators return a new one.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import Family, family_from_name


#: Genes that a broadcast may have.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class CellDataset:
    expr: DataFrame
    cells: DataFrame
    genes: DataFrame
    family: Family = field(default_factory=Family)
    lower_detection_limit: float = 0.1
    meta: dict = field(default_factory=dict)

    def with_(self, **changes) -> CellDataset:
        return replace(self, **changes)

    def state(self, key: str):
        """Typed access to fitted state; as the reference, missing state is a KeyError."""
        if key not in self.meta:
            raise KeyError(f"{key!r} is not set; run the operator that fits it first")
        return self.meta[key]

    def dense(self, genes: DataFrame | None = None) -> DataFrame:
        """Every (cell, gene) of the given genes with absent entries as 0.0. The grid is as large as it says: give few genes."""
        chosen = (self.genes if genes is None else genes).select("gene_id").distinct().cache()
        # each cell is repeated for every gene in any case; the list itself is broadcast only up to a checked length
        few = chosen.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        grid = self.cells.select("cell_id").crossJoin(F.broadcast(chosen) if few else chosen)
        return grid.join(self.expr, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def save(self, path: str) -> None:
        for name in ("expr", "cells", "genes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        plain, tables = {}, []
        for k, v in self.meta.items():
            if isinstance(v, DataFrame):
                v.write.mode("overwrite").parquet(f"{path}/meta-{k}.parquet")
                tables.append(k)
            elif k == "graph":
                plain[k] = {"nodes": v.nodes.tolist(), "edges": [[int(i), int(j), float(w)] for i, j, w in v.edges], "cell_ids": v.cell_ids, "closest": v.closest.tolist()}
            else:
                plain[k] = v
        state = {"family": self.family.vfamily, "params": self.family.params(), "limit": self.lower_detection_limit, "meta": plain, "tables": tables}
        spark = self.expr.sparkSession
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(f"{path}/state.parquet")


def load(spark: SparkSession, path: str) -> CellDataset:
    state = json.loads(spark.read.parquet(f"{path}/state.parquet").first()[0])
    frames = [spark.read.parquet(f"{path}/{n}.parquet") for n in ("expr", "cells", "genes")]
    meta = state["meta"] | {k: spark.read.parquet(f"{path}/meta-{k}.parquet") for k in state["tables"]}
    if "graph" in meta:
        from ..operators.trajectory import Graph

        g = meta["graph"]
        meta["graph"] = Graph(np.array(g["nodes"]), [tuple(e) for e in g["edges"]], g["cell_ids"], np.array(g["closest"]))
    return CellDataset(*frames, family_from_name(state["family"], **state["params"]), state["limit"], meta)


def from_frames(expr: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None, lower_detection_limit: float = 0.1, family: Family | None = None, repeats: str = "error") -> CellDataset:
    """A dataset of long entries. A repeated (cell, gene) is a ValueError, or summed with repeats="sum"; so is a repeated or unknown cell or gene."""
    if repeats not in ("error", "sum"):
        raise ValueError(f"repeats may be error or sum, not {repeats!r}")
    if repeats == "error":
        for frame, keys in ((expr, ["cell_id", "gene_id"]), (cells, ["cell_id"]), (genes, ["gene_id"])):
            if frame is not None and frame.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ValueError(f"{' and '.join(keys)} must be unique")
        for frame, key in ((cells, "cell_id"), (genes, "gene_id")):
            if frame is not None and expr.join(frame, key, "left_anti").limit(1).count():
                raise ValueError(f"entries name a {key} that its table doesn't have")
    cells = expr.select("cell_id").distinct() if cells is None else cells
    genes = expr.select("gene_id").distinct() if genes is None else genes
    if "gene_short_name" not in genes.columns:
        genes = genes.withColumn("gene_short_name", F.col("gene_id").cast("string"))
    if "size_factor" not in cells.columns:
        cells = cells.withColumn("size_factor", F.lit(float("nan")))
    expr = expr.groupBy("cell_id", "gene_id").agg(F.sum(F.col("value").cast("double")).alias("value"))
    return CellDataset(expr, cells, genes, family or Family(), lower_detection_limit)


def from_wide(wide: DataFrame, id_column: str = "cell_id", **more) -> CellDataset:
    """One row per cell, one column per gene."""
    genes = [c for c in wide.columns if c != id_column]
    long = wide.unpivot([id_column], genes, "gene_id", "value").where("value <> 0").withColumnRenamed(id_column, "cell_id")
    return from_frames(long, wide.select(F.col(id_column).alias("cell_id")), wide.sparkSession.createDataFrame([(g,) for g in genes], "gene_id string"), **more)


def from_matrix(spark: SparkSession, matrix, cells: pd.DataFrame | None = None, genes: pd.DataFrame | None = None, **more) -> CellDataset:
    """Cells x genes from a numpy array, a scipy sparse matrix or a pandas frame; the tables' indexes name cells and genes and must have its lengths."""
    if isinstance(matrix, pd.DataFrame):
        cells = pd.DataFrame(index=matrix.index) if cells is None else cells
        genes = pd.DataFrame(index=matrix.columns) if genes is None else genes
        matrix = matrix.to_numpy()
    if hasattr(matrix, "tocoo"):
        sparse = matrix.tocoo()
        shape, (i, j, v) = sparse.shape, (sparse.row, sparse.col, sparse.data)
    elif isinstance(matrix, np.ndarray) and matrix.ndim == 2:
        shape, (i, j) = matrix.shape, np.nonzero(matrix)
        v = matrix[i, j]
    else:
        raise TypeError(f"a matrix of cells x genes can't be a {type(matrix).__name__}")
    tables = []
    for frame, n, letter, key in ((cells, shape[0], "C", "cell_id"), (genes, shape[1], "G", "gene_id")):
        frame = pd.DataFrame(index=[f"{letter}{k}" for k in range(n)]) if frame is None else frame
        if len(frame) != n:
            raise ValueError(f"the table of {key} has {len(frame)} rows for {n} in the matrix")
        if frame.index.has_duplicates:
            raise ValueError(f"{key} must be unique")
        tables.append(frame.rename_axis(None).reset_index(names=key).astype({key: str}))
    names = [t.iloc[:, 0].to_numpy() for t in tables]
    expr = spark.createDataFrame(pd.DataFrame({"cell_id": names[0][i], "gene_id": names[1][j], "value": v.astype(float)}), "cell_id string, gene_id string, value double")
    return from_frames(expr, *map(spark.createDataFrame, tables), **more)


def from_lineitem(spark: SparkSession, sf_dir: str) -> CellDataset:
    """Counts: suppliers as cells, brand and type of parts as genes, summed quantities as values."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("gene_id"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.col("l_suppkey").alias("cell_id"), "l_quantity")
    expr = items.join(part, "l_partkey").groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))
    cells = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 3).alias("grp"), (F.col("s_nationkey") % 2).alias("batch"), F.col("s_acctbal").alias("pt"), F.lit(float("nan")).alias("size_factor"))
    cells = cells.join(expr.select("cell_id").distinct(), "cell_id", "left_semi")
    genes = expr.select("gene_id").distinct().withColumn("gene_short_name", F.substring_index("gene_id", "|", -1))
    return CellDataset(expr, cells, genes, Family(), 0.1)


def from_events(spark: SparkSession, sf_dir: str) -> CellDataset:
    """Continuous values: users as cells, event type and hour as genes."""
    gene = F.concat_ws("|", "event_type", F.hour("ts").cast("string"))
    expr = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("cell_id"), gene.alias("gene_id")).agg(F.sum("value").alias("value"))
    return CellDataset(expr, expr.select("cell_id").distinct().withColumn("size_factor", F.lit(float("nan"))), expr.select("gene_id").distinct().withColumn("gene_short_name", F.col("gene_id")), family_from_name("tobit", lower=0.1), 0.1)


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding(cell_id, coords, label)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("coords"), "label")


def read_gene_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select(F.col(column).alias("gene_id"))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of string lists -> (set_name, gene_id)."""
    doc = spark.read.json(path, multiLine=True)
    return doc.unpivot([], doc.columns, "set_name", "genes").select("set_name", F.explode("genes").alias("gene_id"))


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def resolve_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """Where a named file is: as given, or in the folder, by default the one that $DENDROSPARK_DATA names. Nothing is downloaded."""
    tried = [name, *(f"{f.rstrip('/')}/{name}" for f in (folder, os.environ.get("DENDROSPARK_DATA")) if f)]
    for path in tried:
        files, where = _filesystem(spark, path)
        if files.exists(where):
            return path
    raise FileNotFoundError(f"none of {tried} exists")


def verify_sha256(spark: SparkSession, path: str, expected: str) -> None:
    """A file with another checksum is deleted and a RuntimeError."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != expected:
        files, where = _filesystem(spark, path)
        files.delete(where, False)
        raise RuntimeError(f"checksum of {path} is {got}, expected {expected}")
