"""Trees as edge tables: degree, pseudotime, paths, projections, and branch datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut, drop


def symmetric(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").union(back)


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def _settle(at: DataFrame, step, name: str, most_rounds: int) -> DataFrame:
    """Pointer jumping: at(..., hop) is replaced by step(at) until no row has a ``moved`` left, or for most_rounds rounds; every round is a cut table, so plans
    stay flat. What still moves then runs in a circle."""
    at = cut(at, name)
    for _ in range(most_rounds):
        new = cut(step(at), name)
        moved = new.where("moved").limit(1).count()
        drop(at)
        at = new
        if not moved:
            break
    return at


def _rounds(n: int) -> int:
    return max(2, n.bit_length() + 1)


def away(edges: DataFrame, root) -> DataFrame:
    """The edges of the root's tree, each pointing away from the root, in log2(n) joins whatever the tree's depth.

    Edges that have one source a node and none for the root point so already. Others are turned by a tour along both sides of every edge: the side that the
    tour from the root takes first leads down, and places on the tour are found by pointer jumping.
    """
    lit = F.lit(root).cast(edges.schema["src"].dataType)
    odd = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("dst") == lit)).limit(1).count()
    if not odd:
        return edges.select("src", "dst", "weight")
    sides = cut(symmetric(edges), "sides")
    around = Window.partitionBy("src").orderBy("dst")
    whole = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("dst").over(whole)
    # after the side dst -> src the tour takes src -> (the neighbour after dst); it ends where it would leave the root by its first side again
    turn = sides.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.coalesce(F.lead("dst").over(around), F.when(F.col("src") != lit, first)).alias("w"))
    start = turn.select(F.struct("u", "v").alias("side"), F.when(F.col("w").isNotNull(), F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("hop"), F.lit(1).cast("long").alias("left"))

    def step(at: DataFrame) -> DataFrame:
        far = at.select(F.col("side").alias("hop"), F.col("hop").alias("_hop"), F.col("left").alias("_left"))
        return at.join(far, "hop", "left").select("side", F.col("_hop").alias("hop"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"), F.col("_hop").isNotNull().alias("moved"))

    n = sides.count()
    place = _settle(start, step, "tour", _rounds(n)).where("hop is null").select("side.u", "side.v", "left")
    back = place.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("back"))
    down = place.join(back, ["u", "v"]).where("left > back").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return cut(sides.join(down, ["src", "dst"]).select("src", "dst", "weight"), "down")


def rooted(edges: DataFrame, root) -> DataFrame:
    """node, parent, pseudotime, depth of an undirected tree, outwards from the root, in log2(depth) joins of its edges."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    down = away(edges, root)
    start = down.select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("src").alias("hop"), F.col("weight").cast("double").alias("pseudotime"), F.lit(1).cast("long").alias("depth"))

    def step(at: DataFrame) -> DataFrame:
        far = at.select(F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("pseudotime").alias("_far"), F.col("depth").alias("_depth"))
        moved = F.col("_hop").isNotNull()
        return at.join(far, "hop", "left").select("node", "parent", F.coalesce("_hop", "hop").alias("hop"), F.when(moved, F.col("_far") + F.col("pseudotime")).otherwise(F.col("pseudotime")).alias("pseudotime"), F.when(moved, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"), moved.alias("moved"))

    at = _settle(start, step, "hops", _rounds(down.count()))
    first = spark.createDataFrame([(root, None, 0.0, 0)], f"node {kind}, parent {kind}, pseudotime double, depth int")
    return first.union(at.where(F.col("hop") == F.lit(root)).select("node", "parent", "pseudotime", F.col("depth").cast("int")))


def pseudotime(edges: DataFrame, root) -> DataFrame:
    return rooted(edges, root).select("node", "pseudotime")


def path_to_root(edges: DataFrame, leaf) -> DataFrame:
    """node, step along parents (src) from a node up, for edges that point away from the root; the known part of the path doubles with every join."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    path = spark.createDataFrame([(leaf, 0)], f"node {kind}, step long")
    jump = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("hop")), "jumps")
    length, most = 1, jump.count() + 1
    while True:
        more = cut(path.join(jump, "node").select(F.col("hop").alias("node"), (F.col("step") + length).alias("step")), "path")
        if not more.limit(1).count():
            drop(jump)
            return path
        path, length = path.union(more), 2 * length
        if length > 2 * most:
            raise RuntimeError("the path runs in a circle")
        twice = cut(jump.join(jump.select(F.col("node").alias("hop"), F.col("hop").alias("_hop")), "hop").select("node", F.col("_hop").alias("hop")), "jumps")
        drop(jump)
        jump = twice


def project(x: str, y: str, ax: Column, ay: Column, bx: Column, by: Column, clamp: bool) -> tuple[Column, Column]:
    """The point's projection on the segment a-b, or on its line without clamp; a segment of no length is a."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((F.col(x) - ax) * dx + (F.col(y) - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) if clamp else t
    return ax + t * dx, ay + t * dy


def sequential_split(ancestors: DataFrame, branch_cells: DataFrame, labels: list[str]) -> DataFrame:
    """cell_id, branch: ancestors by (pt, cell_id) take turns; the earliest is on the second branch too."""
    rank = ancestors.select("cell_id", (F.row_number().over(Window.orderBy("pt", "cell_id")) - 1).alias("k"))
    turns = rank.select("cell_id", F.when(F.col("k") % 2 == 0, labels[0]).otherwise(labels[1]).alias("branch"))
    first = rank.where("k = 0").select("cell_id", F.lit(labels[1]).alias("branch"))
    return turns.union(branch_cells.select("cell_id", "branch")).union(first)


def duplicate_progenitors(ancestors: DataFrame, branch_cells: DataFrame, labels: list[str]) -> DataFrame:
    """cell_id, original_cell_id, branch: a copy of every ancestor a branch."""
    copies = ancestors.select("cell_id", F.posexplode(F.array(*map(F.lit, labels))).alias("i", "branch"))
    named = copies.select(F.concat_ws("_", F.lit("duplicate"), (F.col("i") + 1).cast("string"), F.col("cell_id").cast("string")).alias("cell_id"), F.col("cell_id").alias("original_cell_id"), "branch")
    return named.union(branch_cells.select(F.col("cell_id").cast("string"), "cell_id", "branch"))


def stretch(cells: DataFrame, is_ancestor: Column, branch: str, pt: str) -> DataFrame:
    """Pseudotime of each branch beyond the ancestors is stretched to the longest branch, then all to 0..100."""
    x = cells.withColumn("_a", is_ancestor)
    top = x.agg(F.max(F.when(F.col("_a"), F.col(pt))).alias("_top"), F.max(pt).alias("_longest"))
    ends = x.where(~F.col("_a")).groupBy(branch).agg(F.max(pt).alias("_m"))
    x = x.crossJoin(F.broadcast(top)).join(F.broadcast(ends), branch, "left")
    value = F.when(~F.col("_a") & (F.col(pt) > F.col("_top")) & (F.col("_m") > F.col("_top")), F.col("_top") + (F.col(pt) - F.col("_top")) * (F.col("_longest") - F.col("_top")) / (F.col("_m") - F.col("_top"))).otherwise(F.col(pt))
    x = x.withColumn(pt, value)
    return x.crossJoin(F.broadcast(x.agg(F.max(pt).alias("_max")))).withColumn(pt, F.col(pt) * 100 / F.col("_max")).select(*cells.columns)
