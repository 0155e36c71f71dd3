"""Density-peak clustering over all pairs of points, block by block.

Points are dealt into blocks of at most SIDE; every unordered pair of blocks is one task, which goes through its distances tile by tile, and only sums or best
candidates a point leave it, so the n x n distances are never rows and a task holds two blocks and a tile. Squared distances of a tile are one matrix product;
wherever its rounding could decide (cutoffs, ties, nearest points) the pairs in question are measured again by their differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, drop

#: Points of a block at most; blocks that few points are dealt into, for tasks enough; points of a tile's side, whose distances stay in a core's cache.
SIDE, LEAST_BLOCKS, TILE = 32_768, 12, 256


def _held(points: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    base = cut(points.select("cell_id", *columns), "points")
    return base, base.count()


def _block_pairs(points: DataFrame, columns: list[str], body: Callable, schema: str) -> DataFrame:
    """body(a, b, same) for all unordered pairs of blocks, by rising cell_id; a and b are dicts of arrays, the same one for a block with itself."""
    return _over_pairs(*_held(points, columns), columns, body, schema)


def _over_pairs(base: DataFrame, n: int, columns: list[str], body: Callable, schema: str) -> DataFrame:
    blocks = max(1, -(-n // SIDE), min(LEAST_BLOCKS, -(-n // (2 * TILE))))
    b, o = F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int"), F.col("_o")
    names = ["cell_id", *columns]
    rows = base.select(*names, b.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    rows = rows.select(*names, (F.least("_b", o) * blocks + F.greatest("_b", o)).alias("_pair"), (F.col("_b") > o).alias("_side"))

    def run(t: pa.Table) -> pa.Table:
        pair = t.column("_pair")[0].as_py()
        side = t.column("_side")
        sides = []
        for k in (False, True)[: 1 if pair // blocks == pair % blocks else 2]:
            part = t.filter(pa.compute.equal(side, k)).sort_by("cell_id").combine_chunks()
            got = {c: part.column(c).to_numpy() for c in names if c != "coords"}
            if "coords" in names:
                flat = part.column("coords").combine_chunks()
                got["coords"] = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1) if len(part) else np.zeros((0, 1))
            sides.append(got)
        out = body(sides[0], sides[-1], len(sides) == 1)
        return out.append_column("_pair", pa.array([pair] * len(out), pa.int32()))

    # a number of partitions of its own, or adaptive execution puts all of the small groups into one task
    pairs = blocks * (blocks + 1) // 2
    return rows.repartition(min(pairs, 2000), "_pair").groupBy("_pair").applyInArrow(run, f"{schema}, _pair int")


def _total(column: str) -> Column:
    """The sum of a group's partial sums in the order of their pairs, so that it is the same each time."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct("_pair", column))), F.lit(0.0), lambda s, v: s + v[column])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((y - r) ** 2).sum(axis=1) for r in x])) if len(x) else np.zeros((0, len(y)))


def measured(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) by their differences."""
    return np.sqrt(((a["coords"][i] - b["coords"][j]) ** 2).sum(axis=1))


class Tiles:
    """Tiles (rows, columns, squared distances) of the pairs of a and b, each pair once; those of a point with itself or a pair's second turn are ``none``.

    ``error`` bounds the rounding of a squared distance. Few dimensions, or a scale (a squared length that matters) so small that the product's rounding would be seen
    in it, go by differences.
    """

    def __init__(self, a: dict, b: dict, same: bool, scale: float = np.inf):
        self.a, self.b, self.same = a, b, same
        x, y = a["coords"], b["coords"]
        shift = x.mean(axis=0) if len(x) else 0.0
        self.x, self.y = x - shift, y - shift
        self.xx, self.yy = (self.x**2).sum(axis=1), (self.y**2).sum(axis=1)
        top = max(self.xx.max(initial=0.0), self.yy.max(initial=0.0))
        self.error = 64 * np.finfo(float).eps * (top + float(np.max(np.abs(shift), initial=0.0)) * np.sqrt(top))
        self.direct = x.shape[1] <= 4 or self.error > 1e-9 * scale
        self.twice = same and bool((np.diff(a["cell_id"][np.argsort(a["cell_id"])]) == 0).any())

    def squares(self, r: slice, c: slice) -> np.ndarray:
        if self.direct:
            d = np.zeros((len(self.x[r]), len(self.y[c])))
            for k in range(self.a["coords"].shape[1]):
                d += (self.a["coords"][r, k][:, None] - self.b["coords"][c, k]) ** 2
            return d
        d = self.x[r] @ (-2 * self.y[c].T)
        d += self.xx[r][:, None]
        d += self.yy[c]
        return np.maximum(d, 0, out=d)

    def places(self) -> Iterator[tuple[slice, slice]]:
        for i in range(0, len(self.x), TILE):
            for j in range(i if self.same else 0, len(self.y), TILE):
                yield slice(i, min(i + TILE, len(self.x))), slice(j, min(j + TILE, len(self.y)))

    def each(self, none: float = np.inf) -> Iterator[tuple[slice, slice, np.ndarray]]:
        for r, c in self.places():
            yield r, c, self.masked(r, c, none)

    def masked(self, r: slice, c: slice, none: float = np.inf) -> np.ndarray:
        d = self.squares(r, c)
        if self.same and r.start == c.start:
            d[np.tril_indices(len(d))] = none
        if self.twice:
            d[self.a["cell_id"][r][:, None] == self.b["cell_id"][c]] = none
        return d

    def exact(self, r: slice, c: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return measured(self.a, r.start + i, self.b, c.start + j)


def _both(a: dict, b: dict, same: bool, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cell_id and values of both sides; a block with itself has one."""
    return (a["cell_id"], left + right) if same else (np.concatenate([a["cell_id"], b["cell_id"]]), np.concatenate([left, right]))


def _densities(base: DataFrame, n: int, dc: float, gaussian: bool) -> DataFrame:
    def body(a: dict, b: dict, same: bool) -> pa.Table:
        t = Tiles(a, b, same, dc * dc)
        left, right = np.zeros(len(a["cell_id"])), np.zeros(len(b["cell_id"]))
        for r, c, d in t.each():
            if gaussian:
                d *= -1 / (dc * dc)
                w = np.exp(d, out=d)
            else:
                w = d < dc * dc - t.error - 4e-16 * dc * dc
                wide = d < dc * dc + t.error + 4e-16 * dc * dc
                if np.count_nonzero(w) < np.count_nonzero(wide):
                    i, j = np.nonzero(wide & ~w)
                    w[i, j] = t.exact(r, c, i, j) < dc
            left[r] += w.sum(axis=1)
            right[c] += w.sum(axis=0)
        ids, rho = _both(a, b, same, left, right)
        return pa.table({"cell_id": ids, "rho": rho})

    return _over_pairs(base, n, ["coords"], body, "cell_id long, rho double").groupBy("cell_id").agg(_total("rho").alias("rho"))


def local_density(points: DataFrame, dc: float, gaussian: bool = True) -> DataFrame:
    """cell_id, rho: sum of exp(-(d/dc)^2), or the number of others nearer than dc."""
    return _densities(*_held(points, ["coords"]), dc, gaussian)


class _Best:
    """A point's least (distance, cell_id) so far, or with sign -1 its greatest distance and then least cell_id."""

    def __init__(self, n: int, sign: int = 1):
        self.sign, self.d, self.id = sign, np.full(n, np.inf), np.full(n, -1, dtype=np.int64)

    def look(self, at: np.ndarray, squares: np.ndarray, error: float, exact: Callable, ids: np.ndarray) -> None:
        """squares(points at, others with ids), np.inf times the sign where there is none; exact(i, j) measures."""
        if not squares.size:
            return
        v = squares if self.sign > 0 else -squares
        least = v.min(axis=1)
        known = self.d[at]
        known = np.where(np.isfinite(known), self.sign * known * known, np.inf)
        hope = np.flatnonzero(np.isfinite(least) & (least <= known + error))
        if not len(hope):
            return
        i, j = np.nonzero(v[hope] <= (least[hope] + error)[:, None])
        i = hope[i]
        d = self.sign * exact(i, j)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        i, j, d = at[i[first]], j[first], d[first]
        now = self.sign * self.d[i] if self.sign > 0 else np.where(np.isfinite(self.d[i]), -self.d[i], np.inf)
        better = (d < now) | ((d == now) & (ids[j] < self.id[i]))
        self.d[i[better]], self.id[i[better]] = self.sign * d[better], ids[j[better]]


def nearest_denser(points: DataFrame) -> DataFrame:
    """points(cell_id, coords, rho) -> cell_id, delta, nearest: the nearest point of larger rho; for points of the
    largest rho the farthest point. Ties go to the smaller cell_id."""
    base, n = _held(points, ["coords", "rho"])
    peak = base.agg(F.max("rho")).first()[0]

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        falling = lambda p: {k: v[order] for k, v in p.items()} if len(order := np.argsort(-p["rho"], kind="stable")) else p
        a = falling(a)
        b = a if same else falling(b)
        t = Tiles(a, b, same)
        sides = [(a, _Best(len(a["rho"])), _Best(len(a["rho"]), -1))]
        sides.append(sides[0] if same else (b, _Best(len(b["rho"])), _Best(len(b["rho"]), -1)))
        for r, c, d in t.each(np.nan):
            for (p, near, far), (q, _, _), own, other, v, exact in ((sides[0], sides[1], r, c, d, t.exact), (sides[1], sides[0], c, r, d.T, lambda r_, c_, i, j: t.exact(c_, r_, j, i))):
                at = np.arange(own.start, own.stop)
                mine, theirs, ids = p["rho"][own], q["rho"][other], q["cell_id"][other]
                here = lambda i, j, own=own, other=other, exact=exact: exact(own, other, i, j)
                if theirs.max() > mine.min():
                    # pairs without a distance are of a block with itself, and there only beside equal densities in a tile
                    fit = v if theirs.min() > mine.max() and not t.twice else np.where((theirs > mine[:, None]) & ~np.isnan(v), v, np.inf)
                    near.look(at, fit, t.error, here, ids)
                top = np.flatnonzero(mine == peak) if mine[0] == peak else ()
                if len(top):
                    far.look(at[top], np.where(np.isnan(v[top]), -np.inf, v[top]), t.error, lambda i, j, top=top, here=here: here(top[i], j), ids)
        out = []
        for p, near, far in sides[: 1 if same else 2]:
            for best, denser in ((near, True), (far, False)):
                k = np.flatnonzero(np.isfinite(best.d))
                out.append(pa.table({"cell_id": p["cell_id"][k], "d": best.d[k], "id": best.id[k], "denser": np.full(len(k), denser)}))
        if n == 1:
            out.append(pa.table({"cell_id": a["cell_id"], "d": np.zeros(1), "id": a["cell_id"], "denser": np.array([False])}))
        return pa.concat_tables(out)

    found = _over_pairs(base, n, ["coords", "rho"], body, "cell_id long, d double, id long, denser boolean")
    best = found.groupBy("cell_id").agg(F.min(F.when(F.col("denser"), F.struct("d", "id"))).alias("up"), F.min(F.when(~F.col("denser"), F.struct((-F.col("d")).alias("d"), "id"))).alias("far"))
    return best.select("cell_id", F.coalesce(F.col("up.d"), -F.col("far.d")).alias("delta"), F.coalesce(F.col("up.id"), F.col("far.id")).alias("nearest"), F.col("up").isNotNull().alias("has_denser"))


def neighbour_counts(points: DataFrame, dc: float) -> int:
    """Unordered pairs nearer than dc."""
    return int(round(local_density(points, dc, False).agg(F.sum("rho")).first()[0] / 2))


def _least_and_most(base: DataFrame, n: int) -> tuple[float, float]:
    def body(a: dict, b: dict, same: bool) -> pa.Table:
        t = Tiles(a, b, same)
        lo, hi = np.inf, -np.inf
        for r, c, d in t.each(np.nan):
            low = np.fmin.reduce(d, axis=None)
            if low - t.error <= lo * lo:
                lo = min(lo, float(t.exact(r, c, *np.nonzero(d <= low + t.error)).min()))
            high = np.fmax.reduce(d, axis=None)
            if high + t.error >= hi * hi or hi < 0:
                hi = max(hi, float(t.exact(r, c, *np.nonzero(d >= high - t.error)).max())) if not np.isnan(high) else hi
        return pa.table({"lo": pa.array([lo] if hi >= 0 else [], pa.float64()), "hi": pa.array([hi] if hi >= 0 else [], pa.float64())})

    return _over_pairs(base, n, ["coords"], body, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()


def _shares(base: DataFrame, n: int, cuts: np.ndarray) -> np.ndarray:
    """Unordered pairs nearer than each of the cuts, which are all but evenly spaced, by one pass over the pairs."""
    step = (cuts[-1] - cuts[0]) / max(len(cuts) - 1, 1)

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        t = Tiles(a, b, same)
        near = max(1e-6, np.sqrt(t.error) / 1000 / step)
        total = np.zeros(len(cuts) + 1, np.int64)
        for r, c, d in t.each(np.nan):
            small = d < 1e6 * t.error
            u = np.sqrt(d, out=d)
            u -= cuts[0] - step
            u /= step
            k = np.floor(np.clip(np.nan_to_num(u, nan=-1.0), -1, len(cuts))).astype(np.int64)
            unsure = np.abs(u - np.rint(u)) < near
            unsure &= (u > 0.5) & (u < len(cuts) + 0.5)
            unsure |= small & ~np.isnan(u)
            if unsure.any():
                i, j = np.nonzero(unsure)
                k[i, j] = np.searchsorted(cuts, t.exact(r, c, i, j), side="right")
            k[k < 0] = 0
            total += np.bincount(k.ravel(), minlength=len(total))
            total[0] -= int(np.isnan(u).sum())
        return pa.table({"k": np.arange(len(total)), "n": total})

    got = _over_pairs(base, n, ["coords"], body, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    return np.cumsum([r["n"] for r in got])[:-1]


def estimate_dc(points: DataFrame, low_rate: float = 0.01, high_rate: float = 0.02, most: int = 200, levels: int = 10) -> float:
    """Bisection on the cutoff until the neighbour rate lies in [low, high], over all pairs. A pass counts the pairs for all cutoffs that the next levels can come to."""
    base, n = _held(points, ["coords"])
    low, high = _least_and_most(base, n)
    dc, known = None, {}
    for k in range(most):
        dc = (low + high) / 2
        if dc not in known:
            cuts, todo = set(), [(low, high, levels)]
            while todo:
                lo, hi, left = todo.pop()
                mid = (lo + hi) / 2
                cuts.add(mid)
                if left > 1 and lo < mid < hi:
                    todo += [(lo, mid, left - 1), (mid, hi, left - 1)]
            cuts = np.array(sorted(cuts))
            if len(cuts) < 2:
                known = {c: neighbour_counts(base, c) for c in cuts.tolist()}
            else:
                known = dict(zip(cuts.tolist(), _shares(base, n, cuts).tolist(), strict=True))
        rate = (((known[dc] * 2 + n) / n) - 1) / n
        if low_rate <= rate <= high_rate:
            drop(base)
            return dc
        low, high = (dc, high) if rate < low_rate else (low, dc)
    raise RuntimeError("the distance cutoff did not settle")


def assign_clusters(spark: SparkSession, points: DataFrame, rho_threshold: float, delta_threshold: float, most_rounds: int = 64) -> DataFrame:
    """points(cell_id, rho, delta, nearest, has_denser) -> plus peaks, cluster. Peaks are numbered by cell_id; others follow their nearest
    denser point by pointer jumping; a chain that ends at no peak is -1."""
    return follow_peaks(points.withColumn("peaks", (F.col("rho") > rho_threshold) & (F.col("delta") > delta_threshold)), most_rounds)


def follow_peaks(peaks: DataFrame, most_rounds: int = 64) -> DataFrame:
    """peaks(cell_id, peaks, nearest, has_denser, ...) -> plus cluster."""
    from pyspark.sql import Window

    number = peaks.where("peaks").select("cell_id", F.row_number().over(Window.orderBy("cell_id")).alias("label"))
    at = peaks.join(number, "cell_id", "left").select("cell_id", F.when(F.col("peaks") | ~F.col("has_denser"), F.col("cell_id")).otherwise(F.col("nearest")).alias("next"))
    at = cut(at, "hops")
    for _ in range(most_rounds):
        hop = at.select(F.col("cell_id").alias("next"), F.col("next").alias("after"))
        new = cut(at.join(hop, "next").select("cell_id", F.col("after").alias("next"), (F.col("next") != F.col("after")).alias("moved")), "hops")
        moved = new.where("moved").limit(1).count()
        drop(at)
        at = new
        if not moved:
            break
    else:
        raise RuntimeError("the chains of denser points did not settle")
    labels = number.select(F.col("cell_id").alias("next"), "label")
    return peaks.join(at.drop("moved").join(labels, "next", "left").select("cell_id", F.coalesce("label", F.lit(-1)).alias("cluster")), "cell_id")


def halo(points: DataFrame, dc: float) -> DataFrame:
    """points(cell_id, coords, rho, cluster) -> cell_id, halo: rho under the largest mean rho of a pair across clusters within dc. Unassigned points (-1) make no border and are no halo."""

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        falling = lambda p: {k: v[order] for k, v in p.items()} if len(order := np.argsort(-p["rho"], kind="stable")) else p
        a = falling(a)
        b = a if same else falling(b)
        t = Tiles(a, b, same, dc * dc)
        names, where = np.unique(np.concatenate([a["cluster"], b["cluster"]]), return_inverse=True)
        left, right = where[: len(a["cluster"])], where[len(a["cluster"]) :]
        border = np.full(len(names), -np.inf)
        for r, c in t.places():
            x, y = left[r], right[c]
            # both sides fall: no pair of this tile has more than its first
            if (a["rho"][r.start] + b["rho"][c.start]) / 2 <= min(border[x].min(), border[y].min()):
                continue
            d = t.masked(r, c)
            near = d <= dc * dc + t.error + 4e-16 * dc * dc
            near &= x[:, None] != y
            i, j = np.nonzero(near & (d >= dc * dc - t.error - 4e-16 * dc * dc))
            if len(i):
                near[i, j] = t.exact(r, c, i, j) <= dc
            mean = np.where(near, (a["rho"][r][:, None] + b["rho"][c]) / 2, -np.inf)
            np.maximum.at(border, x, mean.max(axis=1))
            np.maximum.at(border, y, mean.max(axis=0))
        k = np.flatnonzero(np.isfinite(border))
        return pa.table({"cluster": names[k].astype(np.int64), "border": border[k]})

    found = _block_pairs(points.where("cluster <> -1"), ["coords", "rho", "cluster"], body, "cluster long, border double")
    border = found.groupBy("cluster").agg(F.max("border").alias("border"))
    return points.withColumn("cluster", F.col("cluster").cast("long")).join(border, "cluster", "left").select("cell_id", ((F.col("cluster") != -1) & (F.col("rho") < F.coalesce("border", F.lit(0.0)))).alias("halo"))


def adopt(points: DataFrame) -> DataFrame:
    """points(cell_id, coords, cluster, ...): unassigned ones (-1) take the cluster of their nearest assigned point, ties to the smaller cell_id."""

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        out = []
        for p, q in ((a, b), (b, a))[: 1 if same else 2]:
            lost, known = ({k: v[(part["cluster"] == -1) == is_lost] for k, v in part.items()} for part, is_lost in ((p, True), (q, False)))
            best = _Best(len(lost["cell_id"]))
            if len(lost["cell_id"]) and len(known["cell_id"]):
                t = Tiles(lost, known, False)
                for r, c, d in t.each():
                    best.look(np.arange(r.start, r.stop), d, t.error, lambda i, j, t=t, r=r, c=c: t.exact(r, c, i, j), known["cell_id"][c])
            k = np.flatnonzero(np.isfinite(best.d))
            order = np.argsort(known["cell_id"], kind="stable")
            at = order[np.searchsorted(known["cell_id"][order], best.id[k])] if len(k) else order[:0]
            out.append(pa.table({"cell_id": lost["cell_id"][k], "d": best.d[k], "id": best.id[k], "c": known["cluster"][at].astype(np.int32)}))
        return pa.concat_tables(out)

    found = _block_pairs(points, ["coords", "cluster"], body, "cell_id long, d double, id long, c int")
    best = found.groupBy("cell_id").agg(F.min(F.struct("d", "id", "c")).alias("to"))
    kept = [c for c in points.columns if c != "cluster"]
    return points.join(best, "cell_id", "left").select(*kept, F.when(F.col("cluster") == -1, F.coalesce("to.c", F.lit(1))).otherwise(F.col("cluster")).alias("cluster"))


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points(cell_id, coords), nodes(node, coords): the nearest node of each point; nodes are few (checked) and broadcast."""
    rows = nodes.orderBy("node").limit(20_001).toPandas()
    if len(rows) > 20_000:
        raise ValueError("more nodes than a graph of centres may have")
    ids, y = rows["node"].to_numpy(), np.array(rows["coords"].tolist(), dtype=float)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(len(batch), -1)
            d = distances(x, y)
            at = d.argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at].astype(np.int64)), pa.array(d[np.arange(len(x)), at])], ["cell_id", "node", "distance"])

    return points.select(F.col("cell_id").cast("long"), "coords").mapInArrow(run, "cell_id long, node long, distance double")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """points(cell_id, coords) -> cell_id, ids, squares: the k nearest others by distance, then cell_id, and their squared distances."""
    kind = points.schema["cell_id"].dataType.simpleString()

    def nearest(ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
        near = np.flatnonzero(d <= d[near].max(initial=-np.inf)) if len(d) > k else near
        return near[np.lexsort((ids[near], d[near]))][:k]

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        cells, others, squares = [], [], []
        for p, q in ((a, b), (b, a))[: 1 if same else 2]:
            t = Tiles(p, q, False)
            for i in range(0, len(p["cell_id"]), TILE):
                r = slice(i, min(i + TILE, len(p["cell_id"])))
                d = t.squares(r, slice(0, len(q["cell_id"])))
                if same:
                    d[np.arange(r.stop - r.start), np.arange(r.start, r.stop)] = np.inf
                for c, row in zip(p["cell_id"][r].tolist(), d, strict=True):
                    j = nearest(q["cell_id"], row)
                    j = j[np.isfinite(row[j])]
                    cells.append(c)
                    others.append(q["cell_id"][j])
                    squares.append(row[j])
        return pa.table({"cell_id": pa.array(cells), "ids": pa.array(others), "squares": pa.array(squares, pa.list_(pa.float64()))}).cast(pa.schema([("cell_id", pa.array(cells[:1]).type), ("ids", pa.list_(pa.array(cells[:1]).type)), ("squares", pa.list_(pa.float64()))]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, squares = [], []
            for own, d in zip(batch.column("ids"), batch.column("squares"), strict=True):
                own, d = own.values.to_numpy(zero_copy_only=False), d.values.to_numpy(zero_copy_only=False)
                j = nearest(own, d)
                ids.append(own[j])
                squares.append(d[j])
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(ids, batch.schema.field("ids").type), pa.array(squares, pa.list_(pa.float64()))], ["cell_id", "ids", "squares"])

    schema = f"cell_id {kind}, ids array<{kind}>, squares array<double>"
    found = _block_pairs(points, ["coords"], body, schema).groupBy("cell_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("squares")).alias("squares"))
    return found.mapInArrow(best, schema)


def distance_sums(points: DataFrame) -> DataFrame:
    """label, n, total: number and sum of the distances from a label's points to all others."""

    def body(a: dict, b: dict, same: bool) -> pa.Table:
        t = Tiles(a, b, same)
        left, right = np.zeros((2, len(a["label"]))), np.zeros((2, len(b["label"])))
        for r, c, d in t.each(np.nan):
            there = ~np.isnan(d)
            small = d < 1e6 * t.error
            d = np.sqrt(d, out=d)
            if small.any():
                i, j = np.nonzero(small)
                d[i, j] = t.exact(r, c, i, j)
            if not there.all():
                d[~there] = 0
            left[:, r] += there.sum(axis=1), d.sum(axis=1)
            right[:, c] += there.sum(axis=0), d.sum(axis=0)
        names, where = np.unique(np.concatenate([a["label"], b["label"]]), return_inverse=True)
        n, total = (np.bincount(where, np.concatenate([left[k], right[k]]), len(names)) for k in (0, 1))
        return pa.table({"label": names.astype(np.int32), "n": n.astype(np.int64), "total": total})

    return _block_pairs(points, ["coords", "label"], body, "label int, n long, total double").groupBy("label").agg(F.sum("n").alias("n"), _total("total").alias("total"))
