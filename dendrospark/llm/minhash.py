"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): round i throws every element of a set into bin h_i(x) with
value v_i(x); a bin keeps the least value of the first round that reaches it.  Rounds below t use a
random bin, round t+j bin j, so after 2t rounds every coordinate of a non-empty set is filled, and
the fraction of equal coordinates estimates Jaccard similarity with Chernoff-type concentration.

Banding: ``bands`` x ``rows`` coordinates; with 32 x 6 a pair at similarity 0.85 meets in no band with
probability 3e-7.  Candidates are confirmed on the full sets.

Hot groups: texts with equal sets are one class before anything is compared.  Each bucket compares
its members with one pivot, its least class; what the pivots leave open goes through an exact
prefix-filter join (see ``_settle``), so no link is lost and no bucket is capped.  Joins by bucket and by pivot deal the rows of a hot one
into parts (see ``skew``).

Edge cases: null or blank texts have empty sets, n_shingles 0, and link with nothing.  A null doc_id
takes part in nothing: component null, kept true.  Rows that share a doc_id count as one document,
linked when any of its texts is.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .skew import hot, spread
from .store import cut, drop
from .textkit import distinct_sets, list_array, mix, shingles, slices, words

BANDS, ROWS = 32, 6
#: Items, and 256 for each node, in a block of nodes that are compared together.
BLOCK_ITEMS = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: np.ndarray, offs: np.ndarray, t: int) -> np.ndarray:
    """Rows x t coordinates; a row with an empty set stays at the largest value."""
    n = len(offs) - 1
    out = np.full((n, t), FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    x = sets
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(h), i - t, dtype=np.uint64)
        value = mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
        rows = np.unique(row) if i == 0 else live
        local = np.searchsorted(rows, row)
        this = np.full(len(rows) * t, FULL, dtype=np.uint64)
        np.minimum.at(this, local * t + where.astype(np.int64), value)
        at = (rows[:, None] * t + np.arange(t)).reshape(-1)
        new = (flat[at] == FULL) & (this != FULL)
        flat[at[new]] = this[new]
        live = rows[(out[rows] == FULL).any(axis=1)]
        keep = np.isin(row, live) if len(live) < len(rows) else slice(None)
        row, x = row[keep], x[keep]
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(sk)
    out = np.zeros((n, bands), dtype=np.uint64)
    part = sk[:, : bands * rows].reshape(n, bands, rows)
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
    return mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, buf, offs in slices(batch.column(batch.schema.get_field_index("text"))):
        yield lo, hi, *distinct_sets(*shingles(words(buf, offs), k))


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, offs in _sets(batch, k):
                n = np.diff(offs)
                keys = band_keys(sketch(sets, offs, bands * rows), bands, rows)
                keys = keys[n > 0].reshape(-1)
                a = np.concatenate([[np.uint64(0)], np.cumsum(sets)])
                b = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0xE7037ED1A0B428DB)))])
                whole = np.stack([a[offs[1:]] - a[offs[:-1]], b[offs[1:]] - b[offs[:-1]]], axis=1).astype(">u8").tobytes()
                key = pa.Array.from_buffers(pa.binary(16), hi - lo, [None, pa.py_buffer(whole)]).cast(pa.binary())
                at = np.concatenate([[0], np.cumsum((n > 0) * bands)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), key, list_array(keys.view(np.int64), at, pa.int64())], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, offs in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), list_array(sets.view(np.int64), offs, pa.int64())], ["node", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with the size of the intersection and union of their full sets, and whether they link."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a")
    many = hot(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"])
    with_b = spread(with_a, sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), ["b"], many, by=["a"])
    met = with_b.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    met = met.select("a", "b", "common", (F.col("total") - F.col("common")).alias("joint"))
    return met.withColumn("linked", F.lit(100) * F.col("common") >= F.lit(percent) * F.col("joint"))


def _settle(members: DataFrame, many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the buckets members(key, node) that give the components of all links.

    First every bucket's least node, its pivot, is compared with each other member, which links nearly all of a
    group of copies.  A bucket that then holds more than one component is open, and the nodes of open buckets go through
    an exact prefix-filter join: two sets at the link similarity share an item among the rarest
    n - ceil(n * percent / 100) + 1 of each, so texts that only have a frequent passage in common never
    meet.
    """
    hubs = members.groupBy("key").agg(F.min("node").alias("pivot"))
    placed = cut(spread(members, hubs, ["key"], many).where("node <> pivot"), "mh-placed")
    pairs = cut(placed.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "mh-pairs")
    seen = cut(_verified(pairs, sets, percent), "mh-seen")
    drop(pairs)
    links = seen.where("linked").select("a", "b")
    if seen.where("not linked").isEmpty():
        drop(placed)
        return links
    side = components(links).select("node", F.col("comp").alias("side"))
    placed = placed.join(side, "node", "left").join(side.select(F.col("node").alias("pivot"), F.col("side").alias("main")), "pivot", "left")
    placed = placed.select("key", "node", "pivot", (F.coalesce("side", "node") != F.coalesce("main", "pivot")).alias("far"))
    still = placed.groupBy("key", "pivot").agg(F.max("far").alias("far")).where("far")
    rest = spread(placed, still.select("key"), ["key"], many, by=["node"]).select("node").union(still.select("pivot")).distinct()
    rest = cut(rest.join(side, "node", "left").withColumn("side", F.coalesce("side", "node")), "mh-rest")
    items = sets.join(rest.select("node"), "node").select("node", F.explode("items").alias("item"))
    df = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = items.join(df, "item", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("x"))
    size = F.size("x")
    prefix = ordered.select("node", F.explode(F.slice("x", F.lit(1), size - F.ceil(size * F.lit(percent) / 100).cast("int") + 1)).alias("y"))
    prefix = cut(prefix.where("y.df > 1").select("node", F.col("y.item").alias("key")).join(rest, "node"), "mh-prefix")
    hubs = prefix.groupBy("key").agg(F.min("node").alias("hub"), F.min("side").alias("main"), F.max("side").alias("other")).where("main < other")
    near = components(prefix.join(hubs.select("key", "hub"), "key").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    drop(placed, prefix)
    return links.union(cut(_within_clouds(near.select("node", F.col("comp").alias("cloud")).join(rest, "node"), sets, percent), "mh-more"))


def _within_clouds(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different sides of nodes(node, cloud, side), each cloud compared block by block.

    A cloud's nodes, by rising set size, form blocks of about ``BLOCK_ITEMS`` items; two blocks meet
    where their sizes allow a link.  A task holds two blocks, counts common items as a matrix product
    and gives one link for each pair of sides, so no pair of nodes is ever a row.
    """
    sized = nodes.join(sets.select("node", F.size("items").alias("size")).dropDuplicates(["node"]), "node")
    sized = cut(sized, "mh-sized")
    # blocks follow from sums by (cloud, size): several small sizes share a block, a large one has several, dealt by a hash
    sums = sized.groupBy("cloud", "size").agg(F.sum(F.col("size") + 256).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cloud").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("base", F.floor(before / BLOCK_ITEMS)).select("cloud", "size", "base", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ITEMS)).alias("many"))
    many = hot(sized.groupBy("cloud", "size").agg(F.count(F.lit(1)).alias("n")), ["cloud", "size"])
    placed = spread(sized, sums, ["cloud", "size"], many, by=["node"])
    placed = cut(placed.withColumn("block", F.col("base") + F.pmod(F.xxhash64("node"), F.col("many"))).drop("base", "many"), "mh-blocks")
    blocks = placed.groupBy("cloud", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    later = blocks.select("cloud", F.col("block").alias("j"), "low")
    meet = blocks.select("cloud", F.col("block").alias("i"), "high").join(later, "cloud").where((F.col("i") <= F.col("j")) & (100 * F.col("high") >= percent * F.col("low")))
    both = meet.select("cloud", "i", "j", F.col("i").alias("block")).union(meet.where("i < j").select("cloud", "i", "j", F.col("j").alias("block")))
    rows = placed.join(both, ["cloud", "block"]).join(sets, "node").select("cloud", "i", "j", "block", "node", "side", "items")

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        lists = table.column("items").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = _links(flat, at, left, right, side, percent)
        return pa.table({"a": pa.array(np.minimum(node[a], node[b])), "b": pa.array(np.maximum(node[a], node[b]))})

    return rows.groupBy("cloud", "i", "j").applyInArrow(run, "a long, b long")


def _links(flat: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, side: np.ndarray, percent: int, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), a in left and b in right, that link: one for each pair of different sides."""
    if len(np.unique(side)) == 1:
        return left[:0], right[:0]
    size = np.diff(at)
    pick = lambda rows: (np.concatenate([flat[at[r] : at[r + 1]] for r in rows]), np.repeat(np.arange(len(rows)), size[rows]))
    (x, xr), (y, yr) = pick(left), pick(right)
    shared = np.intersect1d(x, y)
    keep = lambda v, r: ((p := np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))), shared[p] == v, r) if len(shared) else (v[:0], v[:0] == 0, r[:0])
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    (xp, xk, xr), (yp, yk, yr) = keep(x, xr), keep(y, yr)
    xp, xr, yp, yr = xp[xk], xr[xk], yp[yk], yr[yk]
    for lo in range(0, len(shared), wide):
        m, n = (np.zeros((k, wide), dtype=np.float32) for k in (len(left), len(right)))
        for dense, p, r in ((m, xp, xr), (n, yp, yr)):
            here = (p >= lo) & (p < lo + wide)
            dense[r[here], p[here] - lo] = 1
        common += m @ n.T
    joint = size[left][:, None] + size[right][None, :] - common
    a, b = np.nonzero((100 * common >= percent * joint) & (side[left][:, None] != side[right][None, :]))
    a, b = left[a], right[b]
    _, first = np.unique(np.stack([side[a], side[b]], axis=1), axis=0, return_index=True)
    return a[first], b[first]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sk = cut(docs.mapInArrow(_sketches(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "mh-sketch")
    live = sk.where("n_shingles > 0 and doc_id is not null")
    classes = cut(live.groupBy("set_key").agg(F.min("doc_id").alias("node")), "mh-classes")
    reps = live.join(classes, "set_key").where("doc_id = node").select("node", F.explode("bands").alias("key")).distinct()
    reps = cut(reps, "mh-reps")
    busy = cut(reps.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "mh-busy")
    many = cut(hot(busy, ["key"]), "mh-hot")
    members = cut(spread(reps, busy.select("key"), ["key"], many), "mh-members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(k), "node long, items array<long>"), "mh-sets")
    links = _settle(members, many, sets, percent)
    drop(reps, members, busy, many)
    comp = components(links)
    out = live.join(classes, "set_key").select("doc_id", "n_shingles", "node").join(comp, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    drop(sets)
    alone = sk.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
