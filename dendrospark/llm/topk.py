"""Exact top-k by inner product with MaxScore over dimension postings.

A query is a bag of terms, one for each dimension where it isn't zero; a term's postings are the vectors of a
shard with their component there.  A term adds query * component, at least and at most what the shard's smallest
and largest component allow, so contributions above the least one are not negative and
bounds add up.  Terms are ordered by the width of their bounds.  Each query's essential terms, rounded up to ``STEP`` terms, are traversed for all vectors of a block;
the narrow terms whose widths together can't lift a vector over the query's current k-th score are
non-essential and probed only for vectors that are still competitive.  The k-th score rises from block to block; a
shard's best are merged with other shards' by rank.

Vectors and queries are dealt into shards of bounded size by a hash, and every query shard meets every vector shard
once: the stated query set against all rows, in blocks.  A query shard is the larger one, as a vector is repeated for each of them; within a task queries go in turns of
``TURN``.  Scores are integer: components become floor(scale * x).

Edge cases: vectors that are null or hold a null or non-finite component take no part, neither do rows with a null vec_id.  Vectors of different
length score over the dimensions they share.  Rows with the query's vec_id are its own.  Equal scores: the smaller
vec_id first.  Repeated rows are candidates each.  A query without candidates has no rows.  Components whose products could pass 2**53
are summed as Python integers and scores are held within long.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK = 1024
QUERY_ROWS = 16384
TURN = 512
STEP = 4
LONG = (1 << 63) - 1


def max_score(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of every query's k best; ids sorted; ties to smaller id."""
    nq = len(queries)
    best_s = np.full((nq, k), -np.inf)
    best_i = np.full((nq, k), -1, dtype=np.int64)
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    a, b = queries * low, queries * high
    least, width = np.minimum(a, b), np.abs(a - b)
    mean_width = width.mean(axis=0)
    order = np.argsort(-mean_width, kind="stable")
    q, v, least, width = queries[:, order], vectors[:, order], least[:, order], width[:, order]
    rest = np.concatenate([np.cumsum(width[:, ::-1], axis=1)[:, ::-1], np.zeros((nq, 1))], axis=1)
    floor = np.concatenate([np.cumsum(least[:, ::-1], axis=1)[:, ::-1], np.zeros((nq, 1))], axis=1)
    dims = v.shape[1]
    for lo in range(0, len(v), BLOCK):
        block, bid = v[lo : lo + BLOCK], ids[lo : lo + BLOCK]
        need = best_s[:, -1]
        # essential: a query's fewest leading terms without which no vector can reach its k-th score
        lift = rest + floor[:, :1]
        essential = np.where(np.isfinite(need), (lift >= need[:, None]).sum(axis=1), dims)
        essential = np.clip(-(-essential // STEP) * STEP, min(STEP, dims), dims)
        found = []
        for split in np.unique(essential).tolist():
            mine = np.flatnonzero(essential == split)
            score = q[mine, :split] @ block[:, :split].T
            open_ = score + (floor[mine, split] + rest[mine, split])[:, None] >= need[mine, None]
            at, vi = np.nonzero(open_ & (own[mine, None] != bid[None, :]))
            qi = mine[at]
            exact = score[at, vi]
            if split < dims:
                exact = exact + np.einsum("ij,ij->i", q[qi, split:], block[vi, split:])
            found.append((qi, vi, exact))
        qi, vi, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(qi):
            continue
        s = np.concatenate([best_s.ravel(), exact])
        who = np.concatenate([np.repeat(np.arange(nq), k), qi])
        what = np.concatenate([best_i.ravel(), lo + vi])
        by = np.lexsort((what, -s, who))
        who_sorted = who[by]
        rank = np.arange(len(by)) - np.searchsorted(who_sorted, who_sorted)
        top = by[rank < k]
        best_s, best_i = s[top].reshape(nq, k), what[top].reshape(nq, k)
    qi, slot = np.nonzero(np.isfinite(best_s))
    return qi, best_i[qi, slot], best_s[qi, slot]


def _matrix(column: pa.ChunkedArray, scale: float) -> tuple[np.ndarray, bool]:
    """Rows as floor(scale * x), short ones filled with zero; and whether sums stay exact in doubles."""
    lists = column.combine_chunks()
    size = np.asarray(lists.value_lengths())
    flat = np.floor(scale * lists.flatten().to_numpy().astype(np.float64))
    out = np.zeros((len(size), int(size.max(initial=0))))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, True


def _best(k: int, scale: float):
    def run(table: pa.Table) -> pa.Table:
        role = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        m, _ = _matrix(table.column("embedding"), scale)
        v, vid = m[~role], ids[~role]
        q, qid = m[role], ids[role]
        by = np.argsort(vid, kind="stable")
        v, vid = v[by], vid[by]
        if not len(v) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if np.abs(m).max(initial=0) ** 2 * max(1, m.shape[1]) < 2**53:
            turns = [(lo, *max_score(q[lo : lo + TURN], qid[lo : lo + TURN], v, vid, k)) for lo in range(0, len(q), TURN)]
            qi, vi, s = np.concatenate([lo + x for lo, x, *_ in turns]), np.concatenate([x for *_, x, _ in turns]), np.concatenate([x for *_, x in turns]).astype(np.int64)
        else:
            big_v, big_q = ([[int(x) for x in r] for r in x] for x in (v.tolist(), q.tolist()))
            got = []
            for i, x in enumerate(big_q):
                all_ = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(big_v) if vid[j] != qid[i]))[:k]
                got += [(i, j, max(-LONG, min(LONG, -t))) for t, j in all_]
            qi, vi, s = (np.array(c, dtype=np.int64) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(qid[qi]), "vec_id": pa.array(vid[vi]), "score": pa.array(s, pa.int64())})

    return run


def search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row where ``is_query`` holds."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    n, n_query = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, q_shards = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_query // QUERY_ROWS))
    where = F.xxhash64("vec_id", "embedding")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = rows.withColumn("shard", F.pmod(where, F.lit(shards)).cast("int")).withColumn("q_shard", each(q_shards)).withColumn("is_query", F.lit(False))
    asked = rows.where(is_query).withColumn("q_shard", F.pmod(where, F.lit(q_shards)).cast("int")).withColumn("shard", each(shards)).withColumn("is_query", F.lit(True))
    dealt = mine.select("shard", "q_shard", "vec_id", "embedding", "is_query").union(asked.select("shard", "q_shard", "vec_id", "embedding", "is_query"))
    found = dealt.groupBy("shard", "q_shard").applyInArrow(_best(k, scale), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
