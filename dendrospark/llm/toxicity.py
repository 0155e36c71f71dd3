"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (``<`` and ``>`` mark its ends) and itself, each
hashed to one of ``buckets`` vectors; a text is the mean over its words of the mean of their vectors; two
softmax outputs follow.  Vectors and softmax weights are trained together in numpy by Adagrad on minibatches.
An unseen spelling shares n-gram vectors with those seen.

The classifier is fitted on a bounded sample of the labelled training rows: per class at most
``per_class`` documents and ``sample_bytes`` bytes of text, first by a hash of their text.  The sample is chosen by joins, brought to
one task and fitted there, so its memory is bounded by these parameters and none of it is the driver's, which gets a number for each
bucket.  The fit is the same when a lost task runs again.  Class weights undo that the sample is balanced only as far as ``positive_weight`` says.  Scoring covers every whole text: as everything after
the vectors is linear, a word counts by one number, worked out once for each distinct word of a slice.

Edge cases: null, empty and blank texts get the score of the bias alone.  Labels other than 0 and 1, and null ones,
teach nothing; a document with both labels teaches nothing.  With no labelled row of either class all scores are the class share
(0 without any).  A null doc_id has an empty string's checksum and is held out.  Repeated rows are
scored one by one; extra columns are ignored, lang and source included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, drop
from .textkit import SLICE_BYTES, slices, span_hashes, words

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
#: Bytes of text that the fit and the scoring work on at a time.
SMALL_SLICE = 1 << 18


@dataclass
class Model:
    emb: np.ndarray  # buckets x dim
    out: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def unit(self) -> np.ndarray:
        """What each bucket adds to the difference of the two outputs."""
        return self.emb @ (self.out[:, 1] - self.out[:, 0])


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... many[0] numbers, then the same from first[1], and so on."""
    begin = np.concatenate([[0], np.cumsum(many)])
    return np.repeat(first - begin[:-1], many) + np.arange(begin[-1])


def subwords(buf: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of every word's n-grams and of the word itself, and each word's first."""
    n = len(start)
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(at[-1], ord("<"), dtype=np.uint8)
    marked[at[1:] - 1] = ord(">")
    b = buf[_ranges(start, end - start)]
    marked[_ranges(at[:-1] + 1, end - start)] = np.where((b >= 65) & (b <= 90), b + 32, b)
    ids, of = [span_hashes(marked, at[:-1], at[1:])], [np.arange(n)]
    for g in GRAMS:
        many = np.maximum(size - g + 1, 0)
        of.append(np.repeat(np.arange(n), many))
        first = _ranges(at[:-1], many)
        ids.append(span_hashes(marked, first, first + g))
    flat, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (flat[order] % np.uint64(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


@dataclass
class Bags:
    """Texts as rows of a sparse matrix: bucket ids, their weights, and each text's first."""

    ids: np.ndarray
    coef: np.ndarray
    first: np.ndarray

    def rows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = self.first[pick + 1] - self.first[pick]
        at = _ranges(self.first[pick], many)
        return self.ids[at], self.coef[at], np.repeat(np.arange(len(pick)), many)


def _weighted(texts: pa.Array, buckets: int, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every text its buckets and their weights in the mean over words of the mean over subwords."""
    for lo, hi, buf, offs in slices(texts, limit):
        w = words(buf, offs)
        _, some, which = np.unique(w.hash, return_index=True, return_inverse=True)
        grams, first = subwords(buf, w.start[some], w.end[some], buckets)
        many = np.diff(first)
        for r in range(hi - lo):
            mine, n = np.unique(which[w.first[r] : w.first[r + 1]], return_counts=True)
            coef = np.repeat(n / many[mine] / max(1, n.sum()), many[mine])
            uniq, inv = np.unique(grams[_ranges(first[mine], many[mine])], return_inverse=True)
            yield uniq.astype(np.int32), np.bincount(inv, weights=coef, minlength=len(uniq)).astype(np.float32)


def bags(texts: pa.Array, buckets: int, least_df: int = 3) -> Bags:
    """The texts' bags without the buckets that fewer than least_df texts use; worked out twice, so that those are never held.

    Texts are taken in small slices, and the arrays have their size from the first pass: beside them only a slice's working space is held.
    """
    df = np.zeros(buckets, np.int32)
    for ids, _ in _weighted(texts, buckets, SMALL_SLICE):
        df[ids] += 1
    keep = df >= least_df
    total = int(df[keep].sum())
    out = Bags(np.empty(total, np.int32), np.empty(total, np.float32), np.zeros(len(texts) + 1, np.int64))
    at = 0
    for r, (ids, coef) in enumerate(_weighted(texts, buckets, SMALL_SLICE)):
        some = keep[ids]
        stop = at + int(some.sum())
        out.ids[at:stop], out.coef[at:stop] = ids[some], coef[some]
        out.first[r + 1] = at = stop
    return out


def train(docs: Bags, marks: np.ndarray, weights: np.ndarray, buckets: int = BUCKETS, dim: int = 8, epochs: int = 12, rate: float = 1.0, batch: int = 16, seed: int = 7) -> Model:
    """Adagrad. Buckets that no bag has stay at zero."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32))
    used = np.zeros(buckets, dtype=bool)
    for lo in range(0, len(docs.ids), 1 << 20):
        used[docs.ids[lo : lo + (1 << 20)]] = True
    model.emb[~used] = 0
    g_emb, g_out, g_bias = np.full(buckets, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(marks))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            ids, coef, row = docs.rows(pick)
            rows, col = np.unique(ids, return_inverse=True)
            dense = np.zeros((len(pick), len(rows)), np.float32)
            dense[row, col] = coef
            vec = model.emb[rows]
            x = dense @ vec
            z = x @ model.out + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - np.eye(2, dtype=np.float32)[marks[pick]]) * weights[pick, None].astype(np.float32)
            grad_out, grad_bias = x.T @ d, d.sum(axis=0)
            grad = dense.T @ (d @ model.out.T)
            g_out += grad_out**2
            g_bias += grad_bias**2
            g_emb[rows] += (grad**2).mean(axis=1)
            model.out -= rate * 0.2 * grad_out / np.sqrt(g_out)
            model.bias -= rate * 0.2 * grad_bias / np.sqrt(g_bias)
            model.emb[rows] = vec - rate * grad / np.sqrt(g_emb[rows])[:, None]
    return model


def held_out(folds: int = 5):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sample(docs: DataFrame, labels: DataFrame, folds: int, per_class: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(mark, order, doc_id, text) of the chosen texts, at most per_class and sample_bytes a class, and the labelled rows by class."""
    marks = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("mark"), F.max("toxic").alias("other")).where("mark = other")
    train_docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where(~held_out(folds))
    # sizes and hashes are joined with the labels; only the chosen texts, few by the parameters, are fetched
    narrow = train_docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("order"))
    marked = cut(narrow.join(marks.select("doc_id", F.col("mark").cast("int")).hint("merge"), "doc_id").where(F.col("size") <= sample_bytes), "toxic-marks")
    sizes = {r["mark"]: r["count"] for r in marked.groupBy("mark").count().collect()}
    first = [marked.where(F.col("mark") == kind).orderBy("order", "doc_id").limit(per_class) for kind in (0, 1)]
    room = F.sum("size").over(Window.partitionBy("mark").orderBy("order", "doc_id"))
    few = cut(first[0].union(first[1]).withColumn("room", room).where(F.col("room") <= sample_bytes).select("doc_id", "order", "mark").distinct(), "toxic-few")
    drop(marked)
    chosen = train_docs.withColumn("order", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "order"])
    return chosen.select("mark", "order", "doc_id", "text").dropDuplicates(["doc_id", "order"]), sizes


def _fitted(share: float, positive_weight: float):
    """One row (unit, bias) from all rows (mark, order, doc_id, text) of the one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("mark", "ascending"), ("order", "ascending"), ("doc_id", "ascending")])
        marks = rows.column("mark").to_numpy().astype(np.int64)
        # the sample's odds against the odds of all labelled rows
        n1, n0 = int((marks == 1).sum()), int((marks == 0).sum())
        weight = np.where(marks == 1, positive_weight * share / max(n1, 1), (1 - share) / max(n0, 1)) * len(marks)
        texts = rows.column("text").combine_chunks()
        del rows
        held = bags(texts, BUCKETS)
        del texts
        model = train(held, marks, weight)
        yield pa.RecordBatch.from_arrays([pa.array([model.unit().astype("<f8").tobytes()], pa.binary()), pa.array([float(model.bias[1] - model.bias[0])])], ["unit", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 2500, sample_bytes: int = 12 << 20, positive_weight: float = 2.0) -> tuple[np.ndarray | None, float, float]:
    """What each bucket adds to the difference of the two outputs (None where a class has no labelled row), its bias, and the share of label 1 among labelled training rows."""
    chosen, sizes = _sample(docs, labels, folds, per_class, sample_bytes)
    if len(sizes) < 2:
        return None, 0.0, float(sizes.get(1, 0) > 0)
    share = sizes[1] / sum(sizes.values())
    unit, bias = chosen.repartition(1).mapInArrow(_fitted(share, positive_weight), "unit binary, bias double").first()
    return np.frombuffer(unit, "<f8"), bias, share


def _scores(column: pa.Array, unit: np.ndarray | None, bias: float, share: float) -> np.ndarray:
    out = []
    for lo, hi, buf, offs in slices(column, SMALL_SLICE):
        if unit is None:
            out.append(np.full(hi - lo, share))
            continue
        w = words(buf, offs)
        _, some, which = np.unique(w.hash, return_index=True, return_inverse=True)
        grams, first = subwords(buf, w.start[some], w.end[some], len(unit))
        # each word is summed by itself, so no score depends on the slice its text is in
        worth = np.add.reduceat(unit[grams], first[:-1]) / np.diff(first)
        z = np.bincount(w.doc, weights=worth[which], minlength=hi - lo) / np.maximum(1, w.counts) + bias
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _shared(docs: DataFrame, labels: DataFrame, folds: int, params: dict):
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, **params))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = _shared(docs, labels, folds, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(folds).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, **params) -> DataFrame:
    """The rows of docs, all columns, that score under 0.5."""
    shared = _shared(docs, labels, folds, params)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), *shared.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)
