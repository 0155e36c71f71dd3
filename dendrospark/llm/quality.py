"""Quality rules with risk-controlled thresholds.

Base rules are fixed.  On top, cutoffs on shape features of a text are certified on labelled documents:
for each stratum (``lang``, null being one of its own) and feature a fixed grid is walked from lenient to
strict; a cutoff passes while the exact (Clopper-Pearson) upper bound on the share of good documents it
rejects stays within ``alpha / features``.  The walk stops at the first failure, so the fixed-sequence
test needs no correction along the grid; across strata and features the error ``delta`` is split
(Bonferroni).  With probability 1 - delta every stratum loses at most ``alpha`` of its good documents to the certified
rules.  Of the passed cutoffs the one that trades rejected bad against rejected good documents best is
used, or none.  The grid doesn't depend on data, so all labelled rows serve as holdout.  Strata with
too few labels certify nothing and keep the base rules alone.

Edge cases: null texts count as empty: all counts 0 and base_failed (fewer than ten words).  A null doc_id is scored,
without label.  Labels that are null, or contradict each other for a document, are left out.  Repeated rows are scored one by
one.  Extra columns are ignored; without a ``lang`` column there is one stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .textkit import SPACE, mix, shingles, slices, span_hashes, words

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[ord("!")] = True
_DOC = np.uint64(0xA24BAED4963EE407)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang"]
#: The cutoffs tried for every feature, from lenient to strict; larger feature values are worse.
GRID = [round(0.9 * 0.85**i, 6) for i in range(32)]
FEATURES = {
    "f_symbols": "n_symbols / word_chars",
    "f_upper": "n_upper / word_chars",
    "f_bang": "n_bang / n_words",
    "f_dup": "n_dup_lines / n_words",
    "f_repeat": "n_repeat_words / n_words",
}
BROADCAST_STRATA = 10_000


def _repeated(key: np.ndarray) -> np.ndarray:
    """For every key, whether it occurs twice or more; and the order that sorts them."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    w = words(buf, offs, lower=False)
    out = {"n_words": w.counts, "word_chars": per_row(~SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[buf]), "n_upper": per_row(_UPPER[buf]), "n_bang": per_row(_BANG[buf])}
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    begin = begin[begin < len(buf)]
    stop = np.minimum(np.concatenate([begin[1:], [len(buf)]]), len(buf)).astype(np.int64)
    stop = np.where((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(begin) else stop
    solid = np.concatenate([[0], np.cumsum(~SPACE[buf])])
    real = solid[stop] > solid[begin]
    begin, stop = begin[real], stop[real]
    row = np.searchsorted(offs, begin, "right") - 1
    key = mix(span_hashes(buf, begin, stop) + row.astype(np.uint64) * _DOC)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[order][1:] == key[order][:-1]
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=n)
    h, first = shingles(w)
    full = np.repeat(w.counts >= 5, np.diff(first))
    at = (np.repeat(w.first[:-1] - first[:-1], np.diff(first)) + np.arange(len(h)))[full]
    twice = _repeated(mix(h[full] + w.doc[at].astype(np.uint64) * _DOC))
    cover = np.zeros(len(w.hash) + 6, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    inside = np.cumsum(cover)[: len(w.hash)] > 0
    out["n_repeat_words"] = np.bincount(w.doc[inside], minlength=n)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in slices(batch.column(2)):
            found = counts(buf, offs)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", "stratum", *COUNTS])


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p with P(Binomial(n, p) <= k) >= delta."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        parts = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(parts)
        return top + math.log(sum(math.exp(x - top) for x in parts))

    lo, hi, want = k / n, 1.0, math.log(delta)
    for _ in range(60):
        mid = (lo + hi) / 2
        if 0 < mid < 1 and tail(mid) >= want:
            lo = mid
        else:
            hi = mid
    return hi


def choose(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, price: float) -> float | None:
    """The cutoff for one stratum and feature. levels: how many grid values (lenient first) a row exceeds."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best, chosen = 0.0, None
    if not n_good or not n_bad:
        return None
    for i, cutoff in enumerate(GRID):
        hit = levels >= len(GRID) - i
        k, b = int(good[hit].sum()), int(bad[hit].sum())
        if k > n_good * alpha or upper_bound(k, n_good, delta) > alpha:
            break
        gain = b / n_bad - price * k / n_good
        if gain > best + 1e-12:
            best, chosen = gain, cutoff
    return chosen


def _cutoffs(alpha: float, delta: float, price: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": part["stratum"].iloc[0]}
        for f in FEATURES:
            x = part[part["feature"] == f]
            good, bad = (np.where(x["quality"] == q, x["n"], 0) for q in (1, 0))
            got = choose(x["level"].to_numpy(), good, bad, alpha, delta, price)
            out[f] = math.inf if got is None else got
        return pd.DataFrame([out])

    return run


def risk_controlled(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, price: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(verdicts, cutoffs). price: rejected good share that one unit of rejected bad share must outweigh."""
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    measured = docs.select("doc_id", lang.alias("stratum"), "text").mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    for f, e in FEATURES.items():
        top, below = e.split(" / ")
        measured = measured.withColumn(f, F.coalesce(F.try_divide(F.col(top), F.col(below)), F.lit(0.0)))
    measured = cut(measured, "quality")
    marks = labels.select("doc_id", "quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and doc_id is not null")
    marked = measured.join(marks.select("doc_id", "quality"), "doc_id")
    level = lambda f: sum((F.col(f) > g).cast("int") for g in GRID)
    long = marked.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), level(f).alias("level")) for f in FEATURES))).alias("x"))
    tally = cut(long.groupBy("stratum", "quality", "x.feature", "x.level").agg(F.count(F.lit(1)).alias("n")), "quality-tally")
    strata = tally.select("stratum").distinct().count()
    each = _cutoffs(alpha / len(FEATURES), delta / max(1, strata * len(FEATURES)), price)
    cutoffs = cut(tally.groupBy("stratum").applyInPandas(each, "stratum string, " + ", ".join(f"{f} double" for f in FEATURES)), "quality-cutoffs")
    bounds = cutoffs.select("stratum", *(F.col(f).alias(f"max_{f}") for f in FEATURES))
    joined = measured.join(F.broadcast(bounds) if strata <= BROADCAST_STRATA else bounds, "stratum", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = F.lit(False)
    for f in FEATURES:
        over |= F.col(f) > F.coalesce(f"max_{f}", F.lit(math.inf))
    out = joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~over)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), cutoffs
