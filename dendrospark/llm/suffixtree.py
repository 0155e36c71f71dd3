"""Language-model scores from a probabilistic suffix tree over words.

A context is a run of 1 to ``depth`` words.  It is a candidate when it occurs at least ``least`` times before a token of
the training texts, and so is an entry (a context and its next token, a word or the end of the text).
A candidate stays in the tree when its next-token distribution diverges from its parent's, the context without its oldest
word: its count times the Kullback-Leibler divergence, over its entries and the rest as one cell, must exceed half the
95 % point of a chi-square with one degree less than it has cells (Buehlmann and Wyner's pruning).  Ancestors of
a kept context stay too.

P(x | s) = (c(s, x) + (m + rest(s)) P(x | parent)) / (c(s) + m), where rest(s) is the count of s before tokens that make no entry and
c(s, x) is 0 for those; the root has P0(x) = (c(x) + 0.1) / (N + 0.1 (V + 1)).  It sums to 1 over all words, the end and an unknown word.  A token is
scored by the longest suffix in the tree.

``least`` is an absolute count, so the tree grows with the corpus: nothing in it depends on a share of the tokens.  Its tables
stay tables; documents get their part by a join on chunks (see ``dictionary``).  A run of words is counted only where
all its parts are candidates, which a filter of fixed size (``FILTER_BITS`` bits, broadcast) tells: what it lets
through wrongly is counted and then falls under ``least``, so a full filter costs time and changes no result.
A frequent run is described (its context and parent) by one of the tasks that counted it, which a second such filter tells; should the
texts be dealt to other tasks then, runs are missing, and all tasks describe what they have.

Edge cases: a null or blank text is one end token.  Training on nothing gives V = N = 0 and probability 1 to any token.  A null doc_id has an empty
string's checksum, 0, so it is held out.  Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionary import HELD, LOOK_BYTES, Index, by_chunk, look_up, own_key, tallied, text_bytes, word_keys
from .skew import hot, spread
from .store import cut, drop
from .textkit import Words, mix, slices, words

#: Bits of a filter as a power of two: 16 MB at any size of the corpus.
FILTER_BITS = 27
END = 0x5851F42D4C957F2D
_STEP = 0x9E3779B97F4A7C15
#: Tells a run as a context from the same run as an entry, in a filter.
_LEADS = 0x1B873593CC9E2D51


@dataclass
class Tree:
    """entries: (key, ctx, parent, n) of kept contexts; contexts: (ctx, n, rest).

    answers: (key, n, rest) of both and of the words, as documents ask for the largest of a key: a run's count, below 0 where it is neither
    a word nor an entry, and its rest, -1 where it is no context.
    """

    vocabulary: DataFrame
    entries: DataFrame
    contexts: DataFrame
    answers: DataFrame
    total: int
    distinct: int
    texts: int


def stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every text's tokens with its end: hashes, places in the text, rows, and each text's first token."""
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    token = np.full(first[-1], END, dtype=np.uint64)
    token[np.arange(len(w.hash)) + w.doc] = w.hash
    size = np.diff(first)
    return token, np.arange(len(token)) - np.repeat(first[:-1], size), np.repeat(np.arange(n), size), first


def run_keys(token: np.ndarray, d: int) -> np.ndarray:
    """Keys of the runs of d words and the token after them, by that token's index; a context of d words has the key of its last word's run of d - 1.

    The first d tokens of a text have none, which callers check by place.
    """
    if not d:
        return token
    out = np.full(len(token), (d * END) & (2**64 - 1), dtype=np.uint64)
    for j in range(d + 1):
        out[j:] += token[: len(token) - j] * np.uint64(pow(_STEP, j + 1, 1 << 64))
    return mix(out)


def before(keys: np.ndarray) -> np.ndarray:
    """The key at the token before."""
    return np.concatenate([keys[:1], keys[:-1]])


def marked(keys: DataFrame) -> np.ndarray:
    """The filter that tells the column ``key``: two bits a key, by its upper and its lower bits."""
    bits = F.array(F.shiftrightunsigned("key", 64 - FILTER_BITS), F.col("key").bitwiseAND((1 << FILTER_BITS) - 1))
    rows = (
        keys.select(F.explode(bits).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passes(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    def is_set(bit: np.ndarray) -> np.ndarray:
        return (marks[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    out = is_set(keys >> np.uint64(64 - FILTER_BITS))
    at = np.flatnonzero(out)
    out[at] = is_set(keys[at] & np.uint64((1 << FILTER_BITS) - 1))
    return out


def _counted(train: DataFrame, marks: np.ndarray, d: int, least: int, size: int) -> DataFrame:
    """(key, n, own) of the entries of contexts of d words."""
    share = train.sparkSession.sparkContext.broadcast(marks)

    def keys_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        token, place, _, _ = stream(words(buf, offs))
        shorter = run_keys(token, d - 1)
        ok = passes(share.value, shorter)
        if d == 1:
            ok |= token == np.uint64(END)
        at = np.flatnonzero(ok & before(ok) & (place >= d))
        return run_keys(token, d)[at]

    out = cut(tallied(train, keys_of, size, least), f"lm-entries-{d}")
    share.destroy()
    return out


def _described(train: DataFrame, share: Broadcast, depth: int, owners: Broadcast | None) -> DataFrame:
    """(key, ctx, parent, level) of every run that the shared filter passes with all its parts; parent is the run without its oldest word.

    Each run comes from the task that owns it by the filter ``owners``, of the tasks that have it; without, from all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = np.zeros(0, dtype=np.uint64), TaskContext.get().partitionId()
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0), LOOK_BYTES):
                token, place, _, _ = stream(words(buf, offs))
                shorter, ok = token, passes(share.value, token) | (token == np.uint64(END))
                for d in range(1, depth + 1):
                    key, longer = run_keys(token, d), np.zeros(len(token), dtype=bool)
                    at = np.flatnonzero((place >= d) & ok & before(ok))
                    at = at[passes(share.value, key[at])]
                    longer[at] = True
                    if owners is not None:
                        at = at[passes(owners.value, own_key(key[at], task))]
                    found, where = np.unique(key[at], return_index=True)
                    new = look_up(known, np.ones(len(known), dtype=np.int64), found) == 0
                    found, at = found[new], at[where[new]]
                    known = np.sort(np.concatenate([known, found])) if len(known) < HELD else np.sort(found)
                    cols = [found, before(shorter)[at], shorter[at]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols), pa.array(np.full(len(found), d, np.int32))], ["key", "ctx", "parent", "level"])
                    shorter, ok = key, longer

    return train.select("text").mapInArrow(run, "key long, ctx long, parent long, level int")


def _runs(train: DataFrame, levels: list[DataFrame], every: np.ndarray) -> DataFrame:
    """(key, ctx, parent, level, n) of all entries."""
    context = train.sparkSession.sparkContext
    counted = reduce(DataFrame.unionByName, levels)
    share, owners = context.broadcast(every), context.broadcast(marked(counted.select(F.col("own").alias("key"))))

    def met(owners: Broadcast | None) -> DataFrame:
        seen = _described(train, share, len(levels), owners).groupBy("key").agg(*(F.max(c).alias(c) for c in ("ctx", "parent", "level")))
        return cut(seen.join(counted.select("key", "n"), "key"), "lm-runs")

    found = met(owners)
    if found.count() < counted.count():
        # the texts were dealt to other tasks than when they were counted
        drop(found)
        found = met(None)
    share.destroy()
    owners.destroy()
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _met(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with the unique rows of ``small`` on a key that many rows of ``big`` may share."""
    return spread(big, small, [key], hot(big.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key]), how, by=["key"])


def fit(train: DataFrame, depth: int = 3, least: int = 32, size: int | None = None) -> Tree:
    """The tree of the texts; ``size``: their bytes, more or less."""
    size = text_bytes(train) if size is None else size
    vocabulary = cut(tallied(train, word_keys, size).select("key", "n"), "lm-words")
    texts = train.count()
    n_words, distinct = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = (n_words or 0) + texts, distinct + (texts > 0)
    often = vocabulary.where(F.col("n") >= least)
    levels, marks = [], marked(often)
    every = marks.copy()
    for d in range(1, depth + 1):
        levels.append(_counted(train, marks, d, least, size))
        marks = marked(levels[-1])
        every |= marks
        if not marks.any():
            break
    counted = reduce(DataFrame.unionByName, levels).select("key", "n")
    found = _runs(train, levels, every)
    # the share of each entry in its context, and the same token's share in the parent
    entries = _met(found, often.unionByName(counted).select(F.col("key").alias("ctx"), F.col("n").alias("c")), "ctx").withColumn("share", F.col("n") / F.col("c"))
    entries = cut(entries, "lm-shares")
    end = train.sparkSession.range(1).select(F.lit(_signed(END)).cast("long").alias("parent"), F.lit(texts / max(total, 1)).alias("above"))
    above = often.select(F.col("key").alias("parent"), (F.col("n") / max(total, 1)).alias("above")).unionByName(end).unionByName(entries.select(F.col("key").alias("parent"), F.col("share").alias("above")))
    rest, cells = F.col("c") - F.col("seen"), F.greatest(F.col("cells") + (F.col("c") > F.col("seen")).cast("int") - 1, F.lit(1))
    left = F.greatest(1 - F.col("above"), F.lit(1e-12))
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("c") / left)).otherwise(0.0)
    verdicts = (
        _met(entries, above, "parent")
        .groupBy("ctx", "level")
        .agg(F.max("c").alias("c"), F.sum("n").alias("seen"), F.count(F.lit(1)).alias("cells"), F.sum("above").alias("above"), F.sum(F.col("n") * F.log(F.col("share") / F.col("above"))).alias("gain"))
        .select("ctx", "level", F.col("c").alias("n"), rest.alias("rest"), (gain > (cells + 1.645 * F.sqrt(2 * cells)) / 2).alias("own"))
    )
    verdicts = cut(verdicts, "lm-verdicts")
    kept = None
    for d in range(len(levels), 0, -1):
        here = verdicts.where((F.col("level") == d) & F.col("own")).select("ctx")
        if kept is not None:
            # a context of d + 1 words is an entry of level d, whose parent is the context without its oldest word
            here = here.unionByName(longer.join(found.select(F.col("key").alias("ctx"), "parent"), "ctx").select(F.col("parent").alias("ctx"))).distinct()
        longer = here
        kept = here if kept is None else kept.unionByName(here)
    contexts = cut(verdicts.join(kept, "ctx", "left_semi").select("ctx", "n", "rest"), "lm-contexts")
    held = cut(_met(entries.select("key", "ctx", "parent", "n"), contexts.select("ctx"), "ctx", "left_semi"), "lm-kept")
    # a run's count is the same as an entry and as a context, so that a positive one wins
    counts = [vocabulary.select("key", "n", F.lit(-1).cast("long").alias("rest")), held.select("key", "n", F.lit(-1).cast("long").alias("rest")), contexts.select(F.col("ctx").alias("key"), -F.col("n"), "rest")]
    answers = reduce(DataFrame.union, counts)
    drop(*levels, found, entries, verdicts)
    return Tree(vocabulary, held, contexts, answers, total, distinct, texts)


def held_out(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def scored(docs: DataFrame, folds: int = 10, m: float = 5.0, depth: int = 3, least: int = 32) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = text_bytes(docs)
    tree = fit(docs.where(~held_out(folds)), depth, least, size)
    total, ends, z = tree.total, tree.texts, tree.total + 0.1 * (tree.distinct + 1)
    leads = F.col("ctx").bitwiseXOR(F.lit(_LEADS).cast("long")).alias("key")
    share = docs.sparkSession.sparkContext.broadcast(marked(tree.entries.select("key").unionByName(tree.contexts.select(leads))))

    def needed(token: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1 to depth words and a token: their keys, and where the tree may have them as entries or contexts."""
        led = passes(share.value, token ^ np.uint64(_LEADS))
        for d in range(1, depth + 1):
            key = run_keys(token, d)
            need = (place >= d) & before(led)
            at = np.flatnonzero(need)
            need[at] = passes(share.value, key[at])
            if d < depth:
                # the context without its oldest word is in the tree too
                at = np.flatnonzero((place >= d) & led)
                led = np.zeros(len(token), dtype=bool)
                led[at] = passes(share.value, key[at] ^ np.uint64(_LEADS))
                need |= led
            yield key, np.flatnonzero(need)

    def asks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = words(buf, offs)
        token, place, row, _ = stream(w)
        keys, rows = [w.hash], [w.doc]
        for key, at in needed(token, place):
            keys.append(key[at])
            rows.append(row[at])
        return np.concatenate(keys), np.concatenate(rows)

    def score(kept: pa.Table, buf: np.ndarray, offs: np.ndarray, index: Index, counts: np.ndarray, rests: np.ndarray) -> pa.Table:
        token, place, row, first = stream(words(buf, offs))
        n = len(offs) - 1
        # the last of each stands for a key that is missing
        counts, rests = np.append(counts, 0), np.append(rests, -1)
        where = index(token)
        c = np.where(token == np.uint64(END), ends, np.maximum(counts[where], 0))
        base = (c + 0.1) / z
        p = base.copy()
        for d, (key, some) in enumerate(needed(token, place), 1):
            ctx = before(where)
            where = np.full(len(token), index.size)
            where[some] = index(key[some])
            at = np.flatnonzero((place >= d) & (rests[ctx] >= 0))
            p[at] = (np.maximum(counts[where[at]], 0) + (m + rests[ctx[at]]) * p[at]) / (np.abs(counts[ctx[at]]) + m)
        tokens = np.diff(first)
        return pa.table(
            {
                "doc_id": kept.column("doc_id"),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(np.bincount(row, weights=c > 0, minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": pa.array(np.bincount(row, weights=np.log10(base), minlength=n)),
                "score": pa.array(np.bincount(row, weights=np.log10(p), minlength=n)),
            }
        )

    out = by_chunk(docs, tree.answers, ["doc_id"], score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double", asks, size)
    return out.select("doc_id", held_out(folds).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
