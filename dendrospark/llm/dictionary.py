"""Exact word statistics brought to documents without broadcasting a vocabulary.

``tallied`` counts all words of a corpus.  ``by_chunk`` deals documents into chunks of bounded
size by a hash, asks for each chunk's distinct words once, and runs a function over a chunk's documents together with
its part of the vocabulary.  What travels per chunk is its distinct words, not their occurrences, and no
group grows with the corpus.

Keys travel in *blocks*: a task's sorted keys of one part of the key space, as differences, with their values.  The parts
are ranges of the keys' upper bits, as many as the corpus has ``PART_BYTES``, so a part's keys fit a task at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mix, slices, words

CHUNK_BYTES = 24 << 20
PART_BYTES = 16 << 20
#: Distinct keys that a task holds before it hands its sums on.
HELD = 1 << 21
#: Text that is looked at in one go: its arrays fit a core's cache.
LOOK_BYTES = 1 << 18
#: Keys that are sorted together before they are merged with others.
SORTED = 1 << 19
#: Rows of an Arrow batch that leaves a task.
ROWS = 1 << 17


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def part_bits(size: int) -> int:
    """The parts of ``size`` bytes of text, as a power of two."""
    return max(1, (max(size - 1, 0) // PART_BYTES).bit_length())


def packed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and columns of longs, by bytes of equal weight."""
    import zstandard

    cols = [np.diff(keys, prepend=np.uint64(0)), *(((v << 1) ^ (v >> 63)).view(np.uint64) for v in values)]
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T) for c in cols)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(block: bytes, n_values: int) -> list[np.ndarray]:
    """The keys and columns that ``packed`` took."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(n_values + 1, 8, -1)
    keys, *values = (np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw)
    return [np.cumsum(keys, dtype=np.uint64), *((v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64) for v in values)]


def gathered(blocks: Sequence[bytes], n_values: int) -> list[np.ndarray]:
    """All blocks' columns, one after the other, and where each block begins."""
    empty = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(n_values))]
    cols = [unpacked(b, n_values) for b in blocks]
    size = np.array([len(c[0]) for c in cols], dtype=np.int64)
    return [*(np.concatenate(x) for x in zip(empty, *cols, strict=True)), np.cumsum(size) - size]


def parted(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of the parts that sorted keys have."""
    edge = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edge = [*edge.tolist(), len(keys)]
    return ((p, a, b) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b)


def begins_of(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Tally:
    """Sums by 64-bit key, merged in sorted arrays; ``full`` tells when to hand them on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.size = self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting > SORTED:
            self._sort()

    def _sort(self) -> None:
        if self.waiting:
            self.parts.append(np.unique(np.concatenate(self.raw), return_counts=True))
            self.size += len(self.parts[-1][0])
        self.raw, self.waiting = [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        self._sort()
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        begins = begins_of(keys)
        return keys[begins], np.add.reduceat(n, begins)

    @property
    def full(self) -> bool:
        if self.size > HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size > HELD // 2

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums, which are no longer held."""
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def own_key(keys: np.ndarray, task: np.ndarray | int) -> np.ndarray:
    """The key's name in one task."""
    return keys ^ mix(np.atleast_1d(np.asarray(task)).astype(np.uint64) + np.uint64(1))


def tallied(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int | None = None, least: int = 1) -> DataFrame:
    """key, n, own, all long: how often each key that ``keys_of(bytes, offsets)`` gives occurs in docs' text, where it does ``least`` times.

    own is ``own_key`` of one of the tasks that have met the key. ``size``: bytes of text, more or less.
    """
    bits = part_bits(text_bytes(docs) if size is None else size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, task = Tally(), TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            keys, n = tally.taken()
            rows = [(p, packed(keys[a:b], n[a:b])) for p, a, b in parted(keys, bits)]
            cols = [pa.array([p for p, _ in rows], pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "task", "block"])

        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0), LOOK_BYTES):
                tally.add(keys_of(buf, offs))
                if tally.full:
                    yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, task, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.setdefault(part, []).append((task, block))
        for part in list(blocks):
            tasks, packs = zip(*blocks.pop(part), strict=True)
            keys, n, first = gathered(packs, 1)
            order = np.argsort(keys)
            keys = keys[order]
            begins = begins_of(keys)
            many = np.diff(begins, append=len(keys))
            n, keys = np.add.reduceat(n[order], begins), keys[begins]
            one = order[begins + (keys % many.astype(np.uint64)).astype(np.int64)]
            own = own_key(keys, np.array(tasks)[np.searchsorted(first, one, "right") - 1])
            some = np.flatnonzero(n >= least)
            for lo in range(0, len(some), ROWS):
                at = some[lo : lo + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(c[at].view(np.int64), pa.int64()) for c in (keys, n, own)], ["key", "n", "own"])

    return docs.select("text").mapInArrow(run, "part int, task int, block binary").repartition("part").mapInArrow(merge, "key long, n long, own long")


def word_keys(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return words(buf, offs).hash


def words_asked(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(buf, offs)
    return w.hash, w.doc


class Index:
    """Finds keys in sorted keys by their upper bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size = len(keys)
        bits = max(1, (2 * self.size).bit_length())
        self.shift = np.uint64(64 - bits)
        many = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = (np.cumsum(many) - many).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Each wanted key's index, the number of keys where it is missing."""
        at = self.first[wanted >> self.shift]
        there = self.keys[at]
        behind = np.flatnonzero(there < wanted)
        while len(behind):
            at[behind] += 1
            there[behind] = self.keys[at[behind]]
            behind = behind[there[behind] < wanted[behind]]
        at[there != wanted] = self.size
        return at


def by_chunk(docs: DataFrame, vocabulary: DataFrame, keep: list[str], score: Callable, schema: str, asks: Callable = words_asked, size: int | None = None) -> DataFrame:
    """Run ``score(kept columns, bytes, offsets, index, *values)`` over slices of every chunk.

    vocabulary: key long, and columns of longs of which a key that has many rows has the largest. ``asks(bytes, offsets)`` gives the keys that
    a slice needs and the row of each, all word hashes unless told otherwise. ``index(keys)`` tells their places in values, an array for
    each of those columns over the chunk's part of the vocabulary; keys that it doesn't have are placed behind its end. ``size``: bytes of docs' text.
    """
    told = [c for c in vocabulary.columns if c != "key"]
    size = text_bytes(docs) if size is None else size
    chunks, bits = max(1, -(-size // CHUNK_BYTES)), part_bits(size)
    dealt = docs.select(*keep, "text").withColumn("chunk", F.pmod(F.xxhash64(*keep, "text"), F.lit(chunks)).cast("int")).repartition("chunk")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Tally] = {}

        def out(c: int) -> pa.RecordBatch:
            keys = found.pop(c).taken()[0]
            rows = [(p, packed(keys[a:b])) for p, a, b in parted(keys, bits)]
            cols = [pa.array([c] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "part", "block"])

        for batch in batches:
            chunk = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in slices(batch.column(len(keep)), LOOK_BYTES):
                keys, row = asks(buf, offs)
                of = chunk[lo:hi][row]
                there = np.unique(chunk[lo:hi]).tolist()
                for c in there:
                    tally = found.setdefault(c, Tally())
                    tally.add(keys[of == c] if len(there) > 1 else keys)
                    if tally.full:
                        yield out(c)
        for c in list(found):
            yield out(c)

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        """The blocks that chunks ask for, with the values of their keys."""
        keys = right.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        begins = begins_of(keys)
        values = [np.maximum.reduceat(right.column(c).to_numpy().astype(np.int64)[order], begins) if len(keys) else np.zeros(0, np.int64) for c in told]
        keys = keys[begins]
        index, blocks = Index(keys), []
        for block in left.column("block"):
            wanted = unpacked(block.as_py(), 0)[0]
            at = index(wanted)
            at = at[at < len(keys)]
            blocks.append(packed(keys[at], *(v[at] for v in values)))
        return pa.table({"chunk": left.column("chunk"), "block": pa.array(blocks, pa.binary())})

    # both uses of ``dealt`` read all its columns, so that Spark shuffles it once and reuses the exchange
    wanted = dealt.mapInArrow(asked, "chunk int, part int, block binary")
    lists = vocabulary.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "key", *told)
    answers = wanted.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(answered, "chunk int, block binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, *values, _ = gathered(right.column("block").to_pylist(), len(told))
        order = np.argsort(keys)
        index, values = Index(keys[order]), [v[order] for v in values]
        parts = []
        for lo, hi, buf, offs in slices(left.column("text"), LOOK_BYTES):
            parts.append(score(left.slice(lo, hi - lo), buf, offs, index, *values))
        return pa.concat_tables(parts)

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def placed(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted key's index in sorted keys, their number where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int = 0) -> np.ndarray:
    return np.append(values, missing)[placed(keys, wanted)]
