"""Byte-level BPE of whole texts: ranked merges folded by Spark's higher-order functions over distinct words.

A task splits its texts by the tokenizer's pattern, once, into *chunks* of bounded size: the chunk's distinct words and, for each text,
the places of its words among them.  The pattern ``RUNS`` is followed on arrays of a slice's code points, where its
words are told apart by hash and compared byte by byte; any other pattern, and a very long text, goes through ``regex``.
Only the words and places travel, compressed; no text does.  The words of all chunks are sorted together, the fold
runs on the first of equal words, and every chunk gets the ids of its own words back, to put its documents together.  So a word is
folded once however many chunks hold it, no occurrence is shuffled and no vocabulary is broadcast.

A word is an array of ids, at first those of its bytes.  A fold over its length joins, each time, the leftmost neighbouring pair of the least rank.
Ranks of pairs come from a literal map: for every way to cut a token into two tokens, (left, right) -> rank, laid out as one constant array by
a perfect hash, because a map literal is searched from its start.  A word that is a rank itself is that token at once, as in the library.
Pieces join to bytes again in decoding.  Words of more than ``LONG_WORD`` bytes, whose fold would take
the square of their length, are merged with a heap where their document is put together; results are the same.
Any other word that has no ids there is an error.

Edge cases: a null or empty text has no tokens: 0, and the digests of the empty string.  Special tokens are ordinary text.  A null doc_id is
kept.  Repeated rows are encoded one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import begins_of
from .textkit import slices, span_hashes

LONG_WORD = 512
WHOLE_ROWS = 1 << 16
#: A chunk ends once it is found over either number.
CHUNK_WORDS, CHUNK_PLACES = 500_000, 16_000_000
#: Words that a task holds before it hands their ids on.
HELD = 1 << 20
BLOCK = 1 << 16
LONG_TEXT = 1 << 20
#: Ranks are below 2**BITS; 2**BITS - 1 stands beyond a word's ends.
BITS = 17
EDGE = (1 << BITS) - 1
#: A piece's first byte is below 2**AT_BITS.
AT_BITS = 10
LOOK_BYTES = 1 << 18
#: Words, distinct in what was looked at in one go, that wait to be numbered.
MERGED = 1 << 18
#: The pattern that ``cut_words`` follows.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if max(ranks.values(), default=0) >= EDGE:
        raise ValueError(f"ranks must be below {EDGE}")
    return ranks


@functools.lru_cache(maxsize=4)
def _perfect(path: str) -> tuple[list[int], list[int], int]:
    """(shift by bucket, slots, size): a pair's number is left << BITS | right; number << BITS | rank is in slot number % size + shift[number % len(shift)]."""
    ranks = read_ranks(path)
    pairs = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                pairs[a << BITS | b] = rank
    size, buckets = 3 * len(pairs) // 2 | 1, len(pairs) // 3 | 1
    while math.gcd(size, buckets) > 1:
        size += 2
    members: list[list[int]] = [[] for _ in range(buckets)]
    for number in pairs:
        members[number % buckets].append(number)
    slots, shift = [-1] * (2 * size), [0] * buckets
    for j in sorted(range(buckets), key=lambda x: -len(members[x])):
        home = [number % size for number in members[j]]
        if len(set(home)) < len(home):
            raise ValueError("two pairs share both hashes")
        s = 0
        while any(slots[x + s] >= 0 for x in home):
            s += 1
        shift[j] = s
        for x, number in zip(home, members[j], strict=True):
            slots[x + s] = number << BITS | pairs[number]
    return shift, slots[: size + max(shift)], size


def _numbers(values: list[int], kind: str = "int") -> Column:
    """An array that Spark folds to a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def whole_literal(ranks: dict[bytes, int]) -> Column:
    """array<string> by crc32(hex) modulo WHOLE_ROWS, each ``|hex=rank|hex=rank|``, as a constant that Spark folds."""
    rows = ["|"] * WHOLE_ROWS
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        rows[zlib.crc32(h.encode()) % WHOLE_ROWS] += f"{h}={rank}|"
    return F.split(F.lit(",".join(rows)), ",")


def _bind(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_column(word: Column, path: str) -> Column:
    """The ranks of a binary word, as array<int>; each literal stands in the plan once and is bound to a variable."""
    shift, slots, size = _perfect(path)
    ranks = read_ranks(path)
    one = [ranks.get(bytes([i]), EDGE) for i in range(256)]
    two = [ranks.get(bytes([i, j]), EDGE + 1) for i in range(256) for j in range(256)]
    literals = F.struct(_numbers(shift).alias("shift"), _numbers(slots, "long").alias("slots"), _numbers(one).alias("one"), _numbers(two).alias("two"), whole_literal(ranks).alias("whole"))
    return _bind(literals, lambda t: _encode(word, t, len(shift), size))


def _encode(word: Column, table: Column, buckets: int, size: int) -> Column:
    none, ahead = 1 << BITS, F.lit(1 << BITS + AT_BITS).cast("long")

    def rank(a: Column, b: Column) -> Column:
        """The pair's rank, or something from 2**BITS on: what is in its slot less what it would be at rank 0."""
        number = a * F.lit(none).cast("long") + b
        at = number % F.lit(size) + F.get(table["shift"], (number % F.lit(buckets)).cast("int"))
        return F.least(F.pmod(F.get(table["slots"], at.cast("int")) - number * F.lit(none), F.lit(1 << 3 * BITS)), F.lit(none))

    def tail(number: Column) -> Column:
        return number.bitwiseAND((1 << BITS + AT_BITS) - 1)

    def step(e: Column, _: Column) -> Column:
        """e: pieces between two edges; only the ranks beside a merge are looked up again.

        A piece is one number: the rank of its pair with the next one, its first byte and its id.  Equal ranks may come from
        different pairs: the least number is the leftmost.
        """

        def merged(low: Column) -> Column:
            least = F.shiftright(low, BITS + AT_BITS)

            def put(at: Column) -> Column:
                """at: the left neighbour's index from 0; then come the pair's two pieces and the right neighbour."""
                right = F.element_at(e, at + 4).bitwiseAND(EDGE)

                def new(x: Column, i: Column) -> Column:
                    beside = rank(x.bitwiseAND(EDGE), least) * ahead + tail(x)
                    joined = rank(least, right) * ahead + tail(x) - x.bitwiseAND(EDGE) + least
                    return F.when(i == at, beside).when(x == low, joined).otherwise(x)

                # no piece but the pair's second has its number; one pass costs less than slices and their concatenation
                return F.array_remove(F.transform(e, new), F.element_at(e, at + 3))

            return F.when(least < none, _bind(F.array_position(e, low).cast("int") - 2, put)).otherwise(e)

        return _bind(F.array_min(e), merged)

    def fold(code: Column) -> Column:
        """The bytes' numbers to ids."""
        edge = F.array((ahead * none + EDGE).cast("long"))
        pair = lambda a, i: F.coalesce(F.get(table["two"], a * 256 + F.get(code, i + 1)), F.lit(none))
        ids = F.transform(code, lambda a, i: pair(a, i) * ahead + i * F.lit(none) + F.get(table["one"], a))
        done = F.aggregate(F.slice(code, F.lit(2), F.size(code)), F.concat(edge, ids, edge), step)
        return F.transform(F.slice(done, F.lit(2), F.size(done) - 2), lambda x: x.bitwiseAND(EDGE).cast("int"))

    code = F.transform(F.split(F.decode(word, "ISO-8859-1"), F.lit("")), lambda c: F.ascii(c))
    text = F.hex(word)
    row = F.get(table["whole"], (F.crc32(text.cast("binary")) % WHOLE_ROWS).cast("int"))
    mark = F.concat(F.lit("|"), text, F.lit("="))
    at = F.substring_index(F.call_function("substring_index", row, mark, F.lit(-1)), "|", 1).cast("int")
    return F.when(F.contains(row, mark), F.array(at)).otherwise(_bind(code, fold))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev = [i + 1 for i in range(n)], [i - 1 for i in range(n)]
    alive = [True] * n
    get = lambda i: ranks.get(word[i : end[end[i]]]) if end[i] < n else None
    heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := get(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or ranks.get(word[i:stop]) != r:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        for j in (prev[i], i):
            if j >= 0 and (q := get(j)) is not None:
                heapq.heappush(heap, (q, j, end[end[j]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _joined(buf: np.ndarray, size: np.ndarray) -> bytes:
    """Words with their lengths, in one compressed string."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.concatenate([[len(size)], size]).astype("<u4").tobytes() + buf.tobytes())


def _parted(packed: bytes) -> tuple[bytes, np.ndarray]:
    """The words' bytes, and each word's first (one more entry than words)."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return raw[4 * n + 4 :], np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))])


CHUNKS = "chunk long, doc_id array<long>, n_words array<long>, places binary, words binary"


@functools.cache
def _kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER by code point, as the pattern's classes have them."""
    import regex

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for first, stop in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, stop)))
        for kind, of in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(of, every):
                out[first + m.start() : first + m.end()] = kind
    return out


def cut_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of ``RUNS`` begin in the rows' bytes, and each row's first match; both with the end after the last.

    A match is a run of one kind, with the space before it.  Of white space before something else the last character stands alone, and
    is that space if it is one.  An apostrophe that begins a match takes the letters of its contraction from the run after it.
    """
    if (buf < 128).all():
        point, lead = buf, None
    else:
        point = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        offs = np.searchsorted(lead, offs)
    n = len(point)
    kind = _kinds()[point]
    head = np.zeros(n + 3, dtype=bool)
    head[offs] = True
    space, other = kind == SPACE, np.zeros(n + 3, dtype=bool)
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~head[1 : n + 1]
    begins = np.zeros(n + 3, dtype=bool)
    begins[1:n] = (kind[1:] != kind[:-1]) & (point[:-1] != 32)
    begins[:n] |= last
    begins |= head
    other[:n] = point == 39
    at = np.flatnonzero(other & begins)
    if len(at):
        padded = np.concatenate([point, np.zeros(3, point.dtype)])
        # a letter beyond the row's end is none of it
        one = np.where(head[at + 1], 0, padded[at + 1])
        two = np.where(head[at + 1] | head[at + 2], 0, padded[at + 2])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        begins[at + 1] = False
        begins[at + size] = True
    start = np.flatnonzero(begins[: n + 1])
    first = np.searchsorted(start, offs)
    return (start if lead is None else np.append(lead, len(buf))[start]), first


def _at(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... size[0] numbers, then the same from first[1], and so on."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _bytes_of(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words' bytes, one after the other."""
    return buf[_at(start, size)]


def _groups(buf: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal words each, and every word's index among those; words follow each other in ``buf``."""
    order = np.argsort(hashes)
    begins = begins_of(hashes[order])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(order)))
    one = np.minimum.reduceat(order, begins) if len(order) else order
    like = one[group]
    if (size != size[like]).any() or (buf != buf[np.arange(len(buf)) + np.repeat(start[like] - start, size)]).any():
        # two words share a hash
        raw, seen = buf.tobytes(), {}
        group = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
        one = np.unique(group, return_index=True)[1]
    return one, group


class Numbers:
    """Distinct words, numbered as they come, and the numbers of all words in ``places``."""

    def __init__(self) -> None:
        self.buf, self.size, self.hash = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.places: list[np.ndarray] = []
        self.held = self.unmerged = 0

    def add(self, buf: np.ndarray, size: np.ndarray) -> None:
        """Words that follow each other in ``buf``."""
        start = np.cumsum(size) - size
        hashes = span_hashes(buf, start, start + size)
        one, group = _groups(buf, start, size, hashes)
        self.waiting.append((_bytes_of(buf, start[one], size[one]), size[one], hashes[one], group.astype("<u4")))
        self.held += len(size)
        self.unmerged += len(one)
        if self.unmerged > MERGED:
            self.merge()

    def merge(self) -> None:
        buf, size, hashes = (np.concatenate([x, *(w[i] for w in self.waiting)]) for i, x in enumerate((self.buf, self.size, self.hash)))
        start, at = np.cumsum(size) - size, len(self.size)
        one, group = _groups(buf, start, size, hashes)
        kept = np.sort(one)
        number = np.empty(len(size), dtype="<u4")
        number[kept] = np.arange(len(kept))
        number = number[one[group]]
        for _, mine, _, where in self.waiting:
            self.places.append(number[at : at + len(mine)][where])
            at += len(mine)
        self.buf, self.size, self.hash = _bytes_of(buf, start[kept], size[kept]), size[kept], hashes[kept]
        self.waiting, self.unmerged = [], 0


def _split(pattern: str):
    """(doc_id, text) to chunks: documents, the compressed places of their words, and the compressed distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        split = regex.compile(pattern)
        part, made = TaskContext.get().partitionId(), 0
        known = Numbers()
        docs: list[int | None] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            known.merge()
            packed = _joined(known.buf, known.size)
            flat = np.concatenate([np.zeros(0, "<u4"), *known.places])
            row = zstandard.ZstdCompressor(level=3).compress(flat.tobytes())
            # what a chunk holds is part of its name: one that a lost task deals otherwise meets no answers, which is an error
            seal = hashlib.sha256(b"%d %d " % (part, made) + packed + row).digest()
            chunk = int.from_bytes(seal[:8], "little", signed=True)
            cols = [pa.array([chunk], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([row], pa.binary()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "doc_id", "n_words", "places", "words"])

        def one_by_one(buf: np.ndarray, offs: np.ndarray) -> list[int]:
            """The numbers of words of each row in turn; of a very long text they are never all held."""
            many = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                found, n = (m.group().encode() for m in split.finditer(buf[a:b].tobytes().decode())), 0
                while block := list(islice(found, BLOCK)):
                    known.add(np.frombuffer(b"".join(block), np.uint8), np.array([len(w) for w in block]))
                    n += len(block)
                many.append(n)
            return many

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in slices(batch.column(1), LOOK_BYTES):
                if pattern == RUNS and 0 < len(buf) < LONG_TEXT:
                    start, first = cut_words(buf, offs)
                    known.add(buf, np.diff(start))
                    sizes += np.diff(first).tolist()
                else:
                    sizes += one_by_one(buf, offs)
                docs += ids[lo:hi]
                if len(known.size) > CHUNK_WORDS or known.held > CHUNK_PLACES:
                    yield out()
                    known, docs, sizes, made = Numbers(), [], [], made + 1
        if docs:
            yield out()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place, word) of the words that are to be folded."""
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
            raw, first = _parted(packed.as_py())
            place = np.flatnonzero(np.diff(first) <= LONG_WORD)
            words = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(raw)])
            for lo in range(0, len(place), BLOCK):
                some = place[lo : lo + BLOCK]
                word = words.take(pa.array(some)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some.astype(np.int32)), word], ["chunk", "place", "word"])


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, place, ids), in which a row without ids has the last ones before it, to one compressed row for each chunk."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    last = np.zeros(0, "<u4")
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        chunk, place, size, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin = np.cumsum(size) - size
        order = np.argsort(chunk, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], chunk[order][1:] != chunk[order][:-1], [True]]))
        rows = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mine = order[lo:hi]
            n = size[mine]
            ids = flat[_at(begin[mine], n)]
            rows.append(press.compress(np.concatenate([[len(mine)], place[mine], n, ids]).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(chunk[order][edge[:-1]]), pa.array(rows, pa.binary())], ["chunk", "answers"])

    for batch in batches:
        if not len(batch):
            continue
        lists = batch.column(2)
        values, many = lists.flatten().to_numpy().astype("<u4"), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        values = np.concatenate([last, values])
        start = np.cumsum(many) - many + len(last)
        own = np.asarray(lists.is_valid())
        owner = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
        begin, size = np.where(owner >= 0, start[owner], 0), np.where(owner >= 0, many[owner], len(last))
        flat = values[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        last = flat[len(flat) - size[-1] :]
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), size, flat))
        held += len(batch)
        if held > HELD:
            yield out()
            parts, held = [], 0
    if parts:
        yield out()


def _by_id(tokens: dict[int, bytes]) -> pa.Array:
    """Each id's bytes in its own place."""
    return pa.array([tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)], pa.large_binary())


def _words_of(tokens: pa.Array, flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """What the tokens of every word give when joined; ``first`` has one more entry than words."""
    _, offs, data = tokens.take(pa.array(flat)).buffers()
    offs = np.frombuffer(offs, np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offs[first]), data or pa.py_buffer(b"")])


def _digests(words: pa.Array, places: np.ndarray, end: np.ndarray, spare: int) -> list[str]:
    """SHA-256 of each document's words, joined, without the last ``spare`` bytes; a document's words end at ``end`` in ``places``."""
    out = [hashlib.sha256() for _ in end]
    begin = np.concatenate([[0], end[:-1]])
    for lo in range(0, len(places), BLOCK):
        some = places[lo : lo + BLOCK]
        _, offs, data = words.take(pa.array(some)).buffers()
        offs, view = np.frombuffer(offs, np.int64, len(some) + 1), memoryview(data)
        # the documents with words here, among them empty ones
        doc = np.arange(np.searchsorted(end, lo, "right"), np.searchsorted(begin, lo + len(some), "left"))
        start, stop = np.maximum(begin[doc] - lo, 0), np.minimum(end[doc] - lo, len(some))
        last = (end[doc] <= lo + len(some)) & (stop > start)
        for d, x, y in zip(doc.tolist(), offs[start].tolist(), (offs[stop] - spare * last).tolist(), strict=True):
            out[d].update(view[x:y])
    return [h.hexdigest() for h in out]


def _assembled(shared):
    """A chunk's documents from its places and the ids of its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        ranks, pieces, numbers = shared.value
        plain = zstandard.ZstdDecompressor()
        raw, first = _parted(left.column("words")[0].as_py())
        size = np.zeros(len(first) - 1, dtype=np.int64)
        parts = []
        for packed in right.column("answers"):
            got = np.frombuffer(plain.decompress(packed.as_py()), "<u4").astype(np.int64)
            m = int(got[0])
            parts.append((got[1 : m + 1], got[m + 1 : 2 * m + 1], got[2 * m + 1 :]))
        for place in np.flatnonzero(np.diff(first) > LONG_WORD).tolist():
            ids = np.array(merge_long(raw[first[place] : first[place + 1]], ranks))
            parts.append((np.array([place]), np.array([len(ids)]), ids))
        for place, many, _ in parts:
            size[place] = many
        if not size.all():
            raise ValueError("a chunk has words without ids: its rows were dealt differently when it was worked out again")
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(first[-1], dtype=np.int64)
        for place, many, ids in parts:
            flat[_at(first[place], many)] = ids
        del parts, raw
        places = np.frombuffer(plain.decompress(left.column("places")[0].as_py()), "<u4")
        docs, end = left.column("doc_id")[0].as_py(), np.cumsum(left.column("n_words")[0].values.to_numpy())
        tokens = np.concatenate([[0], np.cumsum(size[places])])[np.concatenate([[0], end])]
        # a number is followed by a space, the last one's is spare
        cols = [pa.array(docs, pa.int64()), pa.array(np.diff(tokens)), pa.array(_digests(_words_of(numbers, flat, first), places, end, 1)), pa.array(_digests(_words_of(pieces, flat, first), places, end, 0))]
        return pa.table(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    ranks = read_ranks(rank_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, _by_id({i: p for p, i in ranks.items()}), _by_id({i: b"%d " % i for i in ranks.values()})))
    chunks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_split(pattern), CHUNKS).repartition("chunk")
    # both uses of ``chunks`` read all its columns, so that Spark shuffles it once and reuses the exchange
    asked = chunks.mapInArrow(_asked, "chunk long, place int, word binary")
    nth = F.row_number().over(Window.partitionBy("word").orderBy("chunk"))
    folded = asked.withColumn("nth", nth).select("chunk", "place", F.when(F.col("nth") == 1, encode_column(F.col("word"), rank_path)).alias("ids"))
    answers = folded.mapInArrow(_handed, "chunk long, answers binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assembled(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
