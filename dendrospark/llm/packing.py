"""Mixture-controlled packing of token sequences.

Every source is a queue of documents in row order.  Deficit round-robin fills windows of
``window_sequences`` x ``seq_len`` tokens: each window grants a source its quantum (window size times the source's target
share), a source sends whole documents while its balance is positive, and what a document
overdraws is carried to the next window as a deficit.  The window of a document therefore
follows from its queue's running token count k alone: the number of whole quanta in k.  So windows are found from
prefix sums, deficits carry across windows and across partitions exactly, and the realised mixture of any run of
windows is off by less than one document a source.  Within a window the sources follow each other.  The token stream is then cut every ``seq_len``
tokens; what is left at its very end is cut into sequences of power-of-two lengths.  There is no padding.

Prefix sums have two levels (per block, then within a block), so no task holds a whole queue.

Targets: a share by source; by default each source's share of all tokens, so that all
queues run out together.  A source without target gets its natural share.  With given targets a queue that runs out
leaves its part of later windows to the others.

Edge cases: a null or blank text has no ids and is just its end token.  The strings of special tokens in a text get their ids.  Null sources are one queue.
Rows are packed one by one whatever their doc_id, repeated or null.  No rows: no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .textkit import Words, slices, span_hashes, words

SEQ_LEN = 4096
END_ID = 2
#: Distinct words that a worker keeps the ids of; beyond it starts anew.
CACHED_WORDS = 3_000_000
#: Words of letters that are encoded as one text.
BATCH_WORDS = 256


#: Kinds of bytes in plain words: letters (those from U+00C0 to U+00FF are 0xC3 and a second byte), digits, the rest.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_KIND[48:58] = 2


def _plain_words(buf: np.ndarray, offs: np.ndarray, special: list[tuple[int, int]]) -> tuple[np.ndarray, Words, np.ndarray]:
    """Words cut down to fewer distinct ones with the same ids, and which of them are lower-case letters only.

    A plain word has printable ASCII and letters from U+00C0 to U+00FF only.  It is put in lower case, as the tokenizer has no other, and cut where letters,
    digits and other characters meet and between digits, as the tokenizer's pattern splits there, but for letters after an apostrophe.
    A word that may hold a special token, whose first two bytes are in ``special``, stays as it is, and so do all words that are not plain.
    """
    w = words(buf, offs, lower=False, hashed=False)
    second = np.zeros(len(buf), dtype=bool)
    second[1:] = buf[:-1] == 0xC3
    odd = (buf < 33) | (buf == 127) | ((buf >= 128) & (buf != 0xC3) & ~second) | (second & ((buf == 0x97) | (buf == 0xB7)))
    for one, two in special:
        odd[:-1] |= (buf[:-1] == one) & (buf[1:] == two)
    count = np.concatenate([[0], np.cumsum(odd)])
    is_plain = count[w.end] == count[w.start]
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[w.start[is_plain]] += 1
    edge[w.end[is_plain]] -= 1
    plain = np.cumsum(edge, dtype=np.int8)[:-1] > 0
    upper = plain & (((buf >= 65) & (buf <= 90)) | (second & (buf >= 0x80) & (buf <= 0x9E)))
    buf = np.where(upper, buf + 32, buf).astype(np.uint8)
    kind = _KIND[buf]
    cut = plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~((buf[:-1] == 39) & (kind[1:] == 1))
    begins, ends = np.zeros(len(buf) + 1, dtype=bool), np.zeros(len(buf) + 1, dtype=bool)
    begins[w.start] = ends[w.end] = True
    begins[1:-1] |= cut
    ends[1:-1] |= cut
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offs, "left")
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return buf, Words(doc, start, end, span_hashes(buf, start, end), first), plain[start] & (kind[start] == 1)


class WordTokens:
    """Ids of texts by a tokenizer for which white space only separates, by distinct word.

    Each distinct word (by hash) is encoded once and its ids are kept, so the cost follows the vocabulary.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same model behind white space only, for words of lower-case letters, which the rest of the tokenizer leaves alone
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # special tokens in a text get their own ids, as the library's call gives them
        added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        if any(len(t) < 2 or any(b in b" \t\n\x0b\x0c\r" for b in t) for t in added):
            raise ValueError("a special token of one byte or with white space can't be found word by word")
        self.special = sorted({(t[0], t[1]) for t in added})
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def learn(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        at = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.at, self.size = all_keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, flat])

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and how many each has."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint16, int(size.sum())), size

    def ids_of_letters(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of lower-case letters, many at once: an id with the suffix of word ends closes each."""
        size = end - start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        joined = np.full(begin[-1], 32, dtype=np.uint8)
        inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        here = inner < np.repeat(size - 1, size)
        joined[here] = buf[(np.repeat(start, size) + inner)[here]]
        raw = joined.tobytes()
        at = begin[:: BATCH_WORDS].tolist()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
        found = [np.array(e.ids, dtype=np.uint16) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint16), *found])
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(start):
            return self.ids_of([raw[a : b - 1].decode("utf-8") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
        return flat, np.diff(np.concatenate([[-1], last]))

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each row's followed by end_id, and each row's first."""
        buf, w, letters = _plain_words(buf, offs, self.special)
        uniq, some, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHED_WORDS:
            self.forget()
        i = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = self.keys[i] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if new.any():
            easy, hard = some[new & letters[some]], some[new & ~letters[some]]
            if len(easy):
                self.learn(w.hash[easy], *self.ids_of_letters(buf, w.start[easy], w.end[easy]))
            if len(hard):
                raw = buf.tobytes()
                self.learn(w.hash[hard], *self.ids_of([raw[a:b].decode("utf-8") for a, b in zip(w.start[hard].tolist(), w.end[hard].tolist(), strict=True)]))
        i = np.searchsorted(self.keys, uniq)
        at, size = self.at[i][which], self.size[i][which]
        n = len(offs) - 1
        word_first = np.concatenate([[0], np.cumsum(size)])
        first = word_first[w.first] + np.arange(n + 1)
        out = np.full(first[-1], end_id, dtype=np.uint16)
        inner = np.repeat(at - word_first[:-1], size) + np.arange(word_first[-1])
        out[np.arange(word_first[-1]) + np.repeat(w.doc, size)] = self.flat[inner]
        return out, first


_tokens: dict[str, WordTokens] = {}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                ids, first = _tokens[path].encode(buf, offs, end_id)
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((first * 2).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), packed], ["doc_id", "source", "doc_tokens", "ids"])

    return run


def _sequence_starts(total: int, seq_len: int) -> list[int]:
    """Where the sequences of powers of two begin that hold the last total % seq_len tokens."""
    out, at, rest = [], total - total % seq_len, total % seq_len
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def _pieces(seq_len: int, total: int):
    tail = np.array(_sequence_starts(total, seq_len), dtype=np.int64)
    body = total - total % seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            rows, out = [], {k: [] for k in ("start", "length", "crc", "seq", "off")}
            for r, (g, raw) in enumerate(zip(at.tolist(), batch.column(2), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                stop = g + len(ids)
                cuts = [g, *range(g - g % seq_len + seq_len, min(stop, body + 1), seq_len), *(t for t in tail.tolist() if g < t < stop), stop]
                cuts = sorted(set(cuts))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append(r)
                    out["start"].append(a - g)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(ids[a - g : b - g].tobytes()))
                    if a < body:
                        out["seq"].append(a // seq_len)
                        out["off"].append(a % seq_len)
                    else:
                        j = int(np.searchsorted(tail, a, "right")) - 1
                        out["seq"].append(body // seq_len + j)
                        out["off"].append(a - int(tail[j]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(4).take(take), batch.column(5).take(take), batch.column(1).take(take), *(pa.array(out[k], pa.int64()) for k in out)], ["doc_id", "source", "window_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, seq_len: int = SEQ_LEN, window_sequences: int = 16, end_id: int = END_ID, super_windows: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window_id."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    kinds = "doc_id long, source string, doc_tokens long, ids binary"
    coded = docs.select(F.col("doc_id").cast("long"), source.alias("source"), "text").mapInArrow(_encode(tokenizer_path, end_id), kinds)
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()), "pack-ids")
    light = coded.select("row", F.shiftright("row", 33).alias("block"), F.coalesce("source", F.lit("\0null")).alias("queue"), "doc_tokens")
    blocks = light.groupBy("queue", "block").agg(F.sum("doc_tokens").alias("n"))
    queues = light.groupBy("queue").agg(F.sum("doc_tokens").alias("queue_tokens"))
    total = queues.agg(F.sum("queue_tokens")).first()[0] or 0
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("queue", "block", "base")
    share = F.col("queue_tokens") / F.lit(float(max(total, 1)))
    if targets:
        given = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))))
        share = F.coalesce(F.element_at(given, F.col("queue")), share)
    queues = queues.select("queue", (share * F.lit(float(window_sequences * seq_len))).alias("quantum"))
    within = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("k", F.coalesce(F.sum("doc_tokens").over(within), F.lit(0))).join(blocks, ["queue", "block"]).join(queues, "queue")
    placed = placed.withColumn("k", F.col("k") + F.col("base")).withColumn("window_id", F.floor(F.col("k") / F.col("quantum")))
    placed = cut(placed.select("row", "queue", "window_id", "k", "doc_tokens"), "pack-windows")
    parts = placed.groupBy("window_id", "queue").agg(F.min("k").alias("k0"), F.sum("doc_tokens").alias("n")).withColumn("super", F.floor(F.col("window_id") / super_windows))
    supers = parts.groupBy("super").agg(F.sum("n").alias("n"))
    above = Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("super", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("super_base"))
    inside = Window.partitionBy("super").orderBy("window_id", "queue").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_base", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(supers, "super")
    parts = parts.select("window_id", "queue", "k0", (F.col("part_base") + F.col("super_base")).alias("base"))
    at = placed.join(parts, ["window_id", "queue"]).select("row", "window_id", (F.col("base") + F.col("k") - F.col("k0")).alias("at"))
    joined = coded.join(at.hint("merge"), "row").select("doc_id", "doc_tokens", "ids", "at", "source", "window_id")
    out = joined.mapInArrow(_pieces(seq_len, int(total)), "doc_id long, source string, window_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id")
