"""Cases beside the common fixture: shuffled inputs, clashing names, special tokens, hot keys, empty tables."""

import hashlib
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dendrospark.llm import bpe, packing, passages, quality, secrets, skew, topk, toxicity, warc


def prose(seed, n):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, n)]


def test_archive_of_a_shuffled_input_keeps_every_payload(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i % 70}</p>" * (1 + i % 70 * 30)) for i in range(400)] + [(None, None, None), (7, "http://x/7", "<p>7</p>" * 211), (400, "http://x", "é" * 300_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    headers, blobs = warc.archive(table)
    assert blobs.count() == len({h or "" for *_, h in pages})
    got = warc.parse(warc.records(headers, blobs)).collect()
    size = {}
    for i, _, h in pages:
        size[i] = len((h or "").encode())
    assert len(got) == len(pages) and all(r.payload_bytes == size[r.page_id] and len(r.payload_digest) == 40 for r in got)
    assert headers.where("decode(header, 'UTF-8') not like '%WARC-Date: ____-__-__T__:__:__Z%'").count() == 0


def test_packing_gives_special_tokens_their_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|startoftext|> x", "<|ENDOFTEXT|> Q.", "Ünïcode, CAPS. stop.", "<|endoftext|>.", "end.<|", "v1.2,3"]
    got = {r.doc_id: r.doc_tokens for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    words = packing.WordTokens(path)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = words.encode(raw, np.array([0, len(raw)]), 2)
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_packing_cuts_words_where_the_tokenizer_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = np.random.default_rng(5)
    signs = [*"abzEST019.,!'$&<|>-_\x01\x1c\x7f \n", "é", "É", "ß", "×", "÷", "Þ", "ÿ", "e\u0301", "J\u030c", "\u0338", "K", "İ", "Σ", "\u00a0", "\u0085", "中", "٣", "²", "<|endoftext|>", "'s", "'ll", "'T", "😀"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(6000)] + ["don't 'tis x'S 1'2 a1b22 É\u0301a", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, first = words.encode(raw, offs, 2)
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t
    words.forget()
    raw = np.frombuffer(b"Stop stop$$$ stop!! stop12 (stop)", np.uint8)
    words.encode(raw, np.array([0, len(raw)]), 2)
    assert len(words.keys) == 7


def test_packing_follows_given_targets(spark):
    rows = [(i, " ".join(prose(i, 60)), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), targets={"a": 0.75, "b": 0.25}, window_sequences=2).toPandas()
    first = pieces[pieces.window_id < 3]
    share = first[first.source == "a"].length.sum() / first.length.sum()
    assert abs(share - 0.75) < 0.03 and pieces.length.sum() == pieces.groupby("doc_id").doc_tokens.first().sum()


def test_the_fit_holds_its_bags_and_little_more():
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"{a:x}" for a in rng.integers(1 << 24, 1 << 32, 900)) for _ in range(600)])
    tracemalloc.start()
    held = toxicity.bags(texts, toxicity.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = held.ids.nbytes + held.coef.nbytes
    assert len(held.first) == 601 and held.first[-1] == len(held.ids) and size > 30 << 20
    assert peak < size + (128 << 20), peak - size


def test_scoring_holds_little_and_no_score_depends_on_its_neighbours():
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"{a:x}" for a in rng.integers(1 << 24, 1 << 32, 900)) for _ in range(600)] + ["", None])
    unit = rng.normal(0, 1, toxicity.BUCKETS)
    alone = np.concatenate([toxicity._scores(texts[i : i + 1], unit, 0.1, 0.5) for i in range(len(texts))])
    tracemalloc.start()
    score = toxicity._scores(texts, unit, 0.1, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score == alone).all()
    assert peak < 64 << 20, peak


def test_bpe_puts_documents_together_without_a_call_for_each_word(monkeypatch):
    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in range(20000)] + [b"w" * 600]
    numbers = {bytes([i]): 3 * i for i in range(256)}
    ids = [[numbers[w[i : i + 1]] for i in range(len(w))] for w in words]
    many = [0, 150, 0, 0, 1, *rng.integers(0, 900, 60).tolist(), 0]
    places = rng.integers(0, len(words), sum(many)).astype("<u4")
    pack = zstandard.ZstdCompressor().compress
    left = pa.table({"chunk": [1], "doc_id": [[None, *range(1, len(many))]], "n_words": [many], "places": [pack(places.tobytes())], "words": [bpe._joined(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))]})
    parts = [rng.permutation(20000)[:12000], None]
    parts[1] = np.setdiff1d(np.arange(20000), parts[0])
    answers = [pack(np.concatenate([[len(x)], x, [len(ids[i]) for i in x], np.concatenate([ids[i] for i in x])]).astype("<u4").tobytes()) for x in parts]
    right = pa.table({"chunk": [1, 1], "answers": pa.array(answers, pa.binary())})
    run = bpe._assembled(SimpleNamespace(value=(numbers, bpe._by_id({i: p for p, i in numbers.items()}), bpe._by_id({i: b"%d " % i for i in numbers.values()}))))
    want, at = [], 0
    for d, n in enumerate(many):
        mine = places[at : at + n]
        at += n
        flat = [i for w in mine for i in ids[w]]
        want.append((d or None, len(flat), hashlib.sha256(" ".join(map(str, flat)).encode()).hexdigest(), hashlib.sha256(b"".join(words[w] for w in mine)).hexdigest()))
    made = [0]

    def count(frame, event, arg):
        made[0] += event in ("call", "c_call")

    monkeypatch.setattr(bpe, "merge_long", lambda word, ranks: ids[-1])
    sys.setprofile(count)
    got = run(left, right)
    sys.setprofile(None)
    assert made[0] < 3000, made
    assert [tuple(r.values()) for r in got.to_pylist()] == want
    monkeypatch.setattr(bpe, "BLOCK", 100)
    assert run(left, right) == got


def test_the_fold_merges_repetitive_words_as_the_heap_does(spark):
    rng = np.random.default_rng(6)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    words = [bytes(rng.choice(list(letters), n).tolist()) for letters in (b"a", b"ab", b" the", b"=-", bytes(range(256))) for n in (2, 3, 17, 64, 512)]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", bpe.encode_column(F.col("word"), path).alias("ids")).collect()
    assert len(got) == len(words) and all(r.ids == bpe.merge_long(bytes(r.word), ranks) for r in got)


def test_two_documents_share_what_older_ones_have_in_halves(spark):
    p = prose(1, 70)
    data = {1: prose(2, 20) + p[:35] + prose(3, 20), 2: prose(4, 20) + p[35:] + prose(5, 20), 3: prose(6, 20) + p + prose(7, 20), 4: prose(8, 9) + p + prose(9, 30)}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in data.items()], "doc_id long, text string")).collect()
    assert any((r.doc_id, r.anchor_id) == (4, 3) and r.end_word - r.start_word >= 70 for r in found)


def test_edited_passages_are_found(spark):
    rng = np.random.default_rng(3)
    data, n = [], 60
    for i in range(n):
        p = prose(100 + i, 80)
        q = list(p)
        for at in rng.choice(80, 8, replace=False):
            q[at] = f"edit{i}x{at}"
        data += [(2 * i, " ".join(prose(300 + i, 30) + p)), (2 * i + 1, " ".join(prose(500 + i, 40) + q + prose(700 + i, 20)))]
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(found) >= 0.9 * n and all(d % 2 for d in found)


def test_edited_passages_are_found_though_older_documents_hold_their_parts(spark):
    data, pairs, i = [], [], 0
    for case in range(60):
        rng = np.random.default_rng(4000 + case)
        p = prose(5000 + case, 90)
        q = list(p)
        for at in rng.choice(90, 6, replace=False):
            q[at] = f"edit{case}x{at}"
        parts = [[p[:45], p[45:]], [p[:30], p[30:60], p[60:]], [p[22:68]]][case % 3]
        for words in (*parts, p, q):
            data.append((i, " ".join(prose(6000 + i, 25) + words + prose(9000 + i, 30))))
            i += 1
        pairs.append((i - 1, i - 2))
    found = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.anchor_id) for r in found if r.end_word - r.start_word >= 60}
    assert len(got & set(pairs)) >= 0.95 * len(pairs)


def test_all_but_the_first_of_a_large_group_meet_more_than_the_anchor(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", 2)
    p = prose(1, 90)
    q = [f"edit{i}" if i % 15 == 7 else w for i, w in enumerate(p)]
    data = [(i, " ".join(prose(3000 + i, 30) + p[30:60] + prose(4000 + i, 30))) for i in range(9)]
    data += [(20, " ".join(prose(1, 90))), (21, " ".join(prose(8, 20) + q + prose(9, 20)))]
    found = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert any((r.doc_id, r.anchor_id) == (21, 20) and r.end_word - r.start_word >= 60 for r in found)


def test_hot_passages_split_into_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT_ROWS", 20)
    p = prose(1, 60)
    data = [(i, " ".join(prose(1000 + i, 10) + p + prose(2000 + i, 10))) for i in range(80)]
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).where("anchor_id = 0 and end_word - start_word >= 60").collect()}
    assert found == set(range(1, 80))


def test_spans_are_cut_whatever_the_columns_are_called(spark):
    words = prose(1, 100)
    docs = spark.createDataFrame([(1, "x", " ".join(words), 5)], "doc_id long, _doc string, text string, spans int").withColumn("other", F.lit(1)).withColumn("a.b", F.lit(2))
    spans = spark.createDataFrame([(1, 10, 70), (1, 60, 80), (1, 95, 300)], "doc_id long, start_word long, end_word long")
    out = passages.without_passages(docs, spans)
    assert out.columns == docs.columns and out.first().text.split() == words[:10] + words[80:95]


def test_spread_join_equals_a_join(spark):
    big = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 1 else id % 50 end k")
    small = spark.range(40).selectExpr("id k", "id * 10 v")
    many = skew.hot(big.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], task_rows=200)
    assert many.count() == 1
    for how in ("inner", "left", "left_semi"):
        a, b = skew.spread(big, small, ["k"], many, how), big.join(small, "k", how)
        assert sorted(map(tuple, a.select("id", "k").collect())) == sorted(map(tuple, b.select("id", "k").collect()))


def test_names_of_any_length_and_strings_over_lines():
    value = "x9Z8y7W6v5U4"
    long = "n" * 300 + "_db_pwd"
    for text in (f'{long} = "{value}"', f'db_pwd = """\n{value}\n"""', f"auth_pwd = '''{value}'''", f'--db-pwd={value}'):
        assert value in [text[a:b] for a, b, k in secrets.scan(text) if k in (0, 3)] or value in text[slice(*secrets.scan(text)[0][:2])], text
    assert secrets.scan("g-" * 100_000) == []
    assert secrets.scan('x = """' * 5000) is not None


def test_empty_tables_and_repeated_queries(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.risk_controlled(none, spark.createDataFrame([], "doc_id long, quality int"))[0].count() == 0
    assert secrets.scanned(none).count() == 0
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = topk.search(v, F.col("vec_id") == 0, k=2).collect()
    assert got and all(r.vec_id != 0 for r in got)
