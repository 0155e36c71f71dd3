import os

import corpus_pipeline
from pyspark.sql import functions as F

from dendrospark.llm import minhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        if name == "near_dedup":
            want = {r.doc_id for r in minhash.near_duplicates(docs, percent=80, bands=64).where("kept").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        out = out.cache()
        assert 0 < out.count() <= n
        n, docs = out.count(), out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    assert total.where("n <> d").count() == 0


def test_near_copies_between_80_and_85_percent_are_dropped(spark):
    data, want = [], set()
    for i in range(0, 40, 2):
        a = [f"n{i}x{j}" for j in range(300)]
        b = list(a)
        for c in range(i // 2 % 3 + 5):
            b[20 + 35 * c] = f"changed{c}"
        sets = [{tuple(w[j : j + 5]) for j in range(296)} for w in (a, b)]
        same = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        want |= {i} | ({i + 1} if same < 0.8 else set())
        data += [(i, " ".join(a)), (i + 1, " ".join(b))]
    assert 20 < len(want) < 40
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    assert {r.doc_id for r in out.collect()} == want
