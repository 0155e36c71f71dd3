"""A training-corpus pipeline: filter, deduplicate, clean and pack ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it decides takes effect in what it
returns, and all but the last return the columns of ``documents``.  Rows with a null doc_id pass the deduplicating stages untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm import minhash, packing, passages, secrets, toxicity
from dendrospark.llm.store import cut, drop, scope


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies from a similarity of 0.8 on; 64 x 6 bands miss a pair there with probability 4e-9."""
    gone = minhash.near_duplicates(docs, percent=80, bands=64).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(passages.without_passages(docs, passages.repeated_passages(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier and the aligned passages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            kept = stage(spark, docs, sf_dir)
        docs = cut(kept, f"stage-{name}")
        drop(*made, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
