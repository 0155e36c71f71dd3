"""Cut points in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A cut writes a Parquet table there and reads it back, so lineage ends in files that every executor
sees and a lost executor costs nothing but its own tasks.  Only on a local master without that setting, as in
tests, a folder of this machine is used; any other session without it is an error.

Tables that an operator no longer reads are dropped by it.  Those that its result still reads stay until the result is written: ``scope``
notes all cuts made inside it, so that whoever writes the result (the pipeline after each stage) can drop them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="dendrospark-")
    return _own


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``drop`` removes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The cuts made inside, to be dropped when what is read from them has been written."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()
