"""Joins on keys of which one may hold a third of all rows.

``hot`` lists the keys with more than ``least`` rows; as ``least`` is at least a fixed share of all rows, there are at
most ``MOST_HOT`` of them, so the list can be broadcast at any size.  ``spread`` joins two tables so that a
hot key's rows on the big side are dealt into parts, with the small side's row repeated for each.  All other keys have one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 4096
#: Rows of one key that a task takes without being split.
TASK_ROWS = 4096


def hot(counts: DataFrame, keys: list[str], also: tuple[str, ...] = (), n: str = "n", task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, also, parts) of the keys whose ``n`` rows pass ``task_rows``; counts has one row for each key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(task_rows, -(-total // MOST_HOT))
    return counts.where(F.col(n) > least).select(*keys, *also, F.ceil(F.col(n) / least).cast("int").alias("parts"))


def spread(big: DataFrame, small: DataFrame, keys: list[str], hot_keys: DataFrame, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """``big.join(small, keys, how)`` with ``hot_keys`` (some or all of keys, parts) split by a hash of ``by`` (all columns); how is inner, left or left_semi.

    The part follows from what a row holds, so a task that runs again deals its rows as before.
    """
    named = [k for k in keys if k in hot_keys.columns]
    many = F.broadcast(hot_keys.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(named)), F.col("parts").alias("_parts")))

    def with_parts(df: DataFrame) -> DataFrame:
        met = F.lit(True)
        for i, k in enumerate(named):
            met &= F.col(k) == F.col(f"_h{i}")
        return df.join(many, met, "left")

    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(by or big.columns)), F.col("_parts")).cast("int"))
    left = with_parts(big).withColumn("_part", part).select(*big.columns, "_part")
    right = with_parts(small).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).select(*small.columns, "_part")
    return left.join(right.hint("merge"), [*keys, "_part"], how).drop("_part")
