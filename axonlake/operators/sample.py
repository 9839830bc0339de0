"""Draws that repeat for the same seed, whatever the partitions: chance comes from a hash of the seed and the row.

Defined cases: an empty table gives no draws; null is a value that can be drawn; a draw without replacement of more than there is takes all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonlake.operators.dense_ids import dense_ids


def with_replacement(df: DataFrame, column: str, draws: int, seed: int) -> DataFrame:
    """(draw, column): values drawn one after another from the distinct ones, each as likely as another."""
    ids = dense_ids(df, column)
    n = ids.count()
    picks = df.sparkSession.range(draws if n else 0).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n))).alias("dense"))
    return picks.join(ids, "dense").select("draw", column)


def accepted(df: DataFrame, condition: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """n distinct rows that pass the condition, each set of them as likely as another: the first in an order by hash."""
    passing = df.where(condition).dropDuplicates(keys)
    return passing.withColumn("__ax_h", F.xxhash64(F.lit(seed), *keys)).orderBy("__ax_h", *keys).limit(n).drop("__ax_h")
