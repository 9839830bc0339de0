"""The last earlier value in an order, without handing a whole key to one task's window at once.

The order column is cut into blocks. Within a block a window finds the last value before each row; the last value of each block is
carried forward over the blocks by a second window, whose rows are one per block. Defined cases: null values are passed over; the first
row of a key gets null; rows with the same order are told apart by the tie columns; a null key is a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024


def carry_last(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with the column `name`: the last value that isn't null among the key's rows before this one by (order, ties)."""
    rows = df.withColumn("__ax_value", value).withColumn("__ax_block", F.expr(f"`{order}` div {block}"))
    place = [order, *ties]
    near = Window.partitionBy(*keys, "__ax_block").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col("__ax_value").isNotNull()).groupBy(*keys, "__ax_block").agg(F.max_by("__ax_value", F.struct(*place)).alias("__ax_end"))
    blocks = rows.groupBy(*keys, "__ax_block").agg(F.lit(1).alias("__ax_one")).drop("__ax_one")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "__ax_block"]])
    blocks = blocks.alias("b").join(ends.alias("e"), same("b", "e"), "left").select("b.*", "e.__ax_end")
    far = Window.partitionBy(*keys).orderBy("__ax_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__ax_far", F.last("__ax_end", ignorenulls=True).over(far)).drop("__ax_end")
    rows = rows.withColumn("__ax_near", F.last("__ax_value", ignorenulls=True).over(near))
    joined = rows.alias("r").join(blocks.alias("b"), same("r", "b"), "left").select("r.*", "b.__ax_far")
    return joined.withColumn(name, F.coalesce("__ax_near", "__ax_far")).drop("__ax_value", "__ax_block", "__ax_near", "__ax_far")
