"""Dictionary encoding: distinct values to 0, 1, 2, ... in sorted order, without a global window.

Values are range-partitioned and sorted; counts per partition, one row each, give the offsets. Defined cases: null is a value, the first;
repeated values get one number; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize


def dense_ids(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(column, dense)."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(column).distinct().repartitionByRange(parts, F.col(column).asc_nulls_first()).sortWithinPartitions(F.col(column).asc_nulls_first())
    rows = rows.select(column, F.spark_partition_id().alias("__ax_pid"), F.monotonically_increasing_id().alias("__ax_at"))
    rows = materialize(rows.withColumn("__ax_at", F.col("__ax_at") - F.shiftleft(F.col("__ax_pid").cast("long"), 33)), "dense-ids")
    counts = rows.groupBy("__ax_pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__ax_pid", (F.sum("n").over(Window.orderBy("__ax_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # one row per partition
    return rows.join(F.broadcast(before), "__ax_pid").select(column, (F.col("before") + F.col("__ax_at")).alias("dense"))
