"""Ordered analytics: runs, gaps, crossings, interpolation, windows over a time axis and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from axonlake.sources.scratch import materialize


def runs(df: DataFrame, keys: list[str], order: str, passes: Column) -> DataFrame:
    """(keys, first, last, length) of every run of consecutive rows that pass. Consecutive: no row between them in the order."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.row_number().over(w).alias("__ax_i"), F.coalesce(passes, F.lit(False)).alias("__ax_ok")).where("__ax_ok")
    rows = rows.withColumn("__ax_run", F.col("__ax_i") - F.row_number().over(w))
    return rows.groupBy(*keys, "__ax_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__ax_run")


def widest_run(df: DataFrame, keys: list[str], order: str, passes: Column) -> DataFrame:
    """The longest run of each key, the first on ties; keys without a run are absent."""
    best = runs(df, keys, order, passes).groupBy(*keys).agg(F.min(F.struct((-F.col("length")).alias("l"), "first", "last")).alias("b"))
    return best.select(*keys, "b.first", "b.last", (-F.col("b.l")).alias("length"))


def circular_gaps(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """(keys, n, max_gap): the largest gap between neighbouring angles on the circle, the one over the end included."""
    a = df.where(F.col(angle).isNotNull()).select(*keys, F.pmod(angle, F.lit(2 * 3.141592653589793)).alias("a"))
    w = Window.partitionBy(*keys).orderBy("a")
    gaps = a.withColumn("gap", F.lead("a").over(w) - F.col("a"))
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.min("a") + F.lit(2 * 3.141592653589793) - F.max("a")).alias("max_gap"))


def clusters(df: DataFrame, keys: list[str], order: str, gap: float) -> DataFrame:
    """(keys, n_clusters): groups of rows parted by more than `gap`."""
    step = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, step.alias("s")).groupBy(*keys).agg((1 + F.count_if(F.col("s") > gap)).alias("n_clusters"))


def crossings(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, at, slope) where y goes from below zero to zero or above between neighbours, interpolated."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = df.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    rows = rows.where("y0 < 0 AND y1 >= 0")
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    return rows.select(*keys, (F.col("x0") - F.col("y0") / slope).alias("at"), slope.alias("slope"))


def sliding(spine: DataFrame, events: DataFrame, keys: list[str], at: str, half: float, step: float) -> DataFrame:
    """Each window of the spine (column `c`, a multiple of step) with the events of [c - half, c + half). Every event goes to its windows by
    arithmetic, an equi-join follows; windows without events stay, with nulls."""
    first = F.floor((F.col(at) - F.lit(half)) / F.lit(step)).cast("long") + 1  # the smallest c with at < c + half
    last = F.floor((F.col(at) + F.lit(half)) / F.lit(step)).cast("long")  # the largest c with c - half <= at
    placed = events.select("*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("__ax_w"))
    windows = spine.withColumn("__ax_w", F.round(F.col("c") / F.lit(step)).cast("long"))
    return windows.join(placed, [*keys, "__ax_w"], "left").drop("__ax_w")


def path(df: DataFrame, keys: list[str], order: str, turn: str, speed: str, dt: float) -> DataFrame:
    """(keys, order, heading, x, y): headings are running sums of turns, places running sums of steps along them."""
    w: WindowSpec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("heading", F.sum(F.col(turn) * dt).over(w))
    return rows.select(*keys, order, "heading", F.sum(F.col(speed) * F.cos("heading") * dt).over(w).alias("x"), F.sum(F.col(speed) * F.sin("heading") * dt).over(w).alias("y"))


def never_rises(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, falls): whether no value is larger than the one before it."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, step.alias("s")).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("s") <= 0), F.lit(True)).alias("falls"))


def running_total(df: DataFrame, group: list[str], order: list[str], n: str, name: str) -> DataFrame:
    """df with `name`: the sum of n over a group's rows up to this one in the order, which must tell all rows of a group apart. Rows are laid out by ranges, so a group of any size is summed in parts, whose totals are carried forward."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in [*group, *order]]).withColumn("__ax_pid", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    near = F.sum(n).over(Window.partitionBy(*group, "__ax_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*group, "__ax_pid").agg(F.sum(n).alias("__ax_s"))
    far = F.sum("__ax_s").over(Window.partitionBy(*group).orderBy("__ax_pid").rowsBetween(Window.unboundedPreceding, -1))  # one row per range of a group
    before = sums.select(*group, "__ax_pid", F.coalesce(far, F.lit(0)).alias("__ax_before"))
    same = F.col("r.__ax_pid") == F.col("b.__ax_pid")
    for c in group:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = rows.withColumn("__ax_near", near).alias("r").join(before.alias("b"), same).select("r.*", "b.__ax_before")
    return joined.withColumn(name, F.col("__ax_near") + F.col("__ax_before")).drop("__ax_pid", "__ax_near", "__ax_before")
