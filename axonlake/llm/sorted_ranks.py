"""Exact percentiles per group by a distributed sort and per-partition counts.

The mergeable state of a set of values is its table of (group, value, how many): states of separate partitions or days are added up by
summing the counts, and no information is lost, so percentiles of a longer time come from the daily states with error 0. A percentile p
of n values is the value at position (n - 1) * p of the sorted values counted from 0, interpolated linearly between its neighbours.

The states are range-partitioned and sorted by (group, value); the counts of each (partition, group) are summed up to offsets, and only
the partitions that hold a wanted position of a group are opened again to find the values there. A group of any size lies in many
partitions; a value of any frequency is one row.

Defined cases: null and NaN values don't count; a null group is a group; a group without values has n = 0 and null percentiles; an
empty table gives no rows; infinities sort as numbers, and between two unlike neighbours with an infinity the result is that of the formula.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize

#: Partitions of the sorted states that one block of the offsets' prefix sums covers.
BLOCK = 512


def _same(a: str, b: str, columns: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def value_states(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, v, n): how often each value occurs. A group whose values are all null or NaN keeps one row with null v and n = 0."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value)) + F.lit(0.0)  # -0.0 is 0.0
    return df.select(*group, v.alias("v")).groupBy(*group, "v").agg(F.count("v").alias("n"))


def merge_states(states: DataFrame, group: list[str]) -> DataFrame:
    """States of the coarser groups."""
    return states.groupBy(*group, "v").agg(F.sum("n").alias("n"))


def percentiles(states: DataFrame, group: list[str], probs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """One row per group: n and a column for each of probs, all exact."""
    spark = states.sparkSession
    stored = materialize(states, "value-states")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored.where(F.col("n") > 0).repartitionByRange(parts, *group, "v").sortWithinPartitions(*group, "v")
    ordered = materialize(ordered.withColumn("__ax_pid", F.spark_partition_id()), "sorted-states")

    sums = ordered.groupBy(*group, "__ax_pid").agg(F.sum("n").alias("in_part")).withColumn("__ax_block", F.expr(f"__ax_pid div {BLOCK}"))
    running = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    blocks = sums.groupBy(*group, "__ax_block").agg(F.sum("in_part").alias("in_block"))
    blocks = blocks.withColumn("before_block", running("in_block", Window.partitionBy(*group).orderBy("__ax_block")))
    sums = sums.withColumn("in_before", running("in_part", Window.partitionBy(*group, "__ax_block").orderBy("__ax_pid")))
    places = sums.alias("s").join(blocks.alias("b"), _same("s", "b", [*group, "__ax_block"]))
    places = places.select("s.*", (F.col("before_block") + F.col("in_before")).alias("first_at"))
    places = materialize(places, "sorted-offsets")

    totals = stored.groupBy(*group).agg(F.sum("n").alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(p)).alias("h")) for name, p in probs.items()])
    targets = totals.where(F.col("n") > 0).select(*group, F.explode(wanted).alias("t")).select(*group, "t.name", "t.h")
    targets = targets.select("*", F.floor("h").alias("lo"), F.ceil("h").alias("hi"))
    targets = targets.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at"))
    here = (F.col("t.at") >= F.col("p.first_at")) & (F.col("t.at") < F.col("p.first_at") + F.col("p.in_part"))
    located = targets.alias("t").join(places.alias("p"), _same("t", "p", group) & here).select("t.*", "p.__ax_pid", "p.first_at")

    opened = located.select(*group, "__ax_pid", "first_at").distinct()
    runs = ordered.alias("o").join(opened.alias("w"), _same("o", "w", [*group, "__ax_pid"])).select("o.*", "w.first_at")
    upto = F.sum("n").over(Window.partitionBy(*group, "__ax_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("end_at", F.col("first_at") + upto)
    inside = (F.col("l.at") < F.col("r.end_at")) & (F.col("l.at") >= F.col("r.end_at") - F.col("r.n"))
    stats = located.alias("l").join(runs.alias("r"), _same("l", "r", [*group, "__ax_pid"]) & inside)
    stats = stats.select(*[F.col(f"l.{g}") for g in group], "l.name", "l.h", "l.lo", "l.at", "r.v")
    low, high = F.min_by("v", "at"), F.max_by("v", "at")
    values = stats.groupBy(*group, "name", "h", "lo").agg(low.alias("low"), high.alias("high"))
    values = values.withColumn("q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.col("lo"))))
    wide = values.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in probs])
    return totals.alias("g").join(wide.alias("w"), _same("g", "w", group), "left").select("g.*", *[F.col(f"w.{name}") for name in probs])
