"""Arithmetic by repeated steps of a transition table, by bits, and out of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of the step tables, and the quotient from which on a division is refused.
LARGEST, MAX_QUOTIENT = 81, 50


def step_tables() -> tuple[Column, Column]:
    """The transitions n -> n + 1 and n -> n - 1 on 0..LARGEST, as maps; at the ends they stay."""
    up = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(LARGEST)), lambda n: F.struct(n, F.least(n + 1, F.lit(LARGEST)))))
    down = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(LARGEST)), lambda n: F.struct(n, F.greatest(n - 1, F.lit(0)))))
    return up, down


def stepped(start: Column, times: Column, table: Column) -> Column:
    """`times` transitions from start."""
    calls = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(calls, start.cast("int"), lambda n, _: F.element_at(table, n))


def tables(spark: SparkSession, largest: int) -> DataFrame:
    """(a, b, op, result, calls) for all pairs of 1..largest: addition and subtraction step b times, multiplication adds a b times, division subtracts b while it can."""
    ints = spark.range(1, largest + 1).select(F.col("id").cast("int").alias("a"))
    up, down = step_tables()
    p = ints.crossJoin(ints.withColumnRenamed("a", "b")).withColumn("up", up).withColumn("down", down)  # largest^2 rows
    a, b = F.col("a"), F.col("b")
    quotient = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_QUOTIENT)), F.struct(a.alias("left"), F.lit(0).alias("q")), lambda s, _: F.struct(F.when(s["left"] >= b, s["left"] - b).otherwise(s["left"]).alias("left"), F.when(s["left"] >= b, s["q"] + 1).otherwise(s["q"]).alias("q")))
    ops = F.array(
        F.struct(F.lit("add").alias("op"), stepped(a, b, F.col("up")).alias("result"), b.alias("calls")),
        F.struct(F.lit("subtract").alias("op"), F.when(a >= b, stepped(a, b, F.col("down"))).alias("result"), b.alias("calls")),
        F.struct(F.lit("multiply").alias("op"), stepped(F.lit(0), a * b, F.col("up")).alias("result"), (a * b).alias("calls")),
        F.struct(F.lit("divide").alias("op"), quotient["q"].alias("result"), (quotient["q"] * b).alias("calls")),
    )
    return p.select("a", "b", F.explode(ops).alias("o")).select("a", "b", "o.op", "o.result", "o.calls")


def answered(df: DataFrame, asked: str) -> DataFrame:
    """df with `result` or `error` (operand, zero, quotient, result) of texts like `7 + 5`."""
    part = F.split(asked, " ")
    a, op, b = F.try_element_at(part, F.lit(1)).cast("int"), F.try_element_at(part, F.lit(2)), F.try_element_at(part, F.lit(3)).cast("int")
    rows = df.withColumn("__ax_a", a).withColumn("__ax_op", op).withColumn("__ax_b", b)
    a, op, b = F.col("__ax_a"), F.col("__ax_op"), F.col("__ax_b")
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(F.floor(F.try_divide(a, b)).cast("int"))
    rows = rows.withColumn("__ax_v", value)
    v = F.col("__ax_v")
    error = F.when((a > LARGEST) | (b > LARGEST), "operand").when((op == "/") & (b == 0), "zero").when((op == "/") & (v >= MAX_QUOTIENT), "quotient").when((v < 0) | (v > LARGEST), "result")
    return rows.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), v)).drop("__ax_a", "__ax_op", "__ax_b", "__ax_v")


def ripple_add(a: Column, b: Column, bits: int) -> Column:
    """a + b by full adders over `bits` bits and a carry."""

    def adder(s: Column, i: Column) -> Column:
        c = s["c"]
        x, y = F.call_function("shiftright", a, i).bitwiseAND(1), F.call_function("shiftright", b, i).bitwiseAND(1)
        half = x.bitwiseXOR(y)
        return F.struct(s["s"].bitwiseOR(F.call_function("shiftleft", half.bitwiseXOR(c), i)).alias("s"), x.bitwiseAND(y).bitwiseOR(half.bitwiseAND(c)).alias("c"))

    got = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("c")), adder)
    return got["s"].bitwiseOR(F.shiftleft(got["c"], bits))


#: Gate evaluations of a full adder: two exclusive ors as (x or y) and not (x and y), four each, two ands and an or.
ADDER_GATES = 11


def multiplied(a: Column, b: Column, bits: int) -> Column:
    """a * b by adding a shifted once for each set bit of b, each sum by full adders over 2 * bits bits: a struct of `value` and `gates`, the gates evaluated."""

    def step(s: Column, i: Column) -> Column:
        on = F.call_function("shiftright", b, i).bitwiseAND(1) == 1
        value = F.when(on, ripple_add(s["value"], F.call_function("shiftleft", a, i), 2 * bits)).otherwise(s["value"])
        return F.struct(value.alias("value"), F.when(on, s["gates"] + ADDER_GATES * 2 * bits).otherwise(s["gates"]).alias("gates"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.struct(F.lit(0).alias("value"), F.lit(0).alias("gates")), step)


def computed(a: Column, op: Column, b: Column, bits: int) -> Column:
    """The value of a op b (+, -, *) over `bits` bits by gates; a difference adds the complement, and one below 0, like an unknown op, is null."""
    mask = (1 << bits) - 1
    minus = ripple_add(ripple_add(a, F.lit(mask).bitwiseXOR(b), bits).bitwiseAND(mask), F.lit(1), bits).bitwiseAND(mask)
    return F.when(op == "+", ripple_add(a, b, bits)).when((op == "-") & (a >= b), minus).when(op == "*", multiplied(a, b, bits)["value"])
