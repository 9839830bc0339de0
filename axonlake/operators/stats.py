"""Summaries, rank statistics, tests and information measures.

Windows over whole keys are used only where a key's rows are bounded by what was aggregated before (distinct values of a rank, the
hypotheses of a family, the levels of a contingency table); ranks over raw rows go through `rank_of_values`, which counts equal values and
sums the counts by ranges, however many distinct values a group has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.operators.ordered import running_total


def mean_ci(value: str, prefix: str = "") -> list[Column]:
    """n, mean, sd (one value: 0) and half-width of the 95 % interval."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return [F.count(value).alias(f"{prefix}n"), F.avg(value).alias(f"{prefix}mean"), sd.alias(f"{prefix}sd"), (F.lit(1.96) * sd / F.sqrt(F.count(value))).alias(f"{prefix}ci95")]


def apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals have no point in common."""
    return (high_a < low_b) | (high_b < low_a)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The binomial interval of Wilson; (0, 0) for no trials."""
    p = k / F.nullif(n, F.lit(0))
    denom = 1 + F.lit(z * z) / F.nullif(n, F.lit(0))
    mid = (p + F.lit(z * z / 2) / F.nullif(n, F.lit(0))) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + F.lit(z * z / 4) / (F.nullif(n, F.lit(0)) * n)) / denom
    some = F.coalesce(n > 0, F.lit(False))
    return F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def rank_of_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, rank): mean ranks of distinct values, from 1; ties share their mean rank. Null values have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, group, [value], "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2).drop("upto")


def guarded_corr(x: str, y: str, constant: float | None = None) -> Column:
    """Pearson correlation; `constant` where one of the two does not vary, which would divide by zero."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).otherwise(F.lit(constant).cast("double"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, rho) by mean ranks; 0 where one column is constant. Rows with a null in either column don't count."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    rx = rank_of_values(rows, group, x).select(*group, x, F.col("rank").alias("rx"))
    ry = rank_of_values(rows, group, y).select(*group, y, F.col("rank").alias("ry"))
    both = rows.join(rx, [*group, x]).join(ry, [*group, y])
    return both.groupBy(*group).agg(guarded_corr("rx", "ry", 0.0).alias("rho"))


def holm(df: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """df with `p_holm`: step-down adjusted p-values within a family of hypotheses; ties in any order have equal results."""
    keys = family or []
    order = Window.partitionBy(*keys).orderBy(p)
    rows = df.withColumn("__ax_k", F.row_number().over(order)).withColumn("__ax_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    step = F.least(F.lit(1.0), (F.col("__ax_m") - F.col("__ax_k") + 1) * F.col(p))
    return rows.withColumn("p_holm", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__ax_k", "__ax_m")


def entropy_bits(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """(group, bits) of the shares of n within each group."""
    s = counts.where(F.col(n) > 0).groupBy(*group).agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.log2(n)).alias("x"))
    return s.select(*group, (F.log2("t") - F.col("x") / F.col("t")).alias("bits"))


def mutual_information_bits(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """One row: the information in bits that a and b hold about each other, from a table of counts (a, b, n)."""
    x = lambda c: F.sum(F.col(c) * F.log2(c))
    joint = counts.where(F.col(n) > 0).groupBy(a, b).agg(F.sum(n).alias("n"))
    j = joint.agg(F.sum("n").alias("t"), x("n").alias("j"))
    ra = joint.groupBy(a).agg(F.sum("n").alias("n")).agg(x("n").alias("a"))
    rb = joint.groupBy(b).agg(F.sum("n").alias("n")).agg(x("n").alias("b"))
    return j.crossJoin(ra).crossJoin(rb).select((F.log2("t") + (F.col("j") - F.col("a") - F.col("b")) / F.col("t")).alias("bits"))  # one row each


def permutation_p(null: Column, observed: Column, mean: Column) -> Column:
    """Two-sided p of an observed value against null samples: (1 + as far or farther) / (n + 1)."""
    return (1 + F.count_if(F.abs(null - mean) >= F.abs(observed - mean))) / (F.count(null) + 1)


def circular(theta: str, weight: Column | None = None) -> list[Column]:
    """Mean direction and resultant length (0 for no or balanced angles)."""
    w = F.lit(1.0) if weight is None else weight
    c, s, n = F.sum(w * F.cos(theta)), F.sum(w * F.sin(theta)), F.sum(w)
    return [F.atan2(s, c).alias("direction"), F.coalesce(F.hypot(c, s) / F.nullif(n, F.lit(0.0)), F.lit(0.0)).alias("resultant")]


def welch(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of two samples with unequal variances."""
    a, b = s1 * s1 / n1, s2 * s2 / n2
    return (m1 - m2) / F.nullif(F.sqrt(a + b), F.lit(0.0)), (a + b) * (a + b) / F.nullif(a * a / (n1 - 1) + b * b / (n2 - 1), F.lit(0.0))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if not (t == t and df > 0):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x == 1.0:
        return 1.0
    if x == 0.0:
        return 0.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def circular_correlation(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """(group, n, r): how two angles vary together around their mean directions (Jammalamadaka and SenGupta); 0 where one doesn't vary."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    mean = rows.groupBy(*group).agg(*[F.atan2(F.sum(F.sin(x)), F.sum(F.cos(x))).alias(f"__ax_{x}") for x in (a, b)])  # one row per group
    same = None
    for c in group:
        one = F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}"))
        same = one if same is None else same & one
    both = rows.alias("d").join(mean.alias("m"), same) if group else rows.alias("d").crossJoin(F.broadcast(mean.alias("m")))
    x, y = F.sin(F.col(f"d.{a}") - F.col(f"m.__ax_{a}")), F.sin(F.col(f"d.{b}") - F.col(f"m.__ax_{b}"))
    got = both.groupBy(*[F.col(f"d.{c}") for c in group]).agg(F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return got.select(*group, "n", F.coalesce(F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)), F.lit(0.0)).alias("r"))
