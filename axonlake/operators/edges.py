"""Weighted directed edges: slices, signs, pairs and what meets at a node.

An edge row is one (pre, post, place) with weight w; thresholds are applied per row, before rows of a pair are summed. Sets of nodes are
DataFrames of one column `id`; joins with them are left semi joins whose side is left to the optimiser, which broadcasts it only below
its own size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strong(edges: DataFrame, least: int) -> DataFrame:
    """Rows of weight `least` or more."""
    return edges.where(F.col("w") >= least)


def within(edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """Rows whose `end` (pre or post) is in ids."""
    return edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")


def slice_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows from sources to targets."""
    return within(within(edges, "pre", sources), "post", targets)


def induced(edges: DataFrame, ids: DataFrame, signs: DataFrame, least: int) -> DataFrame:
    """(post, pre, v): signed sums over pairs with both ends in ids. Rows whose pre has no sign are dropped."""
    rows = slice_between(strong(edges, least), ids, ids)
    signed = rows.join(signs.select(F.col("id").alias("pre"), "sign"), "pre")
    return signed.groupBy("post", "pre").agg(F.sum(F.col("w") * F.col("sign")).alias("v"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with either end in ids, each once."""
    marked = ids.select("id", F.lit(True).alias("in_set")).distinct()
    a, b = marked.withColumnsRenamed({"id": "pre", "in_set": "a"}), marked.withColumnsRenamed({"id": "post", "in_set": "b"})
    return edges.join(a, "pre", "left").join(b, "post", "left").where("a OR b").drop("a", "b")


def pairs(edges: DataFrame, *more: Column) -> DataFrame:
    """(pre, post, w): rows of a pair summed."""
    return edges.groupBy("pre", "post").agg(F.sum("w").alias("w"), *more)


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected weights: (a, b, w) with every pair in both directions."""
    turned = edges.select(F.col("post").alias("pre"), F.col("pre").alias("post"), "w")
    return pairs(edges.select("pre", "post", "w").unionAll(turned))


def returned(edges: DataFrame) -> DataFrame:
    """Distinct (pre, post) whose reverse is an edge too; a self-loop is its own reverse."""
    once = edges.select("pre", "post").distinct()
    back = once.select(F.col("post").alias("pre"), F.col("pre").alias("post"))
    return once.join(back, ["pre", "post"], "left_semi")


def through(edges: DataFrame) -> DataFrame:
    """Rows both of whose ends occur as source and as target; one pass, not repeated until nothing changes."""
    ids = edges.select(F.col("pre").alias("id")).intersect(edges.select(F.col("post").alias("id")))
    return slice_between(edges, ids, ids)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, w_out, w_in), in one aggregation over both roles."""
    roles = edges.select(F.col("pre").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("w").alias("wo"), F.lit(0).alias("wi"))
    roles = roles.unionAll(edges.select("post", F.lit(0), F.lit(1), F.lit(0), "w"))
    return roles.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.sum("wo").alias("w_out"), F.sum("wi").alias("w_in"))


def fan_in(edges: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """(kind, n_pre, n_edges, n_syn) by the class of the source; rows without a class don't count."""
    rows = edges.join(classes.select(F.col("id").alias("pre"), kind), "pre", "left").where(F.col(kind).isNotNull())
    # distinct sources per class: counted after one aggregation by (class, source), which a heavy class doesn't skew
    each = rows.groupBy(kind, "pre").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    return each.groupBy(kind).agg(F.count(F.lit(1)).alias("n_pre"), F.sum("n").alias("n_edges"), F.sum("w").alias("n_syn"))


def strongest(edges: DataFrame, at: str, other: str) -> DataFrame:
    """(at, other, w): the strongest partner of each node, the smallest id on ties, by one partial aggregation."""
    best = edges.groupBy(at).agg(F.max(F.struct(F.col("w"), (-F.col(other)).alias("k"))).alias("b"))
    return best.select(at, (-F.col("b.k")).alias(other), F.col("b.w").alias("w"))


def class_matrix(edges: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """(from, to, n, syn, median, n_pre) for every pair of classes that edges join."""
    a = classes.select(F.col("id").alias("pre"), F.col(kind).alias("from_kind"))
    b = classes.select(F.col("id").alias("post"), F.col(kind).alias("to_kind"))
    rows = edges.join(a, "pre").join(b, "post").where("from_kind IS NOT NULL AND to_kind IS NOT NULL")
    return rows.groupBy("from_kind", "to_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("syn"), F.expr("percentile(w, 0.5)").alias("median_w"), F.count_distinct("pre").alias("n_pre")
    )
