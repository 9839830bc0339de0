"""Iterative graph operators: each round is one join and one aggregation, written to a table, so plans don't grow.

Loops end when a round finds nothing new; only counts come to the driver. Hubs weigh on one join key each; the frontier side is distinct,
so adaptive execution can split the edge side. The spectrum alone works on blocks of files instead (power_blocks). Edges are (pre, post); null ends are dropped; self-loops and repeated edges change nothing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonlake.operators.power_blocks import power_blocks
from axonlake.sources.scratch import materialize


def _ends(edges: DataFrame) -> DataFrame:
    return edges.where("pre IS NOT NULL AND post IS NOT NULL").select("pre", "post").distinct()


def levels(edges: DataFrame, seeds: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """(id, hop, parent): the nodes within `hops` of the seeds, found level by level; parent is the smallest node of the level before.
    With a limit, discovery stops with the level that reaches it, and the first `limit` by (hop, parent, id) are kept."""
    e = materialize(_ends(edges), "bfs-edges")
    found = materialize(seeds.select("id").where("id IS NOT NULL").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent")), "bfs-0")
    frontier, n = found, found.count() if limit else 0
    for hop in range(1, hops + 1):
        if limit and n >= limit:
            break
        step = e.join(frontier.select(F.col("id").alias("pre")), "pre").groupBy(F.col("post").alias("id")).agg(F.min("pre").alias("parent"))
        frontier = materialize(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "parent"), f"bfs-{hop}")
        new = frontier.count()
        if not new:
            break
        n += new
        found = found.unionAll(frontier)
    return found.orderBy("hop", "parent", "id").limit(limit) if limit else found


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int | None = None) -> list[int] | None:
    """The nodes of one shortest path from any source to any target, with the smallest parents; None if there is none. A node in both sets is a path of its own. A search that ends at max_hops with nodes left to look at raises."""
    e = materialize(_ends(edges), "path-edges")
    layers = [materialize(sources.select("id").distinct().select("id", F.lit(None).cast("long").alias("parent")), "path-0")]
    seen = layers[0].select("id")
    goal = targets.select("id").distinct()
    for hop in itertools.count():
        hit = layers[-1].join(goal, "id", "left_semi").agg(F.min("id").alias("id")).first()["id"]
        if hit is not None:
            path = [hit]
            for layer in reversed(layers[1:]):  # one row per hop
                path.append(layer.where(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
        if max_hops is not None and hop >= max_hops:
            raise RuntimeError(f"no path within {max_hops} hops, and the search isn't at its end")
        step = e.join(layers[-1].select(F.col("id").alias("pre")), "pre").groupBy(F.col("post").alias("id")).agg(F.min("pre").alias("parent"))
        layers.append(materialize(step.join(seen, "id", "left_anti"), f"path-{hop + 1}"))
        if not layers[-1].count():
            return None
        seen = seen.unionAll(layers[-1].select("id"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp): weakly connected components, named by their smallest node. Labels spread to neighbours and jump to the label of their label, so rounds grow with the logarithm of the diameter."""
    ends = _ends(edges)
    e = materialize(ends.unionAll(ends.select(F.col("post").alias("pre"), F.col("pre").alias("post"))).distinct(), "component-edges")
    labels = materialize(e.select(F.col("pre").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    for _ in range(max_rounds):
        near = e.join(labels.withColumnRenamed("id", "pre"), "pre").groupBy(F.col("post").alias("id")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        moved = materialize(moved, "labels-near")
        root = moved.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        jumped = moved.join(root, "comp", "left").select("id", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("id", "comp")
        if not jumped.where("was != comp").limit(1).count():
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _reach(e: DataFrame, start: DataFrame, forward: bool) -> DataFrame:
    a, b = ("pre", "post") if forward else ("post", "pre")
    turned = e.select(F.col(a).alias("pre"), F.col(b).alias("post"))
    return levels(turned, start, 1 << 30).select("id")


def largest_scc(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id): the largest strongly connected component; the one with the smallest node of those found first on ties. Nodes without way in or out are trimmed; then the component of the busiest node is what it reaches and is reached from; it ends when fewer nodes are left than the best has."""
    e = materialize(_ends(edges).where("pre != post"), "scc-edges")
    best, size = None, 0
    for _ in range(max_rounds):
        while True:
            ids = e.select(F.col("pre").alias("id")).intersect(e.select(F.col("post").alias("id")))
            kept = e.join(ids.withColumnRenamed("id", "pre"), "pre", "left_semi").join(ids.withColumnRenamed("id", "post"), "post", "left_semi").select("pre", "post")
            kept = materialize(kept, "scc-edges")
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        nodes = e.select(F.col("pre").alias("id")).distinct()
        left = nodes.count()
        if left <= size or not left:
            break
        into, out = e.groupBy(F.col("post").alias("id")).agg(F.count(F.lit(1)).alias("i")), e.groupBy(F.col("pre").alias("id")).agg(F.count(F.lit(1)).alias("o"))
        pivot = into.join(out, "id").orderBy(F.desc(F.col("i") * F.col("o")), "id").limit(1).select("id")
        pivot = materialize(pivot, "scc-pivot")
        scc = materialize(_reach(e, pivot, True).intersect(_reach(e, pivot, False)), "scc")
        n = scc.count()
        if n > size:
            best, size = scc, n
        e = materialize(e.join(scc.withColumnRenamed("id", "pre"), "pre", "left_anti").join(scc.withColumnRenamed("id", "post"), "post", "left_anti"), "scc-edges")
    else:
        raise RuntimeError(f"nodes are left after {max_rounds} rounds")
    return best if best is not None else edges.select(F.col("pre").alias("id")).limit(0)


def spectrum(edges: DataFrame, rounds: int = 400, tolerance: float = 1e-12) -> tuple[float, DataFrame, bool]:
    """(spectral radius, vector, converged) of the weights (pre, post, w): v[post] = sum w * v[pre], scaled to length 1 each round; it ends early when the length stays. The vector has every node, with 0 where nothing arrives."""
    return power_blocks(edges, rounds, tolerance)


def power_iteration(edges: DataFrame, rounds: int, tolerance: float = 1e-12) -> tuple[float, DataFrame]:
    """(spectral radius, vector) of spectrum."""
    radius, v, _ = spectrum(edges, rounds, tolerance)
    return radius, v
