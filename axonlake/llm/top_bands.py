"""The N best items of every group by descending score bands.

Items are stored once, split by score into bands. Bands are taken from the top: items of groups that already have N are dropped by an
anti-join, the rest are ranked within the band by (score descending, tie columns ascending), and the ranks continue where the group
stood after the bands above. Every item of a higher band beats every item of a lower one, so places are exact, also where a group is
filled in the middle of a band of equal scores. Ranking keeps at most N rows of a group in each task before the shuffle, so no task
receives a whole large group.

Defined cases: items with a null score don't count; a null group is a group of its own; tie columns compare as Spark sorts them, nulls
first; fully equal items are told apart by nothing, and each takes a place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize

#: Filled groups up to which the anti-join broadcasts them; beyond, it shuffles.
BROADCAST_GROUPS = 200_000
#: Shares of the items above each band's lower bound, from the top.
SHARES = (0.02, 0.12, 0.4)


def bounds(df: DataFrame, score: str, shares: tuple[float, ...] = SHARES, accuracy: int = 1000) -> list:
    """Lower bounds of the bands, descending. Any bounds give the same places; they only share out the work."""
    got = df.agg(F.percentile_approx(score, [1 - s for s in shares], accuracy).alias("b")).first()["b"]
    return sorted(set(got or []), reverse=True)


def with_band(df: DataFrame, score: str, lower: list) -> DataFrame:
    """`__ax_band` 0 for scores from lower[0] up, 1 from lower[1] up, ..."""
    band = F.lit(len(lower))
    for i in range(len(lower) - 1, -1, -1):
        band = F.when(F.col(score) >= F.lit(lower[i]), i).otherwise(band)
    return df.withColumn("__ax_band", band)


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, lower: list | None = None, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The columns group, score and ties of each group's first n items, with their `place` from 1."""
    items = df.where(F.col(score).isNotNull()).select(*group, *ties, score)
    if lower is None:
        lower = bounds(items, score)
    stored = materialize(with_band(items, score, lower), "bands", ["__ax_band"])
    same_group = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group])
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_first() for t in ties])
    done: DataFrame | None = None
    for band in range(len(lower) + 1):
        open_items = stored.where(F.col("__ax_band") == band).drop("__ax_band")
        if done is not None:
            standing = done.groupBy(*group).agg(F.max("place").alias("__ax_have"))
            filled = standing.where(F.col("__ax_have") >= n).select(*group)
            if filled.count() <= broadcast_groups:
                filled = F.broadcast(filled)
            open_items = open_items.alias("i").join(filled.alias("f"), same_group("i", "f"), "left_anti")
        ranked = open_items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        if done is not None:
            partly = standing.where(F.col("__ax_have") < n)
            ranked = ranked.alias("r").join(partly.alias("s"), same_group("r", "s"), "left")
            ranked = ranked.select("r.*", F.col("s.__ax_have")).withColumn("place", F.col("place") + F.coalesce("__ax_have", F.lit(0))).drop("__ax_have").where(F.col("place") <= n)
        kept = materialize(ranked, f"band-{band}")
        done = kept if done is None else done.unionAll(kept)
    return done
