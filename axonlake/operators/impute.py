"""Missing values filled from cells alike or of the same time, with a mark at each filled value.

Numbers: a mixed model, y = mean + effect of each grouping + effect of the time + rest, whose random effects are shrunk to the mean by
n * var / (n * var + rest variance); variances come from the method of moments. All sums run over (groupings, time) cells, aggregated
before any shuffle, so a group with a third of all rows weighs no more than another. With a companion value (one that lies near the
missing one, as two positions of one cell do) the model is fitted to the difference.

Categories: a multinomial model per feature value, shrunk towards the share of the category at that time, which itself is shrunk to the
overall share. Candidates are the categories seen with one of the row's feature values, or the most frequent of the time.

Defined cases: a null group or time has effect 0; where no value is known at all, the filled value is null and still marked missing;
equal scores go to the first category by name; repeated rows are filled alike; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.sources.scratch import materialize


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _effect(y: str) -> list:
    """Per response y, aggregates over the levels' (n, s, ss): variance of the effect `var_y` and of the rest `rest_y`, by the method of moments."""
    n, s, ss = F.col(f"n_{y}"), F.col(f"s_{y}"), F.col(f"ss_{y}")
    k, t = F.count_if(n > 0), F.sum(n)
    within, b = F.sum(ss), F.sum(s * s / F.nullif(n, F.lit(0)))
    enough = t > k
    rest = F.when(enough, F.greatest((within - b) / F.nullif(t - k, F.lit(0)), F.lit(1e-12))).otherwise(1.0)
    between = (b - F.sum(s) * F.sum(s) / F.nullif(t, F.lit(0))) / F.nullif(k - 1, F.lit(0))
    var = F.when(enough & (k > 1), F.greatest(F.lit(0.0), (between - rest) * (k - 1) / F.nullif(t - F.sum(n * n) / F.nullif(t, F.lit(0)), F.lit(0.0)))).otherwise(0.0)
    return [F.coalesce(var, F.lit(0.0)).alias(f"var_{y}"), F.coalesce(rest, F.lit(1.0)).alias(f"rest_{y}")]


def mixed_effects(known: DataFrame, ys: list[str], groupings: list[str], rounds: int = 2) -> tuple[dict[str, float | None], dict[str, DataFrame]]:
    """For several responses at once: the mean of each, and by grouping a table (level, and the effect on each response under its name). A null response doesn't count for itself only."""
    sums = [a for y in ys for a in (F.count(y).alias(f"n_{y}"), F.coalesce(F.sum(y), F.lit(0.0)).alias(f"s_{y}"), F.coalesce(F.sum(F.col(y) * F.col(y)), F.lit(0.0)).alias(f"ss_{y}"))]
    cells = materialize(known.groupBy(*groupings).agg(*sums), "effect-cells")
    total = cells.agg(*[F.try_divide(F.sum(f"s_{y}"), F.sum(f"n_{y}")).alias(y) for y in ys]).first()
    means = {y: total[y] for y in ys}
    effects: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for g in groupings:
            rest, off = cells, {y: F.lit(means[y] or 0.0) for y in ys}
            for i, (other, table) in enumerate(effects.items()):
                if other != g:
                    renamed = table.select(F.col("level").alias(f"__ax_l{i}"), *[F.col(y).alias(f"__ax_{i}_{y}") for y in ys])
                    rest = rest.join(renamed, F.col(other) == F.col(f"__ax_l{i}"), "left")
                    off = {y: off[y] + F.coalesce(F.col(f"__ax_{i}_{y}"), F.lit(0.0)) for y in ys}
            parts = []
            for y in ys:
                n, s, o = F.col(f"n_{y}"), F.col(f"s_{y}"), off[y]
                parts += [F.sum(n).alias(f"n_{y}"), F.sum(s - n * o).alias(f"s_{y}"), F.sum(F.col(f"ss_{y}") - 2 * o * s + n * o * o).alias(f"ss_{y}")]
            levels = rest.where(F.col(g).isNotNull()).groupBy(F.col(g).alias("level")).agg(*parts)
            spread = levels.agg(*[c for y in ys for c in _effect(y)])  # one row
            shrunk = [F.coalesce(F.col(f"s_{y}") * F.col(f"var_{y}") / F.nullif(F.col(f"n_{y}") * F.col(f"var_{y}") + F.col(f"rest_{y}"), F.lit(0.0)), F.lit(0.0)).alias(y) for y in ys]
            effects[g] = materialize(levels.crossJoin(F.broadcast(spread)).select("level", *shrunk), f"effects-of-{g}")
    return means, effects


def fill_numbers(df: DataFrame, companions: dict[str, str | None], groupings: list[str]) -> DataFrame:
    """df, in which missing numbers are null, with each y of companions filled and `<y>_filled`. The companion of y, if any, is a column of df that is null where it is missing; companions are used as they are in df, not as filled."""
    ys = list(companions)
    responses = [c for y in ys for c in (F.col(y).alias(f"alone_{y}"), (F.col(y) - F.col(companions[y]) if companions[y] else F.lit(None).cast("double")).alias(f"near_{y}"))]
    names = [f"{kind}_{y}" for y in ys for kind in ("alone", "near")]
    means, effects = mixed_effects(df.select(*groupings, *responses), names, groupings)
    table = df.where(" OR ".join(f"`{y}` IS NULL" for y in ys)).select(*groupings).distinct()
    guess = {r: F.lit(means[r]).cast("double") for r in names}
    for i, (g, effect) in enumerate(effects.items()):
        renamed = effect.select(F.col("level").alias(f"__ax_l{i}"), *[F.col(r).alias(f"__ax_{i}_{r}") for r in names])
        table = table.join(renamed, F.col(g) == F.col(f"__ax_l{i}"), "left")
        guess = {r: guess[r] + F.coalesce(F.col(f"__ax_{i}_{r}"), F.lit(0.0)) for r in names}
    table = materialize(table.select(*groupings, *[guess[r].alias(f"__ax_{r}") for r in names]), "predicted")
    got = df.alias("d").join(table.alias("p"), _same("d", "p", groupings), "left").select("d.*", *[f"p.__ax_{r}" for r in names])
    value = {y: F.coalesce(F.col(companions[y]) + F.col(f"__ax_near_{y}"), F.col(f"__ax_alone_{y}")) if companions[y] else F.col(f"__ax_alone_{y}") for y in ys}
    return got.select(*[F.coalesce(F.col(c), value[c]).alias(c) if c in ys else F.col(c) for c in df.columns], *[F.col(y).isNull().alias(f"{y}_filled") for y in ys])


def fill_category(df: DataFrame, c: str, features: list[str], time: str, weight: float = 2.0) -> DataFrame:
    """df, in which missing c is null, with c filled and `<c>_filled`."""
    known = df.where(F.col(c).isNotNull())
    by_time = materialize(known.groupBy(F.col(c).alias("cat"), F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n")), "categories-by-time")
    overall = by_time.groupBy("cat").agg(F.sum("n").alias("n_cat"))
    total = by_time.agg(F.sum("n").alias("n")).first()["n"] or 0
    cases = df.where(F.col(c).isNull()).select(*features, time).distinct().withColumn("case", F.xxhash64(F.to_json(F.struct(*features, time), {"ignoreNullFields": "false"})))
    cases = materialize(cases, "category-cases")

    pairs = lambda rows, *more: rows.select(*more, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features])).alias("f")).select(*more, "f.feature", "f.level").where("level IS NOT NULL")
    seen = pairs(known.groupBy(*features, F.col(c).alias("cat")).agg(F.count(F.lit(1)).alias("n")), "cat", "n").groupBy("feature", "level", "cat").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "feature-counts")
    shares = seen.groupBy("feature", "level").agg((F.sum("n") / F.lit(float(total or 1))).alias("share"))
    gains = seen.join(shares, ["feature", "level"]).select("feature", "level", "cat", F.log1p(F.col("n") / (F.lit(weight) * F.col("share"))).alias("gain"))
    wanted = pairs(cases, "case", time)
    votes = wanted.join(gains, ["feature", "level"]).groupBy("case", F.col(time).alias("time"), "cat").agg(F.sum("gain").alias("gain"))
    n_features = wanted.groupBy("case").agg(F.count(F.lit(1)).alias("n_features"))
    votes = votes.join(n_features, "case").join(overall, "cat")

    def prior(rows: DataFrame) -> DataFrame:
        r = rows.alias("r").join(by_time.alias("t"), _same("r", "t", ["cat", "time"]), "left").select("r.*", F.coalesce("t.n", F.lit(0)).alias("n_then"))
        return r.withColumn("prior", F.log(F.col("n_then") + F.lit(10.0) * F.col("n_cat") / F.lit(float(total or 1))))

    scored = prior(votes).withColumn("score", F.col("prior") + F.col("gain") - F.col("n_features") * F.log(F.col("n_cat") + F.lit(weight)))
    best = scored.groupBy("case").agg(F.max("score").alias("top"))
    voted = scored.join(best, "case").where("score = top").groupBy("case").agg(F.min("cat").alias("__ax_cat"))
    # without a vote: the most frequent category of the time, else of all
    then = by_time.groupBy("time").agg(F.max_by("cat", F.struct("n", "cat")).alias("__ax_then"))
    top = overall.agg(F.max_by("cat", F.struct("n_cat", "cat")).alias("cat")).first()["cat"]
    fills = cases.join(voted, "case", "left").alias("c").join(then.alias("t"), F.col(f"c.{time}").eqNullSafe(F.col("t.time")), "left")
    fills = fills.select(*[F.col(f"c.{f}") for f in features], F.col(f"c.{time}"), F.coalesce("c.__ax_cat", "t.__ax_then", F.lit(top)).alias("__ax_cat"))
    fills = materialize(fills, "category-fills")
    got = df.alias("d").join(fills.alias("f"), _same("d", "f", [*features, time]), "left").select("d.*", "f.__ax_cat")
    return got.withColumn(f"{c}_filled", F.col(c).isNull()).withColumn(c, F.coalesce(c, "__ax_cat")).drop("__ax_cat")
