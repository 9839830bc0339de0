"""Clamped vitals, flags and cooldowns per key, replayed in batch or kept in a stream.

A change of a clamped value, x -> min(high, max(low, x + d)), stays of this form when changes follow one another, so a long history need
not be folded in one piece: each block of a key's history is composed to one such map, the maps of its blocks are composed in order.
Batch replay and the streaming operator give the same state.

Defined cases: null deltas change nothing; events of equal time are ordered by the tie column; a key without events has no row; deltas that
are NaN count as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axonlake.sources.scratch import new_path

LOW, HIGH = 0.0, 100.0


def _composed(maps: Column) -> Column:
    """An ordered array of structs (.., m: (add, low, high)) as one map (add, low, high)."""
    start = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def then(f: Column, s: Column) -> Column:
        g = s["m"]
        bound = lambda x: F.least(g["high"], F.greatest(g["low"], x + g["add"]))
        return F.struct((f["add"] + g["add"]).alias("add"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"))

    return F.aggregate(maps, start, then)


def clamped_fold(events: DataFrame, key: str, at: str, tie: str, delta: Column, start: float, block: Column) -> DataFrame:
    """(key, value, n): the value after all of a key's events in order. block: a column that doesn't fall as `at` rises and parts a history into pieces that fit a task (a day, an hour)."""
    step = F.struct(F.coalesce(F.nanvl(delta, F.lit(0.0)), F.lit(0.0)).alias("add"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    rows = events.select(F.col(key), block.alias("__ax_block"), F.struct(F.col(at).alias("t"), F.col(tie).alias("i"), step.alias("m")).alias("e"))
    blocks = rows.groupBy(key, "__ax_block").agg(_composed(F.array_sort(F.collect_list("e"))).alias("m"), F.count(F.lit(1)).alias("n"))
    keys = blocks.groupBy(key).agg(_composed(F.array_sort(F.collect_list(F.struct("__ax_block", "m")))).alias("m"), F.sum("n").alias("n"))
    return keys.select(key, F.least(F.col("m.high"), F.greatest(F.col("m.low"), F.lit(start) + F.col("m.add"))).alias("value"), "n")


def rest_episodes(ticks: DataFrame, key: str, at_s: str, tie: str, dt: str, start: float = 60.0, fall: float = 0.30, threshold: float = 30.0, cooldown_s: float = 60.0, gain: float = 3.0, length: int = 10) -> DataFrame:
    """(key, energy, episodes): energy falls with each tick; at the threshold, cooldown_s or more after the last episode began, an episode begins, and each of its `length` ticks after that gives `gain`. A key's ticks pass through one task in order, with four numbers of state."""
    kind = dict(ticks.dtypes)[key]
    rows = ticks.select(key, at_s, tie, dt).repartition(key).sortWithinPartitions(key, at_s, tie)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, energy, left, began, n = None, start, 0, float("-inf"), 0
        first, done = True, []
        for batch in batches:
            for k, t, step in zip(batch[key], batch[at_s], batch[dt]):
                if first or k != now:
                    if not first:
                        done.append((now, energy, n))
                    now, energy, left, began, n, first = k, start, 0, float("-inf"), 0, False
                energy = min(HIGH, max(LOW, energy - fall * (0.0 if step != step else step)))
                if left:
                    left, energy = left - 1, min(HIGH, energy + gain)
                elif energy <= threshold and t - began >= cooldown_s:
                    left, began, n = length, t, n + 1
            yield pd.DataFrame(done, columns=[key, "energy", "episodes"])
            done = []
        if not first:
            yield pd.DataFrame([(now, energy, n)], columns=[key, "energy", "episodes"])

    return rows.mapInPandas(walk, f"{key} {kind}, energy double, episodes long")


def mood(energy: Column, hunger: Column, boredom: Column) -> Column:
    """The first that applies: hungry (70 and more), tired (25 and less), bored (70 and more), cheerful, calm."""
    return F.when(hunger >= 70, "hungry").when(energy <= 25, "tired").when(boredom >= 70, "bored").when((energy >= 80) & (hunger <= 25), "cheerful").otherwise("calm")


def live_flags(events: DataFrame, key: str, flag: str, at: str, ttl_s: float, now: Column) -> DataFrame:
    """(key, flag, expires) of the flags set less than ttl_s seconds before now, each by its last setting."""
    last = events.groupBy(key, flag).agg(F.max(at).alias("__ax_last"))
    expires = F.col("__ax_last") + F.make_dt_interval(secs=F.lit(ttl_s))
    return last.select(key, flag, expires.alias("expires")).where(F.col("expires") > now)


def throttled(events: DataFrame, key: str, at: str, tie: str, gap_s: int) -> DataFrame:
    """The events that fire: the first of a key, then each that comes gap_s seconds or more after the last that fired. A key's events pass through one task in order, with one number of state."""
    rows = events.repartition(key).sortWithinPartitions(key, at, tie)
    schema = events.schema

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, fired = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch[at]):
                if k != who or (t - fired).total_seconds() >= gap_s:
                    who, fired = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch[keep]

    return rows.mapInPandas(pick, schema)


def stream_vitals(stream: DataFrame, key: str, at: str, tie: str, start: float) -> DataFrame:
    """A streaming DataFrame (key, value, n, last): the clamped value of each key after every batch with events of it. stream: key LONG, at, tie, delta."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(frames)).sort_values([at, tie])
        for d in rows["delta"]:
            value = min(HIGH, max(LOW, value + (0.0 if d is None or d != d else d)))
        n += len(rows)
        state.update((value, n))
        yield pd.DataFrame({key: [k[0]], "value": [value], "n": [n], "last": [rows[at].iloc[-1]]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, value double, n long, last timestamp", "value double, n long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a streaming DataFrame over what its source holds now and returns what it wrote. Its offsets and state lie in the shared folder, so a run goes on after a loss."""
    spark = stream.sparkSession
    out, marks = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, slide: str, late: str) -> DataFrame:
    """A streaming DataFrame of counts per event-time window; rows later than the watermark are dropped, windows come out when it passes them."""
    w = F.window(at, width, slide)
    return stream.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), by, "n")
