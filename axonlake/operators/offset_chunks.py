"""Work per key in chunks of equal size, however many rows a key has.

Two passes over the input, which has to be a stored table or a deterministic projection of one (its partitions must hold the same
rows whenever they are computed; use `scratch.materialize` otherwise):

1. rows are counted per (input partition, key); prefix sums of these counts, taken in two levels so that no task sees more than one
   block, number the rows of a key without gaps and lay all keys end to end;
2. every row gets its number from its place within its sorted partition and falls into the chunk `number div chunk_rows`. States are
   built per (chunk, key), partly before the shuffle, and the states of a key that runs over several chunks are merged in the order
   of the chunks.

Defined cases: a null key is a key like others; an empty table gives no rows; repeated rows count each time; ties of a key keep the
order of partitions and the order within them as read; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize

#: Rows of the offsets (a number of input partitions times the keys in each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
BLOCK = 1024
BUCKETS = 2048

_PID, _KEY, _NO, _CHUNK = "__ax_pid", "__ax_key", "__ax_no", "__ax_chunk"


@dataclass(frozen=True)
class ChunkState:
    """name of the output; state of one chunk as an aggregate over rows (a row's number is the column `NUMBER`); merge of the chunks' states, given their column and that of the chunk number."""

    name: str
    state: Column
    merge: Callable[[Column, Column], Column]


NUMBER = _NO


def counted(name: str, what: Column | None = None) -> ChunkState:
    return ChunkState(name, F.count(F.lit(1) if what is None else what), lambda s, _: F.sum(s))


def summed(name: str, what: Column) -> ChunkState:
    return ChunkState(name, F.sum(what), lambda s, _: F.sum(s))


def smallest(name: str, what: Column) -> ChunkState:
    return ChunkState(name, F.min(what), lambda s, _: F.min(s))


def largest(name: str, what: Column) -> ChunkState:
    return ChunkState(name, F.max(what), lambda s, _: F.max(s))


def earliest(name: str, what: Column) -> ChunkState:
    """The value of a key's first row."""
    return ChunkState(name, F.min_by(F.struct(what.alias("v")), F.col(_NO)), lambda s, c: F.min_by(s, c)["v"])


def latest(name: str, what: Column) -> ChunkState:
    """The value of a key's last row."""
    return ChunkState(name, F.max_by(F.struct(what.alias("v")), F.col(_NO)), lambda s, c: F.max_by(s, c)["v"])


def partition_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per (input partition, key)."""
    return df.select(F.spark_partition_id().alias(_PID), F.col(key).alias(_KEY)).groupBy(_PID, _KEY).agg(F.count(F.lit(1)).alias("n"))


def offsets(counts: DataFrame) -> DataFrame:
    """For each (input partition, key): `first_no`, the number of its first row when all keys lie end to end, and `sorted_at`, its first place in the partition sorted by key, and `n`, its rows there."""
    blocked = counts.withColumn("block", F.expr(f"{_PID} div {BLOCK}")).withColumn("bucket", F.pmod(F.xxhash64(_KEY), F.lit(BUCKETS)))
    running = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = blocked.groupBy("bucket", _KEY, "block").agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("before_block", running(Window.partitionBy(_KEY).orderBy("block"))).drop("n")
    keys = blocked.groupBy("bucket", _KEY).agg(F.sum("n").alias("n"))
    buckets = keys.groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.withColumn("before_bucket", running(Window.orderBy("bucket"))).drop("n")  # BUCKETS rows at most
    keys = keys.withColumn("before_key", running(Window.partitionBy("bucket").orderBy(_KEY))).drop("n")
    b, k = blocks.alias("b"), keys.alias("k")
    same = lambda x, y: F.col(f"{x}.{_KEY}").eqNullSafe(F.col(f"{y}.{_KEY}"))
    bases = b.join(k, (F.col("b.bucket") == F.col("k.bucket")) & same("b", "k")).join(buckets.alias("u"), F.col("b.bucket") == F.col("u.bucket"))
    bases = bases.select(F.col(f"b.{_KEY}"), "b.block", (F.col("before_bucket") + F.col("before_key") + F.col("before_block")).alias("base"))
    placed = blocked.withColumn("in_block", running(Window.partitionBy(_KEY, "block").orderBy(_PID)))
    placed = placed.withColumn("sorted_at", running(Window.partitionBy(_PID).orderBy(F.col(_KEY).asc_nulls_first())))
    p, a = placed.alias("p"), bases.alias("a")
    return p.join(a, same("p", "a") & (F.col("p.block") == F.col("a.block"))).select(F.col(f"p.{_PID}"), F.col(f"p.{_KEY}"), "sorted_at", "n", (F.col("base") + F.col("in_block")).alias("first_no"))


def numbered(df: DataFrame, key: str, columns: dict[str, Column] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The key and the given columns of every row with its number `NUMBER`: 0, 1, 2, ... over the whole table, the rows of a key in one piece."""
    counts = materialize(partition_counts(df, key), "key-counts")
    places = offsets(counts).withColumnsRenamed({_PID: "__ax_opid", _KEY: "__ax_okey", "n": "__ax_n"})
    if counts.count() <= broadcast_rows:
        places = F.broadcast(places)
    rows = df.select(F.col(key).alias(_KEY), *[c.alias(n) for n, c in (columns or {}).items()])
    rows = rows.sortWithinPartitions(F.col(_KEY).asc_nulls_first())
    rows = rows.select("*", F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias("__ax_id"))
    rows = rows.withColumn("__ax_at", F.col("__ax_id") - F.shiftleft(F.col(_PID).cast("long"), 33))
    joined = rows.join(places, (F.col(_PID) == F.col("__ax_opid")) & F.col(_KEY).eqNullSafe(F.col("__ax_okey")), "left")
    # a row that the counts don't know means that the two scans were split in different ways; no row may be lost or take another's number for that
    place = F.col("__ax_at") - F.col("sorted_at")
    known = F.coalesce((place >= 0) & (place < F.col("__ax_n")), F.lit(False))
    joined = joined.withColumn(_NO, F.when(known, F.col("first_no") + place).otherwise(F.raise_error(F.lit("the input's partitions changed between two scans; store it first")).cast("long")))
    return joined.drop(_PID, "__ax_id", "__ax_at", "__ax_opid", "__ax_okey", "first_no", "sorted_at", "__ax_n")


def chunk_states(df: DataFrame, key: str, states: list[ChunkState], columns: dict[str, Column], chunk_rows: int) -> DataFrame:
    """One row per (chunk, key): the states of the key within the chunk."""
    rows = numbered(df, key, columns).withColumn(_CHUNK, F.expr(f"{_NO} div {chunk_rows}"))
    return rows.groupBy(_CHUNK, _KEY).agg(*[s.state.alias(s.name) for s in states])


def per_key(df: DataFrame, key: str, states: list[ChunkState], columns: dict[str, Column] | None = None, chunk_rows: int = 1_000_000) -> DataFrame:
    """One row per key with the merged states. columns: what the states' expressions may refer to, by name."""
    chunks = chunk_states(df, key, states, columns or {}, chunk_rows)
    merged = chunks.groupBy(_KEY).agg(*[s.merge(F.col(s.name), F.col(_CHUNK)).alias(s.name) for s in states])
    return merged.withColumnRenamed(_KEY, key)
