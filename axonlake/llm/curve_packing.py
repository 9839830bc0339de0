"""Containers of fixed capacity filled with items along a space-filling curve.

1. Each text is measured in tokens; the counts of its token ids are hashed to a few dimensions by a fixed random projection, centred and
   scaled by the statistics of all texts.
2. The position on a Hilbert curve through these dimensions is the sort key; items are range-partitioned by it, so neighbours are alike.
3. Along the curve each piece goes to the fullest of the `open_containers` open ones it fits into, else to a new one; the fullest is
   closed when too many are open. Ranges hold about `range_capacity` containers, so a task's work has a bound, whatever the input.
4. What is left open at the ends of the ranges, at most `open_containers` each, is packed once more, as whole loads, in fewer tasks.

A text longer than a container is cut into full containers and a rest; others are never cut. Defined cases: null and empty texts have
size 0 and lie in a container like others; repeated texts are items of their own; ties on the curve are ordered by id; an empty table
gives no rows; a null id is an id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.llm.bpe import DEFAULT_VOCABULARY, encoder
from axonlake.sources.scratch import materialize

DIMENSIONS, BITS = 3, 10
HASHED = 1 << 16


def directions(dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """The projection of each hashed token id, the same wherever it is made."""
    return np.random.RandomState(seed).standard_normal((HASHED, dimensions))


def measured(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """STRUCT<n: INT, v: ARRAY<DOUBLE>>: size in tokens and projected direction of each text."""

    @F.arrow_udf("struct<n:int,v:array<double>>")
    def measure(texts: pa.Array) -> pa.Array:
        encode, table = encoder(vocabulary).encode, directions()
        sizes, places = np.zeros(len(texts), np.int32), np.zeros((len(texts), DIMENSIONS))
        for i, t in enumerate(texts):
            ids = np.array(encode(t.as_py()), np.int64)
            sizes[i] = len(ids)
            if len(ids):
                token, count = np.unique(ids * 40503 % HASHED, return_counts=True)
                weight = np.sqrt(count)
                places[i] = weight @ table[token] / np.linalg.norm(weight)
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIMENSIONS), pa.array(places.ravel()))
        return pa.StructArray.from_arrays([pa.array(sizes), v], names=["n", "v"])

    return measure(text)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), each coordinate below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Packer:
    """Best fit into a bounded number of open containers."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.open: list[tuple[int, int]] = []  # (room, container), sorted

    def place(self, size: int) -> int:
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            room, container = self.open.pop(k)
        else:
            room, container = self.capacity, self.next_id
            self.next_id += 1
        if room > size:
            insort(self.open, (room - size, container))
            if len(self.open) > self.most_open:
                self.open.pop(0)
        return container


def pack(items: DataFrame, item_id: str, size: str, key: str, capacity: int, open_containers: int = 64, range_containers: int = 2000) -> DataFrame:
    """(item_id, piece, start, n, container_id): pieces of each item in order of the key."""
    total = items.agg(F.sum(size).alias("s")).first()["s"] or 0
    ranges = max(1, round(total / (capacity * range_containers)))
    rows = items.select(F.col(item_id).alias("id"), F.col(size).alias("size"), F.col(key).alias("key")).repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id")
    rows = rows.withColumn("range_id", F.spark_partition_id())

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = None
        for batch in batches:
            if packer is None and len(batch):
                packer = Packer(capacity, open_containers, int(batch["range_id"].iloc[0]) << 32)
            out: list[tuple] = []
            for i, n in zip(batch["id"], batch["size"]):
                for piece in range(max(1, -(-n // capacity))):
                    start = piece * capacity
                    part = min(capacity, n - start)
                    out.append((i, piece, start, part, packer.place(part)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "n", "container_id"])

    kind = dict(items.dtypes)[item_id]
    placed = rows.mapInPandas(along, f"id {kind}, piece int, start long, n int, container_id long")
    return placed.withColumnRenamed("id", item_id)


def repack(placed: DataFrame, capacity: int, fill: float = 0.9, open_containers: int = 64, loads_per_task: int = 100_000) -> DataFrame:
    """The containers filled less than `fill` are packed once more, as whole loads, largest first."""
    loads = placed.groupBy("container_id").agg(F.sum("n").alias("load")).where(F.col("load") < F.lit(capacity * fill))
    loads = materialize(loads, "loads")
    tasks = max(1, -(-loads.count() // loads_per_task))
    rows = loads.repartition(tasks, F.expr(f"(container_id >> 32) % {tasks}")).sortWithinPartitions(F.desc("load"), "container_id")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, names = Packer(capacity, 1 << 30, 0), {}
        for batch in batches:
            into = []
            for c, n in zip(batch["container_id"], batch["load"]):
                k = packer.place(n)
                into.append(names.setdefault(k, c))
            yield pd.DataFrame({"container_id": batch["container_id"], "into": into})

    moved = rows.mapInPandas(again, "container_id long, into long")
    return placed.join(moved, "container_id", "left").withColumn("container_id", F.coalesce("into", "container_id")).drop("into")


def pack_texts(docs: DataFrame, doc_id: str, text: str, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, n, container_id)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), measured(F.col(text), vocabulary).alias("m")).select("doc_id", "m.n", "m.v")
    sized = materialize(sized, "measured")
    axes = range(DIMENSIONS)
    stats = sized.where("n > 0").agg(*[f(F.col("v")[a]).alias(f"{name}{a}") for a in axes for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre, spread = [stats[f"m{a}"] or 0.0 for a in axes], [stats[f"s{a}"] or 1.0 for a in axes]

    @F.arrow_udf("long")
    def key(v: pa.Array) -> pa.Array:
        points = (v.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS) - centre) / spread
        unit = 1 / (1 + np.exp(-1.702 * points))  # close to the normal distribution function, so cells are used evenly
        return pa.array(hilbert_keys(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)))

    keyed = sized.select("doc_id", "n", key("v").alias("key"))
    placed = materialize(pack(keyed, "doc_id", "n", "key", capacity), "packed")
    return repack(placed, capacity)
