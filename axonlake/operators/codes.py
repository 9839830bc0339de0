"""Sparse codes: winners, coincidence, overlap, nearest codes. A code is a set of (item, idx) rows, a score table has a score per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize


def winners(scores: DataFrame, item: list[str], score: str, k: int) -> DataFrame:
    """Rows whose score is at least the k-th largest of the item; ties all win. Null scores lose."""
    w = Window.partitionBy(*item).orderBy(F.desc(score))
    return scores.where(F.col(score).isNotNull()).withColumn("__ax_r", F.rank().over(w)).where(F.col("__ax_r") <= k).drop("__ax_r")


def exactly(scores: DataFrame, item: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the largest scores, the smallest `tie` first on equal ones."""
    w = Window.partitionBy(*item).orderBy(F.desc(score), F.col(tie))
    return scores.where(F.col(score).isNotNull()).withColumn("__ax_r", F.row_number().over(w)).where(F.col("__ax_r") <= k).drop("__ax_r")


def coincident(code: DataFrame, edges: DataFrame, item: str, idx: str, least: int) -> DataFrame:
    """(item, post, n): targets with at least `least` active partners of an item, distinct and unweighted."""
    met = code.select(item, F.col(idx).alias("pre")).distinct().join(edges.select("pre", "post").distinct(), "pre")
    return met.groupBy(item, "post").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def overlaps(code: DataFrame, item: str, idx: str) -> DataFrame:
    """(a, b, common, jaccard) of the pairs of items that share an index, a < b, joined by the index; the number of items that share one must be small."""
    c = code.select(F.col(item).alias("i"), F.col(idx).alias("x")).where("i IS NOT NULL AND x IS NOT NULL").distinct()
    size = c.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select(F.col("i").alias("a"), "x"), c.select(F.col("i").alias("b"), "x")
    common = a.join(b, "x").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    sized = common.join(size.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def nearest(queries: DataFrame, rows: DataFrame, item: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query, item, cosine, place): the k rows nearest to each query vector by cosine, itself left out; smaller items first on ties. The
    queries are a stated set, stored in files of about `block` of them; a batch of rows meets each file as one matrix product, and keeps k per
    query. Tasks read the files themselves, so neither the plan nor the driver grows with the queries."""
    marked = queries.select(F.col(item).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-marked.count() // block))
    paths = materialize(marked.repartition(blocks, F.xxhash64("q")), "queries").inputFiles()  # one path per block

    def load(path: str) -> tuple[np.ndarray, np.ndarray]:
        fs, name = pafs.FileSystem.from_uri(path)
        got = pq.read_table(name, filesystem=fs, columns=["q", "v"]).to_pydict()
        m = np.array(got["v"], dtype=float).reshape(len(got["q"]), -1)
        return np.array(got["q"]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [load(paths[0])] if len(paths) == 1 else None
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["v"].tolist(), dtype=float)
            length, own = np.linalg.norm(x, axis=1), batch["item"].to_numpy()
            for ids, m in held or map(load, paths):
                if not len(ids):
                    continue
                s = np.round((x @ m.T) / np.maximum(length, 1e-300)[:, None], 12)
                s[own[:, None] == ids[None, :]] = -np.inf
                keep = min(k, len(own))
                order = np.lexsort((np.repeat(own[:, None], len(ids), 1), -s), axis=0)[:keep]
                flat = order.ravel()
                yield pd.DataFrame({"query": np.tile(ids, keep), "item": own[flat], "cosine": s[flat, np.tile(np.arange(len(ids)), keep)]})

    kind = dict(rows.dtypes)[item]
    found = rows.select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInPandas(search, f"query {kind}, item {kind}, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "item"))
    return found.where("cosine >= -1.1").withColumn("place", place).where(F.col("place") <= k)
