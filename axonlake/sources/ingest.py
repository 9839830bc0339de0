"""Tolerant reading of edge and annotation files, and sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.sources.scratch import materialize


def resolved(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """df with each column named by the first of its aliases that df has, in any case; an error if it has none."""
    names = {c.lower(): c for c in reversed(df.columns)}
    picked = []
    for name, candidates in aliases.items():
        found = next((names[a.lower()] for a in candidates if a.lower() in names), None)
        if found is None:
            raise ValueError(f"none of {candidates} among {df.columns}")
        picked.append(F.col(f"`{found}`").alias(name))
    return df.select(*picked)


def read_annotations(spark: SparkSession, path: str, key: str = "root_id", keep: list[str] | None = None) -> DataFrame:
    """A tab-separated annotation file: rows without key are dropped, the key is LONG, blanks are null, columns are pruned to `keep`."""
    rows = spark.read.csv(path, sep="\t", header=True, nullValue="", emptyValue="")
    rows = rows.withColumn(key, F.expr(f"try_cast(try_cast({key} AS DECIMAL(20,0)) AS BIGINT)")).where(F.col(key).isNotNull())
    return rows.select(*[c for c in keep if c in rows.columns]) if keep else rows


def read_delimited(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Comma-separated files with headers of their own in one table, columns by name, absent ones null."""
    frames = [spark.read.csv(p, header=True) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a file of one JSON object per line."""
    # the text of a line is kept beside its columns; written once, since a scan must not ask for the bad lines only
    rows = materialize(spark.read.text(path).select(F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*"), "json-rows")
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL").select("_bad")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in folders by columns; rows of one folder come from as few tasks as there are rows for."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def append_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, beside the old output first; then the old is moved away and the new put in its place, so at no time there is only part of one. What a job that died left aside stays readable as `path.old`."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, at = hadoop(f"{path}.new-{uuid.uuid4().hex}"), hadoop(f"{path}.old"), hadoop(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.json(new.toString())
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{path} can't be put in place; the new output is in {new.toString()}")
    fs.delete(old, True)


def cached(spark: SparkSession, path: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at path, if it was built for this key (parameters, a version of the input); else build's, stored there with its key, which is written last."""
    meta = json.dumps(key, sort_keys=True, default=str)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{path}/key/_SUCCESS")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) and [r[0] for r in spark.read.text(f"{path}/key").collect()] == [meta]:
        return spark.read.parquet(f"{path}/rows")
    here = hadoop(path)
    here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(here, True)
    build().write.parquet(f"{path}/rows")
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/key")
    return spark.read.parquet(f"{path}/rows")


def validated(rows: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `reasons`): rules are SQL conditions by the name of what is wrong when one isn't true."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()])) if rules else F.array().cast("array<string>")
    told = rows.withColumn("reasons", reasons)
    return told.where(F.size("reasons") == 0).drop("reasons"), told.where(F.size("reasons") > 0)


def scene_document(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a nested JSON document of nodes and edges (for scenes, whose size is set by the caller)."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(name).alias("name"), "nodes", "edges")).alias("document"))


def parse_json(text: str) -> dict | None:
    """The first JSON object in a text with fences or words around it; None if there is none."""
    start, end = text.find("{"), text.rfind("}")
    try:
        got = json.loads(text[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None
