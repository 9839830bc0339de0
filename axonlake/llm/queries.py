"""Queries of this subpackage's problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm import bpe, curve_packing, residue, sorted_ranks, top_bands
from axonlake.sources.tables import table

TOP_N = 5
CONTAINER_TOKENS = 2048
PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def input_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """(post, pre, total) with each edge_id once, and score bounds from the rows' own counts."""
    edges = table(spark, sf_dir, "connections").where("pre_pt_root_id IS NOT NULL AND post_pt_root_id IS NOT NULL AND syn_count IS NOT NULL")
    lower = top_bands.bounds(edges, "syn_count")
    # a repeated edge has the same ends, so one shuffle by both ends serves the removal of repeats and the totals
    pairs = edges.select("post_pt_root_id", "pre_pt_root_id", "edge_id", "syn_count").repartition("post_pt_root_id", "pre_pt_root_id")
    once = pairs.groupBy("post_pt_root_id", "pre_pt_root_id", "edge_id").agg(F.max("syn_count").alias("syn_count"))
    return once.groupBy("post_pt_root_id", "pre_pt_root_id").agg(F.sum("syn_count").alias("total")), lower


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, lower = input_totals(spark, sf_dir)
    best = top_bands.top_n(totals, ["post_pt_root_id"], "total", ["pre_pt_root_id"], TOP_N, lower)
    return best.select("post_pt_root_id", F.col("place").cast("int").alias("place"), "pre_pt_root_id")


def acc_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mergeable states of `acc`: (arm, day, v, n), each trial_id once."""
    trials = table(spark, sf_dir, "trials").where("trial_id IS NOT NULL").select("trial_id", "arm", "run_at", "acc", "loaded_at")
    first = trials.groupBy("trial_id").agg(F.min_by(F.struct("arm", "run_at", "acc"), F.struct("loaded_at", "arm", "run_at", "acc")).alias("t"))
    once = first.select("t.arm", F.date_format("t.run_at", "yyyy-MM-dd").alias("day"), "t.acc")
    return sorted_ranks.value_states(once, ["arm", "day"], "acc")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per arm and day, and per arm all together (day 'all'), the latter from the daily states."""
    daily = acc_states(spark, sf_dir).withColumn("day", F.coalesce("day", F.lit("none")))
    longer = sorted_ranks.merge_states(daily.withColumn("day", F.lit("all")), ["arm", "day"])
    got = sorted_ranks.percentiles(daily.unionByName(longer), ["arm", "day"], PROBS)
    return got.select("arm", "day", "n", *[F.round(p, 9).alias(p) for p in PROBS])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text, or each piece of a text longer than a container, lies."""
    return curve_packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER_TOKENS)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are filled to each tenth."""
    loads = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n").alias("load"))
    tenth = F.ceil(F.col("load") * 10 / F.lit(CONTAINER_TOKENS)).cast("int").alias("tenth")
    return loads.groupBy(tenth).agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"), lang="lang").select("doc_id").distinct()


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was left out, and why."""
    return residue.residue(table(spark, sf_dir, "documents"), lang="lang")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents left out."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(residue.residue(docs, lang="lang").select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES = {"p2_found": p2_found, "p3_percentiles": p3_percentiles, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_reasons": p10_reasons, "p10_kept": p10_kept}

SQL = {
    "p2_found": """
        WITH once AS (SELECT DISTINCT edge_id, post_pt_root_id, pre_pt_root_id, syn_count FROM connections
                      WHERE pre_pt_root_id IS NOT NULL AND post_pt_root_id IS NOT NULL AND syn_count IS NOT NULL),
        totals AS (SELECT post_pt_root_id, pre_pt_root_id, sum(syn_count) AS total FROM once GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY post_pt_root_id ORDER BY total DESC, pre_pt_root_id) AS place FROM totals)
        SELECT post_pt_root_id, CAST(place AS INTEGER) AS place, pre_pt_root_id FROM ranked WHERE place <= 5""",
    "p3_percentiles": """
        WITH ranked AS (SELECT arm, strftime(run_at, '%Y-%m-%d') AS day, acc,
                               row_number() OVER (PARTITION BY trial_id ORDER BY loaded_at, arm, run_at, acc) AS rn
                        FROM trials WHERE trial_id IS NOT NULL),
        once AS (SELECT arm, coalesce(day, 'none') AS day, CASE WHEN NOT isnan(acc) THEN acc END AS acc FROM ranked WHERE rn = 1),
        both_times AS (SELECT * FROM once UNION ALL SELECT arm, 'all' AS day, acc FROM once)
        SELECT arm, day, count(acc) AS n, round(quantile_cont(acc, 0.5), 9) AS p50, round(quantile_cont(acc, 0.9), 9) AS p90,
               round(quantile_cont(acc, 0.99), 9) AS p99
        FROM both_times GROUP BY arm, day""",
}
