"""Problem 1: rows and synapse totals per neuropil, though a few neuropils own most edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators import offset_chunks as oc
from axonlake.sources.tables import table

HEAVY_SHARE_PERCENT = 4


def neuropil_states(spark: SparkSession, sf_dir: str, chunk_rows: int = 1_000_000) -> DataFrame:
    edges = table(spark, sf_dir, "connections").where(F.col("neuropil").isNotNull())
    states = [oc.counted("n_rows"), oc.summed("syn_total", F.col("syn")), oc.largest("largest_syn", F.col("syn"))]
    return oc.per_key(edges, "neuropil", states, {"syn": F.col("syn_count")}, chunk_rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = neuropil_states(spark, sf_dir)
    total = states.agg(F.sum("n_rows").alias("total"))  # one row
    return states.crossJoin(F.broadcast(total)).where(F.col("n_rows") * 100 >= F.col("total") * HEAVY_SHARE_PERCENT).select("neuropil")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neuropil_states(spark, sf_dir).select("neuropil", "n_rows", F.coalesce("syn_total", F.lit(0)).alias("syn_total"), "largest_syn")


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals}

SQL = {
    "p1_found": """
        SELECT neuropil FROM connections WHERE neuropil IS NOT NULL GROUP BY neuropil
        HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM connections WHERE neuropil IS NOT NULL)""",
    "p1_totals": """
        SELECT neuropil, count(*) AS n_rows, CAST(coalesce(sum(syn_count), 0) AS BIGINT) AS syn_total, max(syn_count) AS largest_syn
        FROM connections WHERE neuropil IS NOT NULL GROUP BY neuropil""",
}
