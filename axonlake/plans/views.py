"""The tables as a graph: edges (pre, post, np, w) and nodes (id, ...), and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions.cells import label, sign_by_names, sign_by_prefix
from axonlake.sources.tables import table


def edges(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Every edge row once, with both ends and a weight. Rows are dealt out by the columns `by`, if given, before repeats are dropped, so that a later aggregation by them shuffles no more; one value's rows then meet in one task."""
    rows = table(spark, sf_dir, "connections").where("pre_pt_root_id IS NOT NULL AND post_pt_root_id IS NOT NULL AND syn_count IS NOT NULL")
    rows = rows.select("edge_id", F.col("pre_pt_root_id").alias("pre"), F.col("post_pt_root_id").alias("post"), F.col("neuropil").alias("np"), F.col("syn_count").cast("long").alias("w"))
    rows = rows.repartition(*by) if by else rows
    return rows.dropDuplicates(["edge_id", "pre", "post", "np", "w"]).drop("edge_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell once."""
    rows = table(spark, sf_dir, "neurons").where("root_id IS NOT NULL").dropDuplicates()
    return rows.select(
        F.col("root_id").alias("id"), "flow", "super_class", "cell_class", "cell_sub_class", "cell_type", "supertype", "hemibrain_type", "side", "top_nt", "known_nt", "synonyms",
        "pos_x", "pos_y", "pos_z", "soma_x", "soma_y", "soma_z", "annotated_at",
        label(F.col("cell_type"), F.col("cell_class"), F.col("super_class")).alias("label"),
        sign_by_prefix(F.col("top_nt")).alias("sign_a"), sign_by_names(F.col("known_nt"), F.col("top_nt")).alias("sign_b"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trial once; NaN is null."""
    rows = table(spark, sf_dir, "trials").drop("loaded_at").dropDuplicates(["trial_id"])
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in rows.dtypes if k == "double"})


SQL_EDGES = """
    edges AS (SELECT pre, post, np, w FROM (SELECT DISTINCT edge_id, pre_pt_root_id AS pre, post_pt_root_id AS post, neuropil AS np, CAST(syn_count AS BIGINT) AS w
              FROM connections WHERE pre_pt_root_id IS NOT NULL AND post_pt_root_id IS NOT NULL AND syn_count IS NOT NULL))"""

SQL_NODES = """
    cells AS (SELECT DISTINCT * FROM neurons WHERE root_id IS NOT NULL),
    nts AS (SELECT root_id AS rid, known_nt AS kn, top_nt AS tn,
        list_filter(list_transform(string_split_regex(coalesce(known_nt, ''), '[;,]'), lambda t: lower(trim(t))), lambda t: t <> '' AND NOT contains(t, 'negative')) AS k,
        list_filter(list_transform(string_split_regex(coalesce(top_nt, ''), '[;,]'), lambda t: lower(trim(t))), lambda t: t <> '' AND NOT contains(t, 'negative')) AS p FROM cells),
    effect AS (SELECT rid,
        list_has_any(k, ['acetylcholine','dopamine','serotonin','octopamine','ach','da','5ht','5-ht','oct','ser']) AS kp, list_has_any(k, ['gaba','glutamate','glu']) AS km,
        list_has_any(p, ['acetylcholine','dopamine','serotonin','octopamine','ach','da','5ht','5-ht','oct','ser']) AS pp, list_has_any(p, ['gaba','glutamate','glu']) AS pm FROM nts),
    signs AS (SELECT rid, CASE WHEN kp AND NOT km THEN 1 WHEN km AND NOT kp THEN -1 WHEN pp AND NOT pm THEN 1 WHEN pm AND NOT pp THEN -1 END AS sign_b FROM effect),
    nodes AS (SELECT root_id AS id, flow, super_class, cell_class, cell_sub_class, cell_type, supertype, hemibrain_type, side, top_nt, known_nt, synonyms,
        pos_x, pos_y, pos_z, soma_x, soma_y, soma_z, annotated_at,
        coalesce(nullif(trim(cell_type), ''), nullif(trim(cell_class), ''), nullif(trim(super_class), ''), '?') AS label,
        CASE WHEN coalesce(starts_with(upper(top_nt), 'GABA') OR starts_with(upper(top_nt), 'GLU'), false) THEN -1 ELSE 1 END AS sign_a, sign_b
        FROM cells JOIN signs ON root_id = rid)"""

SQL_TRIALS = """
    runs AS (SELECT trial_id, arm, seed, task, k, h, CASE WHEN NOT isnan(acc) THEN acc END AS acc, CASE WHEN NOT isnan(val) THEN val END AS val,
        CASE WHEN NOT isnan(lam) THEN lam END AS lam, n_classes, reachable, CASE WHEN NOT isnan(chance) THEN chance END AS chance,
        CASE WHEN NOT isnan(sat) THEN sat END AS sat, CASE WHEN NOT isnan(activity) THEN activity END AS activity, target,
        CASE WHEN NOT isnan(tol) THEN tol END AS tol, run_at
        FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY loaded_at) AS rn FROM trials) WHERE rn = 1)"""


def sql(*views: str) -> str:
    """The WITH clause of the views."""
    return "WITH " + ",".join(views)
