"""Problem 6: transmitter fields with several names, one row per name with its position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators.segmentation import segment
from axonlake.sources.scratch import materialize
from axonlake.sources.tables import table

FIELDS = ["known_nt", "top_nt"]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, field, pos, value) of every field that holds a value, repeated rows once."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("c")
    rows = table(spark, sf_dir, "neurons").where("root_id IS NOT NULL").select("root_id", cells).select("root_id", "c.field", "c.text")
    rows = rows.where("text IS NOT NULL").distinct()
    values = materialize(segment(rows, "text"), "segments")
    return rows.join(values, "text").select("root_id", "field", "pos", "value", F.col("text").alias("whole"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = names(spark, sf_dir)
    several = got.where("pos = 2").select("root_id", "field", "whole")
    return got.join(several, ["root_id", "field", "whole"], "left_semi").select("root_id", "field", F.col("pos").cast("int").alias("pos"), "value")


def p6_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name is given, in any spelling of case, alone or among others."""
    return names(spark, sf_dir).groupBy("field", F.lower("value").alias("name")).agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("root_id").alias("n_cells"))


QUERIES = {"p6_found": p6_found, "p6_name_counts": p6_name_counts}

# names are letters, digits, blanks, hyphens, round brackets; quoted spans are put aside before the cut
_VALUES = r"""
    WITH texts AS (SELECT DISTINCT root_id, 'known_nt' AS field, known_nt AS t FROM neurons WHERE root_id IS NOT NULL AND known_nt IS NOT NULL
                   UNION SELECT DISTINCT root_id, 'top_nt', top_nt FROM neurons WHERE root_id IS NOT NULL AND top_nt IS NOT NULL),
    bare AS (SELECT root_id, field, t, regexp_replace(regexp_replace(t, '^\s*[\[{]', ''), '[\]}]\s*$', '') AS b FROM texts),
    pieces AS (SELECT root_id, field, t, regexp_extract_all(b, '("[^"]*"|''[^'']*''|[A-Za-z0-9 ()-])+') AS p FROM bare),
    cut AS (SELECT root_id, field, t, list_filter(list_transform(p, lambda x: trim(regexp_replace(trim(x), '^["''](.*)["'']$', '\1'))), lambda x: x <> '') AS v FROM pieces)"""

SQL = {
    "p6_found": _VALUES + " SELECT root_id, field, CAST(generate_subscripts(v, 1) AS INTEGER) AS pos, unnest(v) AS value FROM cut WHERE len(v) >= 2",
    "p6_name_counts": _VALUES + """, each AS (SELECT root_id, field, unnest(v) AS value FROM cut)
        SELECT field, lower(value) AS name, count(*) AS n_values, count(DISTINCT root_id) AS n_cells FROM each GROUP BY ALL""",
}
