"""Problem 4: the result records of very many tiny files, each exactly once, in few well-sized files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions.delimited import fields, header, lines
from axonlake.operators.sorted_runs import Consolidated, Store
from axonlake.sources.tables import table

COLUMNS = ["arm", "seed", "task", "cond", "value"]
#: Bytes of record keys in an output file. The files of this project are tiny; a large store takes 256 MB or more.
TARGET_BYTES = 4 << 20
_SEP = "\x01"


def record_lines(files: DataFrame) -> DataFrame:
    """(file_id, arm, seed, task, cond, value) of every line with at least five fields, all as cleaned text, value in the spelling of its number. A value that is no number stays text; a body without the five header names has no records."""
    bodies = files.select("file_id", header(F.col("body")).alias("__ax_header"), lines(F.col("body")).alias("__ax_lines"))
    rows = bodies.select("file_id", "__ax_header", F.posexplode("__ax_lines").alias("__ax_line_no", "__ax_line")).where("__ax_line_no > 0")
    rows = rows.select("file_id", "__ax_header", fields(F.col("__ax_line")).alias("__ax_fields")).where(F.size("__ax_fields") >= len(COLUMNS))
    at = lambda c: F.get("__ax_fields", F.array_position("__ax_header", c).cast("int") - 1)
    rows = rows.select("file_id", *[at(c).alias(c) for c in COLUMNS]).where(" AND ".join(f"{c} IS NOT NULL" for c in COLUMNS))
    number = F.expr("try_cast(value AS DOUBLE)") + F.lit(0.0)
    return rows.withColumn("value", F.coalesce(number.cast("string"), F.col("value")))


def consolidated(spark: SparkSession, sf_dir: str, target_bytes: int = TARGET_BYTES, path: str | None = None) -> Consolidated:
    """The records of shards merged into the store at path; without a path, into one that ends with the session."""
    records = record_lines(table(spark, sf_dir, "shards"))
    return Store(spark, path).deliver(records.select(F.concat_ws(_SEP, *COLUMNS).alias("key"), "file_id"), target_bytes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    adding = consolidated(spark, sf_dir).firsts().select("file_id").distinct()
    return table(spark, sf_dir, "shards").select("file_id").join(adding, "file_id", "left_anti")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated records, each once, with the first file that held it."""
    parts = F.split("key", _SEP)
    got = consolidated(spark, sf_dir).firsts().select(*[parts[i].alias(c) for i, c in enumerate(COLUMNS)], F.col("file_id").alias("first_file_id"))
    return got.withColumn("value", F.expr("try_cast(value AS DOUBLE)"))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of the consolidated files."""
    files = consolidated(spark, sf_dir).files
    return files.select("range_id", "part_no", F.translate("first_key", _SEP, ",").alias("first_key"), F.translate("last_key", _SEP, ",").alias("last_key"), "n_records", "n_copies", "n_bytes")


def p4_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metadata of the consolidated files adds up to."""
    files = consolidated(spark, sf_dir).files
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_records", "n_copies")]
    return files.agg(*sums, F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.coalesce(F.max("n_bytes") < 2 * TARGET_BYTES, F.lit(True)).alias("within_target")).select(
        "n_records", "n_copies", F.split("first_key", _SEP)[0].alias("first_arm"), F.split("last_key", _SEP)[0].alias("last_arm"), "within_target"
    )


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_files": p4_files, "p4_sums": p4_sums}

_RECORDS = """
    WITH bodies AS (SELECT file_id, string_split_regex(body, '\\r\\n|\\n|\\r') AS l FROM shards WHERE body IS NOT NULL),
    headed AS (SELECT file_id, l, list_transform(string_split(l[1], ','), lambda x: lower(regexp_replace(x, '^[\\s"\\x{FEFF}]+|[\\s"\\x{FEFF}]+$', '', 'g'))) AS h FROM bodies),
    rows_ AS (SELECT file_id, h, unnest(l[2:]) AS line FROM headed),
    cells AS (SELECT file_id, h, list_transform(string_split(line, ','), lambda x: regexp_replace(x, '^[\\s"\\x{FEFF}]+|[\\s"\\x{FEFF}]+$', '', 'g')) AS f FROM rows_),
    records AS (SELECT file_id, f[list_position(h, 'arm')] AS arm, f[list_position(h, 'seed')] AS seed, f[list_position(h, 'task')] AS task,
                       f[list_position(h, 'cond')] AS cond, try_cast(f[list_position(h, 'value')] AS DOUBLE) AS value
                FROM cells WHERE len(f) >= 5 AND list_position(h, 'value') > 0),
    firsts AS (SELECT arm, seed, task, cond, value, min(file_id) AS first_file_id FROM records GROUP BY ALL)"""

SQL = {
    "p4_found": _RECORDS + " SELECT file_id FROM shards WHERE file_id NOT IN (SELECT first_file_id FROM firsts)",
    "p4_records": _RECORDS + " SELECT arm, seed, task, cond, value, first_file_id FROM firsts",
    "p4_sums": _RECORDS + """ SELECT (SELECT count(*) FROM firsts) AS n_records, count(*) AS n_copies, min(arm) AS first_arm, max(arm) AS last_arm, true AS within_target FROM records""",
}
