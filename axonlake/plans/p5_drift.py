"""Problem 5: run files whose fields drift, in one typed table with a list of all changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axonlake.operators import drifting_schema as ds
from axonlake.operators.drifting_schema import Field
from axonlake.sources.tables import table

KEEP = ["file_id", "campaign", "file_no"]
SCHEMA = [Field.of(n, k) for n, k in [("arm", "string"), ("seed", "int"), ("task", "string"), ("k", "int"), ("h", "int"), ("acc", "double"), ("val", "double"), ("lam", "double")]]
#: Approved later: class counts and targets also written as "25 cls" and "s=9", tolerances also as a percentage.
PROMOTED = [
    Field("n_classes", "int", r"cast(try_cast(regexp_extract(raw, '^([+-]?[0-9.eE+-]+)( *cls)?$', 1) AS DOUBLE) AS INT)"),
    Field("target", "int", r"cast(try_cast(regexp_extract(raw, '^(s=)?([+-]?[0-9.eE+-]+)$', 2) AS DOUBLE) AS INT)"),
    Field("tol", "double", r"CASE WHEN endswith(raw, '%') THEN try_cast(rtrim('%', raw) AS DOUBLE) / 100 ELSE try_cast(raw AS DOUBLE) END"),
]


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.ingest(table(spark, sf_dir, "run_files"), KEEP, table(spark, sf_dir, "field_names"), SCHEMA)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.changes(ingested(spark, sf_dir), KEEP, "campaign", "file_no").select("file_id", "field", "change")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in one table; the promoted fields are replayed out of the rescued values."""
    return ds.promote(ingested(spark, sf_dir).where("line_no > 0").drop("_seen", "_kinds"), PROMOTED)


QUERIES = {"p5_found": p5_found, "p5_table": p5_table}

_CELLS = """
    WITH names AS (SELECT lower(trim(seen_as)) AS s, field AS f FROM field_names),
    bodies AS (SELECT file_id, campaign, file_no, string_split_regex(coalesce(body, ''), '\\r\\n|\\n|\\r') AS l FROM run_files),
    headed AS (SELECT *, list_transform(string_split(l[1], ','), lambda x: lower(regexp_replace(x, '^[\\s"\\x{FEFF}]+|[\\s"\\x{FEFF}]+$', '', 'g'))) AS h FROM bodies),
    heads AS (SELECT file_id, campaign, file_no, unnest(h) AS seen, generate_subscripts(h, 1) AS i FROM headed WHERE array_to_string(h, '') <> ''),
    fields_ AS (SELECT file_id, campaign, file_no, i, seen, coalesce(f, seen) AS field FROM heads LEFT JOIN names ON s = seen),
    lines_ AS (SELECT file_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM headed),
    split_ AS (SELECT file_id, n, string_split(line, ',') AS v FROM lines_ WHERE n > 1 AND trim(line) <> ''),
    values_ AS (SELECT file_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM split_),
    cells AS (SELECT c.file_id, n, field, regexp_replace(x, '^[\\s"\\x{FEFF}]+|[\\s"\\x{FEFF}]+$', '', 'g') AS raw
              FROM values_ c JOIN fields_ f ON c.file_id = f.file_id AND c.i = f.i),
    known AS (SELECT * FROM cells WHERE lower(raw) NOT IN ('', 'na', 'nan', 'null', 'none'))"""

# the typed columns and how SQL casts them; a field that doesn't cast stays in the JSON object of rescued values
_TYPED = {**{f.name: f"try_cast(@ AS {f.kind})" for f in SCHEMA if f.kind != "string"}, "arm": "@", "task": "@",
          "n_classes": r"CAST(try_cast(regexp_extract(@, '^([+-]?[0-9.eE+-]+)( *cls)?$', 1) AS DOUBLE) AS INT)", "target": r"CAST(try_cast(regexp_extract(@, '^(s=)?([+-]?[0-9.eE+-]+)$', 2) AS DOUBLE) AS INT)",
          "tol": "CASE WHEN suffix(@, '%') THEN try_cast(rtrim(@, '%') AS DOUBLE) / 100 ELSE try_cast(@ AS DOUBLE) END"}
_TABLE = """,
    firsts AS (SELECT file_id, field, min(i) AS i FROM fields_ GROUP BY ALL),
    wide AS (SELECT c.file_id, n, coalesce(f.field, 'column_' || c.i) AS field, regexp_replace(x, '^[\\s"\\x{FEFF}]+|[\\s"\\x{FEFF}]+$', '', 'g') AS raw
             FROM values_ c LEFT JOIN fields_ f ON c.file_id = f.file_id AND c.i = f.i
             WHERE f.field IS NULL OR (c.file_id, f.field, c.i) IN (SELECT file_id, field, i FROM firsts)),
    told AS (SELECT * FROM wide WHERE lower(trim(raw)) NOT IN ('', 'na', 'nan', 'null', 'none')),
    cast_ AS (SELECT file_id, n, field, raw, CASE """ + " ".join(f"WHEN field = '{k}' THEN CAST({v.replace('@', 'trim(raw)')} AS VARCHAR)" for k, v in _TYPED.items()) + """ END AS v FROM told)"""
SQL = {
    "p5_table": _CELLS + _TABLE + """
    SELECT l.file_id, b.campaign, b.file_no, CAST(l.n - 1 AS INT) AS line_no, """
    + ", ".join(f"CAST(max(c.v) FILTER (c.field = '{f.name}') AS {'VARCHAR' if f.kind == 'string' else f.kind}) AS {f.name}" for f in [*SCHEMA, *PROMOTED])
    + """, '{' || nullif(string_agg('"' || c.field || '":"' || replace(replace(c.raw, '\\', '\\\\'), '"', '\\"') || '"', ',' ORDER BY c.field) FILTER (c.v IS NULL AND c.field IS NOT NULL), '') || '}' AS _rescued
    FROM split_ l JOIN bodies b ON l.file_id = b.file_id LEFT JOIN cast_ c ON l.file_id = c.file_id AND l.n = c.n GROUP BY ALL""",
    "p5_found": _CELLS + """,
    kinds AS (SELECT file_id, field, CASE WHEN bool_and(regexp_full_match(raw, '[+-]?[0-9]+')) THEN 'int'
                     WHEN bool_and(regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'float' ELSE 'text' END AS kind
              FROM known GROUP BY ALL),
    types AS (SELECT f.*, kind FROM fields_ f LEFT JOIN kinds k ON f.file_id = k.file_id AND f.field = k.field),
    files AS (SELECT file_id, lag(file_id) OVER (PARTITION BY campaign ORDER BY file_no, file_id) AS before FROM run_files),
    cur AS (SELECT s.file_id, t.field, t.seen FROM files s JOIN types t ON t.file_id = s.file_id WHERE before IS NOT NULL),
    prev AS (SELECT s.file_id, t.field, t.seen FROM files s JOIN types t ON t.file_id = s.before),
    named AS (SELECT file_id, field, CASE WHEN p.seen IS NULL THEN 'added' WHEN c.seen IS NULL THEN 'removed' WHEN c.seen <> p.seen THEN 'renamed' END AS change
              FROM cur c FULL JOIN prev p USING (file_id, field)),
    typed AS (SELECT file_id, field, kind, lag(kind) OVER (PARTITION BY campaign, field ORDER BY file_no, file_id) AS was FROM types WHERE kind IS NOT NULL)
    SELECT file_id, field, change FROM named WHERE change IS NOT NULL
    UNION ALL SELECT file_id, field, 'retyped' FROM typed WHERE kind <> was""",
}
