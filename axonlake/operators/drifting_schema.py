"""Files whose fields come, go, change name or type, read into one table, with a list of all changes.

Ingestion enforces a target schema: the values of known fields that cast go to typed columns; everything else, unknown fields and values
that don't cast, is kept as text in `_rescued`, a JSON object per record, so nothing is lost. Fields approved later are promoted:
their values are replayed out of `_rescued` into new typed columns, and what still doesn't cast stays there. A cast forgets how a value
was written, so ingestion notes the kind of each value (`_kinds`) beside it, and the names of each file's header (`_seen`) in one row of
the file, line 0. The ingested table is stored once; table, types and changes are all read from it.

Changes are found per series of files against the file before: fields added, removed, renamed, and retyped against the latest earlier
file in which the field had a type.

Defined cases: null and empty bodies are files without fields; header names compare without quotes, outer blanks, byte order marks and
case; names listed as spellings of a field count as that field; of two names of one field in a header the first counts; a short line
lacks its last fields, and surplus values of a long line are rescued under their position; values in the guise of missing ones are null;
two files with one number keep the order of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.functions.delimited import fields, header, lines
from axonlake.operators.carry import carry_last
from axonlake.sources.scratch import materialize

MISSING = ["", "na", "nan", "null", "none"]
_INT = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Spellings that `spellings` may hold; it's sent to all tasks.
MAX_SPELLINGS = 100_000


def is_missing(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(MISSING), F.lit(True))


@dataclass(frozen=True)
class Field:
    """A typed column and the SQL expression over `raw` (cleaned text, not missing) that casts it, null where it can't."""

    name: str
    kind: str
    cast: str

    @staticmethod
    def of(name: str, kind: str) -> Field:
        return Field(name, kind, f"try_cast(raw AS {kind})")


def parsed(files: DataFrame, keep: list[str], spellings: DataFrame) -> DataFrame:
    """One row per file: keep, `seen` and `canon` (the names in the header, as seen and canonical, in order) and `__ax_lines`."""
    known = spellings.select(F.lower(F.trim("seen_as")).alias("s"), F.col("field").alias("f")).distinct()
    if known.count() > MAX_SPELLINGS:
        raise ValueError(f"more than {MAX_SPELLINGS} spellings of fields")
    names = known.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("s", "f"))).alias("names"))  # one row of bounded size
    heads = files.select(*keep, F.coalesce(header(F.col("body")), F.array()).alias("seen"), F.coalesce(lines(F.col("body")), F.array()).alias("__ax_lines"))
    heads = heads.withColumn("seen", F.when(F.concat_ws("", "seen") == "", F.array().cast("array<string>")).otherwise(F.col("seen")))
    joined = heads.crossJoin(F.broadcast(names))
    return joined.withColumn("canon", F.transform("seen", lambda s: F.coalesce(F.try_element_at("names", s), s))).drop("names")


def records(heads: DataFrame, keep: list[str]) -> DataFrame:
    """One row per line after the header that isn't blank: keep, `line_no` and `cells`, a map from canonical name to cleaned text; and line 0 of each file, without cells, with `_seen`, a map from canonical to seen name."""
    first = F.filter(F.sequence(F.lit(1), F.size("canon")), lambda i: (i <= F.size("canon")) & (F.array_position("canon", F.element_at("canon", i)) == i))
    seen = F.map_from_entries(F.transform(first, lambda i: F.struct(F.element_at("canon", i), F.element_at("seen", i))))
    seen = F.when(F.size("canon") > 0, seen).otherwise(F.create_map().cast("map<string,string>"))
    body = F.transform(F.when(F.size("__ax_lines") > 1, F.slice("__ax_lines", 2, F.size("__ax_lines"))).otherwise(F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    body = F.concat(F.array(F.struct(F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("line"))), F.filter(body, lambda x: F.trim(x["line"]) != ""))
    rows = heads.select(*keep, "canon", seen.alias("__ax_seen"), F.explode(body).alias("l"))
    rows = rows.select(*keep, "canon", "l.line_no", F.coalesce(fields(F.col("l.line")), F.array()).alias("v"), F.when(F.col("l.line_no") == 0, F.col("__ax_seen")).alias("_seen"))
    pairs = F.transform("v", lambda x, i: F.struct(F.coalesce(F.get("canon", i), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("k"), x.alias("v"), i.alias("i")))
    once = F.filter(pairs, lambda p: F.coalesce(F.array_position("canon", p["k"]) == p["i"] + 1, F.lit(True)) | (p["i"] >= F.size("canon")))
    cells = F.map_from_entries(F.transform(once, lambda p: F.struct(p["k"], p["v"])))
    return rows.select(*keep, "line_no", "_seen", cells.alias("cells"))


def enforce(rows: DataFrame, schema: list[Field], keep: list[str]) -> DataFrame:
    """keep, line_no, `_seen`, `_kinds` (per field with a value: 1 a row of digits, 2 another number, 3 text), the typed columns of schema, and `_rescued`: a JSON object of the values that have no typed column or didn't cast; null if there are none."""
    told = F.map_filter("cells", lambda k, v: ~is_missing(v))
    kinds = F.transform_values(told, lambda k, v: F.when(F.trim(v).rlike(_INT), 1).when(F.trim(v).rlike(_NUMBER), 2).otherwise(3))
    stage = rows.select(*keep, "line_no", "_seen", F.col("cells").alias("__ax_rest"), kinds.alias("_kinds"))
    return _replay(stage, schema, [*keep, "line_no", "_seen", "_kinds"])


def ingest(files: DataFrame, keep: list[str], spellings: DataFrame, schema: list[Field]) -> DataFrame:
    """The stored table of all files, by enforce."""
    return materialize(enforce(records(parsed(files, keep, spellings), keep), schema, keep), "ingested")


def promote(table: DataFrame, schema: list[Field]) -> DataFrame:
    """table with the columns of schema, filled from `_rescued`, which loses what was cast."""
    keep = [c for c in table.columns if c != "_rescued"]
    rest = table.select(*keep, F.coalesce(F.from_json("_rescued", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("__ax_rest"))
    return _replay(rest, schema, keep)


def _replay(rows: DataFrame, schema: list[Field], keep: list[str]) -> DataFrame:
    for f in schema:
        raw = F.try_element_at("__ax_rest", F.lit(f.name))
        rows = rows.withColumn("raw", F.when(~is_missing(raw), F.trim(raw))).withColumn(f.name, F.expr(f.cast).cast(f.kind)).drop("raw")
    done = F.create_map(*[x for f in schema for x in (F.lit(f.name), F.col(f.name).isNotNull())]) if schema else F.create_map().cast("map<string,boolean>")
    left = F.map_filter("__ax_rest", lambda k, v: ~F.coalesce(F.try_element_at(done, k), F.lit(False)) & ~is_missing(v))
    left = F.map_from_entries(F.array_sort(F.map_entries(left)))
    return rows.withColumn("__ax_left", left).select(*keep, *[f.name for f in schema], F.when(F.size("__ax_left") > 0, F.to_json("__ax_left")).alias("_rescued"))


def field_types(ingested: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (file, field with a value): keep, field and `kind` (int, float or text), the widest of its values."""
    kinds = ingested.where(F.size("_kinds") > 0).select(*keep, F.explode("_kinds").alias("field", "k")).groupBy(*keep, "field").agg(F.max("k").alias("k"))
    return kinds.select(*keep, "field", F.element_at(F.array(*[F.lit(x) for x in ("int", "float", "text")]), F.col("k")).alias("kind"))


def changes(ingested: DataFrame, keep: list[str], series: str, number: str) -> DataFrame:
    """(file_id, field, change, was, now) of every file against the one before it in its series."""
    files = ingested.where("line_no = 0").select("file_id", series, number, F.col("_seen").alias("now"))
    files = carry_last(files, [series], number, ["file_id"], F.col("now"), "was").where("was IS NOT NULL")
    now, was = (F.try_element_at(c, F.col("field")) for c in ("now", "was"))
    fields_ = files.select("file_id", "was", "now", F.explode(F.array_union(F.map_keys("now"), F.map_keys("was"))).alias("field")).select("file_id", "field", was.alias("was"), now.alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "renamed")
    named = fields_.select("file_id", "field", kind.alias("change"), "was", "now").where("change IS NOT NULL")
    typed = carry_last(materialize(field_types(ingested, keep), "field-types"), [series, "field"], number, ["file_id"], F.col("kind"), "was")
    retyped = typed.where("kind != was").select("file_id", "field", F.lit("retyped").alias("change"), "was", F.col("kind").alias("now"))
    return named.unionByName(retyped)
