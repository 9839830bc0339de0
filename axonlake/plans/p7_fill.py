"""Problem 7: positions and types of cells filled from cells alike or of the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions.absent import outside, says_nothing
from axonlake.operators.impute import fill_category, fill_numbers
from axonlake.sources.scratch import materialize
from axonlake.sources.tables import table

#: The imaged volume, in voxels.
LOW, HIGH = 20_000.0, 250_000.0
FIELDS = ["soma_x", "pos_x", "cell_type"]
#: What tells most about a cell's type: its lineage and the type of its counterpart.
ALIKE = ["hartenstein_hemilineage", "ito_lee_hemilineage", "hemibrain_type", "supertype"]


def known_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neurons without repeated rows and rows without root_id; missing values of FIELDS are null; `__month` and `__lineage` group cells."""
    cells = table(spark, sf_dir, "neurons").where("root_id IS NOT NULL").dropDuplicates()
    for x in ("soma_x", "pos_x"):
        cells = cells.withColumn(x, F.when(~outside(F.col(x), LOW, HIGH), F.col(x)))
    cells = cells.withColumn("cell_type", F.when(~says_nothing(F.col("cell_type")), F.trim("cell_type")))
    for a in ALIKE:
        cells = cells.withColumn(f"__{a}", F.when(~says_nothing(F.col(a)), F.lower(F.trim(a))))
    side = F.when(~says_nothing(F.col("side")), F.lower(F.trim("side")))
    return cells.withColumn("__month", F.date_format("annotated_at", "yyyy-MM")).withColumn("__side", side)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with FIELDS filled and a mark for each of them."""
    cells = materialize(known_cells(spark, sf_dir).withColumnsRenamed({x: f"__{x}" for x in FIELDS}), "cells").withColumnsRenamed({f"__{x}": x for x in FIELDS})
    cells = fill_category(cells, "cell_type", [f"__{a}" for a in ALIKE], "__month")
    return fill_numbers(cells, {"soma_x": "pos_x", "pos_x": "soma_x"}, ["__side", "__supertype", "__month"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in FIELDS])
    return filled(spark, sf_dir).select("root_id", F.explode(F.array_compact(marks)).alias("field")).distinct()


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filled(spark, sf_dir)
    return got.select([c for c in got.columns if not c.startswith("__")])


def p7_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well known values are filled again when a fifth of them, by a hash of the cell, is hidden: per field the hidden values, the error of the filling and that of the mean (coordinates: root mean square in voxels; types: share of wrong ones, against the most frequent type)."""
    cells = materialize(known_cells(spark, sf_dir), "known-cells")
    hidden = {f: (F.pmod(F.xxhash64(F.lit(f), "root_id"), F.lit(5)) == 0) & F.col(f).isNotNull() for f in FIELDS}
    truth = materialize(cells.select("root_id", *[F.when(hidden[f], F.col(f)).alias(f"__true_{f}") for f in FIELDS]).distinct(), "hidden-values")
    shown = materialize(cells.select(*[F.when(~F.coalesce(hidden[c], F.lit(False)), F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in cells.columns]), "shown-cells")
    got = fill_category(shown, "cell_type", [f"__{a}" for a in ALIKE], "__month")
    got = fill_numbers(got, {"soma_x": "pos_x", "pos_x": "soma_x"}, ["__side", "__supertype", "__month"]).select("root_id", *FIELDS)
    usual = shown.agg(*[F.avg(f).alias(f"__usual_{f}") for f in FIELDS[:2]], F.mode("cell_type", True).alias("__usual_cell_type"))  # one row
    both = truth.join(got, "root_id").crossJoin(F.broadcast(usual))
    off = lambda f, g: F.pow(F.col(f"__true_{f}") - F.col(g), 2) if f != "cell_type" else (F.col(f"__true_{f}") != F.col(g)).cast("double")
    root = lambda f, x: F.round(F.sqrt(F.avg(x)) if f != "cell_type" else F.avg(x), 6)
    rows = [both.where(F.col(f"__true_{f}").isNotNull()).agg(F.count(F.lit(1)).alias("n_hidden"), root(f, off(f, f)).alias("error"), root(f, off(f, f"__usual_{f}")).alias("error_of_mean")).select(F.lit(f).alias("field"), "*") for f in FIELDS]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


QUERIES = {"p7_heldout": p7_heldout, "p7_found": p7_found, "p7_filled": p7_filled}

_NOT_KNOWN = """
    'unknown', 'unk', 'unkn', 'not known', 'unknown type', 'type unknown', 'no type', 'no cell type', 'none', 'null', 'nil', 'na', 'n a', 'nan', 'nd', 'n d', 'nk', 'n k',
    'not typed', 'untyped', 'not yet typed', 'to be typed', 'tbd', 'tba', 'to be determined', 'to be assigned', 'to be defined', 'to be done', 'to be named', 'todo',
    'undetermined', 'not determined', 'unclassified', 'not classified', 'unassigned', 'not assigned', 'unidentified', 'not identified', 'unspecified', 'not specified',
    'undefined', 'not defined', 'unlabelled', 'unlabeled', 'not labelled', 'not labeled', 'no label', 'unannotated', 'not annotated', 'unnamed', 'not named',
    'not available', 'unavailable', 'not applicable', 'missing', 'empty', 'blank', 'pending', 'x', 'xx', 'xxx', 'other', 'void'"""

SQL = {
    "p7_found": f"""
        SELECT DISTINCT root_id, 'soma_x' AS field FROM neurons WHERE root_id IS NOT NULL AND (soma_x IS NULL OR isnan(soma_x) OR soma_x < 20000 OR soma_x > 250000)
        UNION ALL
        SELECT DISTINCT root_id, 'pos_x' FROM neurons WHERE root_id IS NOT NULL AND (pos_x IS NULL OR isnan(pos_x) OR pos_x < 20000 OR pos_x > 250000)
        UNION ALL
        SELECT DISTINCT root_id, 'cell_type' FROM neurons WHERE root_id IS NOT NULL AND (cell_type IS NULL
            OR trim(regexp_replace(lower(cell_type), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) IN ('', {_NOT_KNOWN}))""",
}
