"""Which values are missing, in whatever guise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that say no value is known, in lower case, with one blank in place of each run of marks.
NOT_KNOWN = [
    "unknown", "unk", "unkn", "not known", "unknown type", "type unknown", "no type", "no cell type", "none", "null", "nil", "na", "n a", "nan", "nd", "n d", "nk", "n k",
    "not typed", "untyped", "not yet typed", "to be typed", "tbd", "tba", "to be determined", "to be assigned", "to be defined", "to be done", "to be named", "todo",
    "undetermined", "not determined", "unclassified", "not classified", "unassigned", "not assigned", "unidentified", "not identified", "unspecified", "not specified",
    "undefined", "not defined", "unlabelled", "unlabeled", "not labelled", "not labeled", "no label", "unannotated", "not annotated", "unnamed", "not named",
    "not available", "unavailable", "not applicable", "missing", "empty", "blank", "pending", "x", "xx", "xxx", "other", "void",
]


def says_nothing(text: Column) -> Column:
    """Null, blank, made of marks only, or one of NOT_KNOWN."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce((bare == "") | bare.isin(NOT_KNOWN), F.lit(True))


def outside(x: Column, low: float, high: float) -> Column:
    """Null, NaN, or not within low..high."""
    return F.coalesce(F.isnan(x) | (x < low) | (x > high), F.lit(True))
