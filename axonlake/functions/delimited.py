"""Comma-separated text in a string column, taken apart with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A comma that is not inside double quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_LINE_END = "\r\n|\n|\r"
_EDGES = ' \t\n\x0b\f\r"\ufeff'


def lines(body: Column) -> Column:
    """The lines of a text, also the empty ones; null for a null text."""
    return F.split(body, _LINE_END)


def cleaned(x: Column) -> Column:
    """Without byte order mark, quotes and outer blanks."""
    return F.btrim(x, F.lit(_EDGES))


def fields(line: Column) -> Column:
    """The cleaned fields of a line. A line without quotes is split the cheap way."""
    raw = F.when(line.contains('"'), F.split(line, _COMMA, -1)).otherwise(F.split(line, ",", -1))
    return F.transform(raw, cleaned)


def header(body: Column) -> Column:
    """The cleaned lower-case names of the first line."""
    return F.transform(fields(F.get(lines(body), F.lit(0))), F.lower)
