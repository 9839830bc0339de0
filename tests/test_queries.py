"""Every query that SQL can express equals its SQL on the smallest tables; the others run and keep their columns."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.sql_check import assert_same

MODULES = [importlib.import_module(m) for m in entry.MODULES]
WITH_SQL = sorted(n for m in MODULES for n in m.SQL)
WITHOUT = sorted(n for m in MODULES for n in m.QUERIES if n not in m.SQL)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, small, name):
    assert_same(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["neuropil", "n_rows", "syn_total", "largest_syn"] and df.count() > 0


def test_every_problem_has_a_query():
    names = QUERIES.keys()
    for n in (1, 4, 5, 6, 7):
        assert f"p{n}_found" in names
