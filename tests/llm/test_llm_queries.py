import pytest

from axonlake.llm import queries as q
from tests.sql_check import assert_same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, small, name):
    assert_same(spark, small, q.QUERIES[name], q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, small, name):
    assert q.QUERIES[name](spark, small).count() > 0


def test_containers_of_the_tables_are_full(spark):
    rows = q.QUERIES["p9_fill"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["tokens"] for r in rows) > 0.97 * 2048 * sum(r["containers"] for r in rows)
