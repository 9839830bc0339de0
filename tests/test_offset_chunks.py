import random

import pytest
from pyspark.sql import functions as F

from axonlake.operators import offset_chunks as oc
from axonlake.operators.dense_ids import dense_ids
from axonlake.sources.scratch import materialize

SCHEMA = "k string, v int, __ax_key string, n long"


def rows(seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), rng.choice([None, 1, 2, 3]), "clash", 7) for _ in range(3000)]


def stored(spark, data):
    return materialize(spark.createDataFrame(data, SCHEMA).repartition(5), "test")


def test_numbers_are_gapless_and_keys_in_one_piece(spark):
    for limit in (0, 10_000):  # by shuffle, by broadcast
        got = oc.numbered(stored(spark, rows()), "k", {"v": F.col("v")}, limit).collect()
        assert sorted(r["__ax_no"] for r in got) == list(range(3000))
        spans = {}
        for r in got:
            spans.setdefault(r["__ax_key"], []).append(r["__ax_no"])
        assert all(max(s) - min(s) + 1 == len(s) for s in spans.values())


def test_states_equal_brute_force_for_any_chunk_size(spark):
    data = rows(2)
    df = stored(spark, data)
    states = [oc.counted("n_rows"), oc.counted("n_values", F.col("v")), oc.summed("total", F.col("v")), oc.smallest("lo", F.col("v")), oc.largest("hi", F.col("v")), oc.earliest("first", F.col("v")), oc.latest("last", F.col("v"))]
    want = {}
    for k, v, *_ in data:
        want.setdefault(k, []).append(v)
    for chunk in (1, 7, 1000, 10**6):
        got = {r["k"]: r for r in oc.per_key(df, "k", states, {"v": F.col("v")}, chunk).collect()}
        assert got.keys() == want.keys()
        for k, vs in want.items():
            known = [v for v in vs if v is not None]
            assert got[k]["n_rows"] == len(vs) and got[k]["n_values"] == len(known) and got[k]["total"] == (sum(known) if known else None)
            assert got[k]["lo"] == min(known, default=None) and got[k]["hi"] == max(known, default=None)


def test_chunks_are_equal(spark):
    df = stored(spark, rows(3))
    sizes = oc.chunk_states(df, "k", [oc.counted("n")], {}, 100).groupBy("__ax_chunk").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in sizes} == {100} and len(sizes) == 30


def test_empty(spark):
    df = materialize(spark.createDataFrame([], SCHEMA), "test")
    assert oc.per_key(df, "k", [oc.counted("n_rows")]).count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",)], "k string")
    assert sorted((r["dense"], r["k"]) for r in dense_ids(df, "k", 3).collect()) == [(0, None), (1, ""), (2, "a"), (3, "b")]
    assert dense_ids(spark.createDataFrame([], "k string"), "k").count() == 0


def test_a_changed_layout_raises(spark, tmp_path, monkeypatch):
    """Rows that the counts don't know are never lost in silence."""
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id % 3 AS k", "id AS v").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    counts = oc.partition_counts(df, "k")
    monkeypatch.setattr(oc, "partition_counts", lambda *_: counts.where("__ax_key < 2"))
    with pytest.raises(Exception, match="partitions changed"):
        oc.numbered(df, "k").collect()
    monkeypatch.setattr(oc, "partition_counts", lambda *_: counts.withColumn("n", F.col("n") - 1))
    with pytest.raises(Exception, match="partitions changed"):
        oc.numbered(df, "k").collect()
