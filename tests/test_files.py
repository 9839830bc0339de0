import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from axonlake.operators import drifting_schema as ds
from axonlake.operators.carry import carry_last
from axonlake.operators.sorted_runs import Store, consolidate, merge_runs, stretch
from axonlake.plans.p4_small_files import record_lines


def test_merge_of_sorted_runs(tmp_path):
    rng = random.Random(1)
    runs = [sorted((rng.choice("abcdefg") * rng.randint(1, 3), rng.randint(0, 9), 1) for _ in range(rng.randint(0, 40))) for _ in range(9)]
    assert list(merge_runs([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    paths = []
    for i, r in enumerate(runs):
        pq.write_table(pa.table({"key": pa.array([x[0] for x in r], pa.string()), "file_id": pa.array([x[1] for x in r], pa.int64()), "n_bytes": pa.array([1] * len(r), pa.int32())}), tmp_path / f"{i}.parquet", row_group_size=7)
        paths.append(f"file://{tmp_path}/{i}.parquet")
    for low, high in ((None, None), (("b", 3), ("dd", 5)), (("c", 0), None), (None, ("a", 4)), (("b", 3), ("b", 3))):
        want = sorted(x for r in runs for x in r if (low is None or x[:2] >= low) and (high is None or x[:2] < high))
        for block in (1, 3, 4096):
            assert list(merge_runs([stretch(p, low, high, block) for p in paths])) == want


def hot_records(spark, seed, n=2000):
    rng = random.Random(seed)
    data = [(rng.choice(["hot"] * 5 + [f"k{i}" for i in range(40)]), seed * 1000 + i % 50) for i in range(n)]
    return data, spark.createDataFrame(data, "key string, file_id long").repartition(6)


def firsts(data):
    first = {}
    for k, f in data:
        first[k] = min(f, first.get(k, f))
    return first


def test_consolidation_keeps_every_record_once(spark, monkeypatch):
    data, df = hot_records(spark, 2)
    monkeypatch.setattr("axonlake.operators.sorted_runs.INDEX_ROWS", 16)
    for target, fan_in in ((40, 256), (300, 4), (10**6, 2)):  # the hot key lies in many ranges at first; runs are merged in several passes at last
        c = consolidate(df, target, fan_in=fan_in)
        assert c.merged.count() == 2000
        assert {r["key"]: r["file_id"] for r in c.firsts().collect()} == firsts(data) and c.firsts().count() == len(firsts(data))
        files = c.files.collect()
        assert sum(r["n_copies"] for r in files) == 2000 and sum(r["n_records"] for r in files) == len(firsts(data))
        assert all(r["n_bytes"] <= target + 4 for r in files)


def test_a_second_delivery(spark, tmp_path):
    (a, first), (b, second) = hot_records(spark, 3), hot_records(spark, 4)
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.latest() is None
    store.deliver(second, 300)
    (tmp_path / "store/v2/data").mkdir(parents=True)  # of a job that died
    assert store.latest() == 1
    store.deliver(first, 300)
    got = Store(spark, f"file://{tmp_path}/store").read()
    assert store.latest() == 3 and got.merged.count() == len(a) + len(b)
    assert {r["key"]: r["file_id"] for r in got.firsts().collect()} == firsts(a + b) and got.firsts().count() == len(firsts(a + b))
    files = got.files.collect()
    assert sum(r["n_copies"] for r in files) == len(a) + len(b) and sum(r["n_records"] for r in files) == len(firsts(a + b)) and all(r["n_bytes"] <= 304 for r in files)
    store.deliver(first.limit(0), 300)
    assert store.read().merged.count() == len(a) + len(b) and store._complete() == [3, 4]


def test_consolidation_of_nothing(spark):
    c = consolidate(spark.createDataFrame([], "key string, file_id long"), 100)
    assert c.firsts().count() == 0 and c.files.count() == 0


def test_record_lines(spark):
    bodies = [
        (1, "arm,seed,task,cond,value\na,1,T,c,0.50\n\na,1\n"), (2, '﻿value,cond,task,seed,arm\r\n"5e-1"," c ","T","1","a"\r\n'), (3, ""), (4, None), (5, "arm,seed\nx,1,2,3,4\n"),
        (6, 'arm,seed,task,cond,value\n"a,b",1,T,c,none\n'),
    ]
    got = {tuple(r) for r in record_lines(spark.createDataFrame(bodies, "file_id long, body string")).collect()}
    assert got == {(1, "a", "1", "T", "c", "0.5"), (2, "a", "1", "T", "c", "0.5"), (6, "a,b", "1", "T", "c", "none")}


def test_carry_last(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", None, "x"]), i, 0, rng.choice([None, None, i])) for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(data, "k string, at int, tie int, v int")
    want, last = {}, {}
    for k, at, _, v in sorted(data, key=lambda r: r[1]):
        want[(k, at)] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    for block in (1, 16, 10**6):
        assert {(r["k"], r["at"]): r["before"] for r in carry_last(df, ["k"], "at", ["tie"], F.col("v"), "before", block).collect()} == want


KEEP = ["file_id", "campaign", "file_no"]
FILES = [
    (1, 1, 1, "arm,acc,n_cls\na,0.5,3\n"), (2, 1, 2, '"ARM" ,acc,classes,note\nb,nan,25 cls,"x,y"\n'), (3, 1, 3, "arm,acc,n_classes\nc,1,4\n"), (4, 1, 4, None),
    (5, 1, 5, "arm,acc\nd,oops\ne\nf,2,extra\n"), (6, 2, 1, ""), (7, 2, 2, "arm\n"),
]


def ingested(spark, schema=()):
    names = spark.createDataFrame([("n_classes", "n_classes"), ("n_classes", "n_cls"), ("n_classes", "classes")], "field string, seen_as string")
    return ds.ingest(spark.createDataFrame(FILES, "file_id long, campaign long, file_no int, body string"), KEEP, names, list(schema))


def test_changes(spark):
    got, typed = ({(r["file_id"], r["field"], r["change"]) for r in ds.changes(ingested(spark, s), KEEP, "campaign", "file_no").collect()} for s in ((), [ds.Field.of("acc", "double"), ds.Field.of("n_classes", "int")]))
    assert got == typed  # whatever the target schema casts, changes go by what was written
    assert got == {
        (2, "n_classes", "renamed"), (2, "n_classes", "retyped"), (2, "note", "added"), (3, "n_classes", "renamed"), (3, "n_classes", "retyped"), (3, "note", "removed"), (3, "acc", "retyped"),
        (4, "arm", "removed"), (4, "acc", "removed"), (4, "n_classes", "removed"), (5, "arm", "added"), (5, "acc", "added"), (5, "acc", "retyped"), (7, "arm", "added"),
    }


def test_rescue_and_replay(spark):
    t = ingested(spark, [ds.Field.of("arm", "string"), ds.Field.of("acc", "double")]).where("line_no > 0")
    got = {(r["file_id"], r["arm"]): r for r in t.collect()}
    assert got[(2, "b")]["acc"] is None and got[(2, "b")]["_rescued"] == '{"n_classes":"25 cls","note":"x,y"}'
    assert got[(5, "d")]["_rescued"] == '{"acc":"oops"}' and got[(5, "e")]["_rescued"] is None and got[(5, "f")]["_rescued"] == '{"column_3":"extra"}'
    p = ds.promote(t, [ds.Field.of("n_classes", "int")])
    got = {(r["file_id"], r["arm"]): r for r in p.collect()}
    assert got[(1, "a")]["n_classes"] == 3 and got[(1, "a")]["_rescued"] is None
    assert got[(2, "b")]["n_classes"] is None and "25 cls" in got[(2, "b")]["_rescued"]
    assert ds.promote(p, [ds.Field("classes_text", "string", "raw")]).count() == 6
