import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from axonlake.functions.text import first_object, folded, keyed_hash, ngrams, tokens
from axonlake.operators import codes as C
from axonlake.operators import lexicon as X
from axonlake.operators import ordered as O
from axonlake.operators import stats as S
from axonlake.operators.controller import answered, computed, multiplied
from axonlake.sources import ingest
from axonlake.streaming import state as R

T0 = datetime.datetime(2024, 1, 1)


def history(n=800, seed=7):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2]), T0 + datetime.timedelta(minutes=rng.randrange(9000)), i, rng.choice([None, float("nan"), rng.uniform(-40, 40), rng.uniform(-40, 40)])) for i in range(n)]


def folded_value(rows, key):
    v = 60.0
    for _, _, _, d in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
        v = min(100.0, max(0.0, v + (0 if d is None or d != d else d)))
    return v


def test_clamped_fold_by_blocks_equals_one_fold(spark):
    rows = history()
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, i long, d double")
    for block in (F.to_date("ts"), F.date_trunc("hour", "ts"), F.lit(0)):
        got = {r["k"]: r["value"] for r in R.clamped_fold(df, "k", "ts", "i", F.col("d"), 60.0, block).collect()}
        assert got == {k: pytest.approx(folded_value(rows, k)) for k in (1, 2)}


def test_stream_equals_batch(spark, tmp_path):
    rows = history(200)
    for part in range(2):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "k long, ts timestamp, i long, delta double").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema("k long, ts timestamp, i long, delta double").parquet(str(tmp_path / "in" / "*"))
    out = R.drained(R.stream_vitals(stream, "k", "ts", "i", 60.0), "test-vitals").collect()
    for k in (1, 2):
        last = max((r for r in out if r["k"] == k), key=lambda r: r["n"])
        assert last["value"] == pytest.approx(folded_value(rows, k)) and last["n"] == sum(r[0] == k for r in rows)


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("a", T0), ("a", T0 + datetime.timedelta(minutes=5)), ("b", T0 + datetime.timedelta(hours=3))], "kind string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("kind string, ts timestamp").parquet(str(tmp_path / "w"))
    got = R.drained(R.windowed_counts(stream, "ts", "kind", "10 minutes", "10 minutes", "1 minute"), "test-windows").collect()
    assert [(r["kind"], r["n"]) for r in got] == [("a", 2)]  # the last window is still open


def test_throttle_and_flags(spark):
    at = lambda h: T0 + datetime.timedelta(hours=h)
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("a", at(12), 3), ("b", at(1), 4), ("a", at(23.9), 5), ("a", at(24), 6)], "k string, ts timestamp_ntz, i long")
    assert sorted(r["i"] for r in R.throttled(df, "k", "ts", "i", 12 * 3600).collect()) == [1, 3, 4, 6]
    flags = R.live_flags(df.withColumn("f", F.lit("x")), "k", "f", "ts", 3600, F.lit("2024-01-02 00:30:00").cast("timestamp_ntz"))
    assert [r["k"] for r in flags.collect()] == ["a"]
    df = spark.createDataFrame([(90.0, 10.0, 0.0), (20.0, 80.0, 90.0), (20.0, 0.0, 90.0), (50.0, 0.0, 70.0), (50.0, 50.0, 50.0)], "e double, h double, b double")
    assert [r[0] for r in df.select(R.mood(F.col("e"), F.col("h"), F.col("b"))).collect()] == ["cheerful", "hungry", "tired", "bored", "calm"]


def test_statistics(spark):
    p = spark.createDataFrame([(x,) for x in (0.01, 0.04, 0.03, 0.005, 0.9)], "p double")
    assert {r["p"]: pytest.approx(r["p_holm"]) for r in S.holm(p, "p").collect()} == {0.005: 0.025, 0.01: 0.04, 0.03: 0.09, 0.04: 0.09, 0.9: 0.9}
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0)], "g string, x double, y double")
    assert {(r["g"], r["x"]): r["rank"] for r in S.rank_of_values(df, ["g"], "x").collect()} == {("a", 1.0): 1.0, ("a", 2.0): 2.5, ("b", 1.0): 1.5}
    assert {r["g"]: round(r["rho"], 6) for r in S.spearman(df, ["g"], "x", "y").collect()} == {"a": 0.5, "b": 0.0}
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (round(r[0]["lo"], 4), round(r[0]["hi"], 4)) == (0.4902, 0.9433) and tuple(r[1]) == (0.0, 0.0)
    assert S.student_p(2.0, 10) == pytest.approx(0.0733880347707, abs=1e-9) and S.student_p(0.0, 5) == pytest.approx(1.0) and S.student_p(1.0, 1) == pytest.approx(0.5)
    r = spark.createDataFrame([(math.pi - 0.1,), (-math.pi + 0.1,)], "t double").agg(*S.circular("t")).first()
    assert abs(abs(r["direction"]) - math.pi) < 1e-9 and r["resultant"] == pytest.approx(math.cos(0.1))


def test_ordered(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 1, 0, 1, 1, 0, 0, 1, None, 1])], "k string, i int, v int")
    r = O.widest_run(df, ["k"], "i", F.col("v") == 1).first()
    assert (r["first"], r["last"], r["length"]) == (0, 1, 2)
    assert O.widest_run(df, ["k"], "i", F.col("v") == 7).count() == 0
    a = spark.createDataFrame([("k", x) for x in (3.0, -3.0, 0.5)], "k string, a double")
    assert O.circular_gaps(a, ["k"], "a").first()["max_gap"] == pytest.approx(3.0 + 0.5)
    spine = spark.createDataFrame([(c * 10.0,) for c in range(8)], "c double")
    ev = spark.createDataFrame([(0.0,), (19.9,), (20.0,), (60.0,), (-20.0,)], "t double")
    got = {r["c"]: r["n"] for r in O.sliding(spine, ev, [], "t", 20.0, 10.0).groupBy("c").agg(F.count("t").alias("n")).collect()}
    assert got == {c: sum(c - 20 <= t < c + 20 for t in (0.0, 19.9, 20.0, 60.0, -20.0)) for c in [x * 10.0 for x in range(8)]}


def test_codes(spark):
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 3), ("a", 4, None), ("b", 9, 0)], "item string, idx int, score int")
    assert {(r["item"], r["idx"]) for r in C.winners(s, ["item"], "score", 2).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 9)}
    assert {(r["item"], r["idx"]) for r in C.exactly(s, ["item"], "score", "idx", 2).collect()} == {("a", 1), ("a", 2), ("b", 9)}
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(9)] + [(9, None)], "i long, v array<double>")
    for block in (2, 4096):
        got = {(r["query"], r["place"]): r["item"] for r in C.nearest(v.where("i IN (0, 4, 8)"), v, "i", "v", 2, block).collect()}
        assert len(got) == 6 and all(q != i for (q, _), i in got.items())


def test_text(spark):
    r = spark.createDataFrame([("ŞEKERLİ AÇLIK", 'so: ```{"a": {"b": 1}}``` end'), ("", ""), (None, None)], "t string, j string").select(folded(F.col("t")).alias("f"), tokens(F.col("t")).alias("w"), first_object(F.col("j")).alias("o")).collect()
    assert r[0]["f"] == "sekerli aclik" and r[0]["w"] == ["sekerli", "aclik"] and r[0]["o"] == '{"a": {"b": 1}}'
    assert r[1]["w"] == [] and r[1]["o"] is None and r[2]["f"] is None
    g = spark.createDataFrame([("ab",), ("",), ("a",)], "t string").select(ngrams(F.col("t"), 3).alias("g")).collect()
    assert [x["g"] for x in g] == [["^ab", "ab$"], [], ["^a$"]]
    c = spark.createDataFrame([(x,) for x in ("9 * 9", "80 + 5", "3 - 5", "4 / 0", "82 + 0", "80 / 1", "8 - 8")], "asked string")
    assert [(r["result"], r["error"]) for r in answered(c, "asked").collect()] == [(81, None), (None, "result"), (None, "result"), (None, "zero"), (None, "operand"), (None, "quotient"), (0, None)]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("root_id\tcell_type\tx\n12\tA\t1\n\tB\t2\n7.0\t\t3\n")
    rows = ingest.read_annotations(spark, str(tmp_path / "a.tsv"), keep=["root_id", "cell_type", "absent"]).collect()
    assert {tuple(r) for r in rows} == {(12, "A"), (7, None)}
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,c\n3,4\n")
    assert {tuple(r) for r in ingest.read_delimited(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()} == {("1", "2", None), (None, "3", "4")}
    (tmp_path / "x.json").write_text('{"w": "a", "n": 1}\nnot json\n{"w": "b", "n": "x"}\n')
    good, bad = ingest.read_json_rows(spark, str(tmp_path / "x.json"), "w STRING, n INT")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 2
    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, k string")
    ingest.write_partitioned(df, str(tmp_path / "p"), ["k"])
    ingest.append_delimited(df, str(tmp_path / "c"))
    ingest.append_delimited(df, str(tmp_path / "c"))
    ingest.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 'x'").count() == 1 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 4 and spark.read.json(str(tmp_path / "j")).count() == 2
    assert ingest.resolved(df, {"id": ["ID", "I"]}).columns == ["id"]
    with pytest.raises(ValueError):
        ingest.resolved(df, {"id": ["no"]})
    assert ingest.parse_json('```{"a": 1}```') == {"a": 1} and ingest.parse_json("none") is None
    assert '"name":"s"' in ingest.scene_document("s", df, df).first()["document"]


def test_folding_equals_its_definition(spark):
    import unicodedata

    from axonlake.functions.text import FOLD_FROM, FOLD_TO

    def plain(t):
        t = t.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    texts = ["inténtelo niña Straße página", "ﬁne ﬂow ½ ② x² ™ …", "𝐀𝐛 Ⅳ ŉ ŀ ｆｕｌｌ Ǆ", "İIıi ŞEKERLİ", "é ü decomposed", "神経 схема 🪰", "", "  a  b "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", folded(F.col("t")).alias("f"), tokens(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    assert next(r["w"] for r in got if r["i"] == 0) == ["intentelo", "nina", "stra", "e", "pagina"]


def test_lexicon(spark):
    lex = lambda rows: spark.createDataFrame(rows, "word string, category string")
    known = X.resolved(lex([("Şeker", "food"), ("aç", "food"), ("run log", "record"), ("şeker", "food"), ("", "x")]), lex([("seker", "sweet"), ("new", "own")]))
    assert {tuple(r) for r in known.collect()} == {("seker", "sweet"), ("ac", "food"), ("run log", "record"), ("new", "own")}
    texts = spark.createDataFrame([(1, "ŞEKERLİ çay aç aç"), (2, "acele, açlık"), (3, "see the Run, log newly"), (4, None), (5, ""), (6, "newest new")], "i long, t string").withColumn("keyword", F.lit("clash"))
    got = {(r["i"], r["place"]): (r["keyword"], r["category"]) for r in X.hits(texts, "i", "t", known).collect()}
    assert got == {(1, 1): ("seker", "sweet"), (1, 2): ("ac", "food"), (3, 1): ("run log", "record"), (6, 1): ("new", "own")}
    assert {r["i"]: r["route"] for r in X.routes(texts, "i", "t", known).collect()} == {1: "sweet", 2: "unknown", 3: "record", 4: "unknown", 5: "unknown", 6: "own"}
    assert X.hits(texts, "i", "t", known.limit(0)).count() == 0


def test_hashes(spark):
    import hashlib

    got = [r[0] for r in spark.createDataFrame([("a",), (None,), ("",)], "t string").select(keyed_hash(F.col("t"), 3)).collect()]
    want = [int.from_bytes(hashlib.blake2b(f"3|{t}".encode(), digest_size=8).digest(), "big", signed=True) for t in ("a", "")]
    assert got == [want[0], None, want[1]]


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None, "x"]), i, rng.randrange(5)) for i in rng.sample(range(5000), 600)]
    got = {(r["g"], r["o"]): r["upto"] for r in O.running_total(spark.createDataFrame(rows, "g string, o int, n int"), ["g"], ["o"], "n", "upto").collect()}
    total, want = {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        want[(g, o)] = total[g] = total.get(g, 0) + n
    assert got == want
    assert O.running_total(spark.createDataFrame([], "g string, o int, n int"), ["g"], ["o"], "n", "upto").count() == 0


def test_circular_correlation(spark):
    rng = random.Random(3)
    a = [rng.uniform(-3, 3) for _ in range(50)]
    df = spark.createDataFrame([("s", x, x + 0.5) for x in a] + [("t", x, -x) for x in a] + [("c", 1.0, x) for x in a] + [("s", None, 1.0)], "g string, a double, b double")
    assert {r["g"]: (r["n"], round(r["r"], 6)) for r in S.circular_correlation(df, "a", "b", ["g"]).collect()} == {"s": (50, 1.0), "t": (50, -1.0), "c": (50, 0.0)}


def test_gates(spark):
    df = spark.createDataFrame([(a, b) for a in (0, 1, 7, 50, 255) for b in (0, 1, 3, 50, 255)], "a int, b int")
    m = multiplied(F.col("a"), F.col("b"), 8)
    for r in df.select("a", "b", m["value"].alias("p"), *[computed(F.col("a"), F.lit(o), F.col("b"), 8).alias(n) for o, n in (("+", "s"), ("-", "d"), ("?", "u"))]).collect():
        assert (r["p"], r["s"], r["d"], r["u"]) == (r["a"] * r["b"], r["a"] + r["b"], r["a"] - r["b"] if r["a"] >= r["b"] else None, None)


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, k string")
    path = f"file://{tmp_path}/j"
    for n in (2, 1):  # replaced as a whole
        ingest.write_json(df.limit(n), path)
        assert spark.read.json(path).count() == n and sorted(p.name for p in tmp_path.iterdir()) == ["j"]
    built = []
    build = lambda: (built.append(1), df)[1]
    for key, count in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert ingest.cached(spark, f"file://{tmp_path}/c", key, build).count() == 2 and len(built) == count
    good, bad = ingest.validated(df, {"no name": "k IS NOT NULL", "too large": "i < 2"})
    assert [r["i"] for r in good.collect()] == [1] and [r["reasons"] for r in bad.collect()] == [["no name", "too large"]]
    assert ingest.validated(df, {})[0].count() == 2
