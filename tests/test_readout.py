import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.functions.text import one_exclamation
from axonlake.operators import readout as L
from axonlake.operators import sample as U
from axonlake.streaming.state import rest_episodes


def vocabulary(spark):
    words = [(f"{a}{b}{i}", lab) for lab, a in (("alpha", "xyx"), ("beta", "qrq")) for b in ("on", "in") for i in range(8)]
    df = spark.createDataFrame(words, "w string, label string")
    return L.coded(df, "w", 64).join(df.withColumnRenamed("w", "word"), "word")


def test_fit_measure_and_lesson(spark):
    v = vocabulary(spark)
    rows = v.collect()
    r = L.fitted(v, 64)
    x = np.array([[float(u in row["units"]) for u in range(64)] + [1.0] for row in rows])
    y = np.array([[float(row["label"] == c) for c in r.labels] for row in rows])
    want = np.linalg.solve(x.T @ x + np.eye(65), x.T @ y).T
    assert np.allclose(np.column_stack([r.weights, r.bias]), want)
    got = {m["word"]: m["label"] for m in L.measured(r, v).collect()}
    assert got == {row["word"]: row["label"] for row in rows}
    second, steps = L.taught(r, [1, 5, 9], "new")
    assert 0 < steps <= 8 and second.labels == ("alpha", "beta", "new") and np.allclose(second.scores([1, 5, 9]), [0, 0, 1], atol=0.05) and r.labels == ("alpha", "beta")
    before = L.measured(r, v)
    assert tuple(L.lesson_effects(before, before, 0.5, 0.0).first()) == (len(rows), 0, 0, 0)
    assert L.lesson_effects(before, L.measured(second, v), 0.5, 0.0).first()["n_words"] == len(rows)
    odd = spark.createDataFrame([("none", []), ("null", None)], "word string, units array<int>")
    assert {m["label"] for m in L.measured(r, odd).collect()} == {r.labels[int(np.argmax(r.bias))]} and L.measured(r, odd.limit(0)).count() == 0


def test_rest_episodes(spark):
    rng = random.Random(1)
    ticks = sorted((rng.choice([1, 2]), float(rng.randrange(4000)), i, rng.choice([5.0, 2.0])) for i in range(400))
    got = {r["k"]: (pytest.approx(r["energy"]), r["episodes"]) for r in rest_episodes(spark.createDataFrame(ticks, "k long, t double, i long, dt double"), "k", "t", "i", "dt").collect()}
    for k in (1, 2):
        energy, left, began, n = 60.0, 0, -1e9, 0
        for _, t, _, dt in (r for r in ticks if r[0] == k):
            energy = max(0.0, energy - 0.3 * dt)
            if left:
                left, energy = left - 1, min(100.0, energy + 3)
            elif energy <= 30 and t - began >= 60:
                left, began, n = 10, t, n + 1
        assert got[k] == (energy, n) and n
    assert rest_episodes(spark.createDataFrame([], "k long, t double, i long, dt double"), "k", "t", "i", "dt").count() == 0


def test_one_exclamation(spark):
    cases = {
        "wow, that hurt, wow! oh": "wow, that hurt", "wow, fine": "wow, fine", "Oh, wow, mine [wow, oh] wow!": "Oh, mine [wow, oh]", "powwow wow oh no": "powwow wow no", "": "", "nothing here": "nothing here",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", one_exclamation(F.col("t"), ["wow", "oh"]).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases | {None: None}


def test_draws(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "b", "b", None, "c"]], "x string")
    one, two = ([(r["draw"], r["x"]) for r in U.with_replacement(d, "x", 200, 5).orderBy("draw").collect()] for d in (df, df.repartition(3)))
    assert one == two and len(one) == 200 and {x for _, x in one} == {"a", "b", "c", None}
    assert min(sum(x == v for _, x in one) for v in ("a", "b", "c", None)) > 25 and U.with_replacement(df.limit(0), "x", 5, 5).count() == 0
    grid = spark.range(100).selectExpr("id % 50 AS k")
    got = [r["k"] for r in U.accepted(grid, "k % 2 = 0", ["k"], 10, 3).collect()]
    assert len(set(got)) == 10 and all(k % 2 == 0 for k in got) and U.accepted(grid, "k < 3", ["k"], 10, 3).count() == 3
