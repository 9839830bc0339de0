import random

import pytest

from axonlake.functions.absent import says_nothing
from axonlake.operators.impute import fill_category, fill_numbers, mixed_effects
from pyspark.sql import functions as F


def cells(spark, n=4000, missing=0.2, seed=4):
    rng = random.Random(seed)
    effect = {g: rng.gauss(0, 30) for g in "abcdefgh"}
    month = {m: rng.gauss(0, 10) for m in range(6)}
    out = []
    for i in range(n):
        g, m = rng.choice("aaaabcdefgh"), rng.randrange(6)
        y = 500 + effect[g] + month[m] + rng.gauss(0, 5)
        c = g.upper() if rng.random() < 0.9 else "Z"
        out.append((i, g if rng.random() < 0.97 else None, m, None if rng.random() < missing else y, y, None if rng.random() < missing else c, c, "clash"))
    return spark.createDataFrame(out, "i long, g string, m int, y double, truth double, c string, c_truth string, level string")


def test_numbers_are_filled_better_than_by_the_mean(spark):
    df = cells(spark)
    got = fill_numbers(df, {"y": None}, ["g", "m"]).collect()
    assert len(got) == 4000 and all(r["y"] is not None for r in got)
    filled = [r for r in got if r["y_filled"]]
    mean = sum(r["truth"] for r in got) / 4000
    rms = lambda f: (sum(f(r) ** 2 for r in filled) / len(filled)) ** 0.5
    assert rms(lambda r: r["y"] - r["truth"]) < 0.5 * rms(lambda r: mean - r["truth"])
    assert all(r["y"] == r["truth"] for r in got if not r["y_filled"])


def test_companions(spark):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], 0, x if i % 5 else None, x + 7 + rng.gauss(0, 1) if i % 7 else None, x) for i, x in ((i, rng.uniform(0, 1000)) for i in range(700))]
    got = fill_numbers(spark.createDataFrame(rows, "i long, g string, m int, x double, y double, truth double"), {"x": "y", "y": "x"}, ["g", "m"]).collect()
    assert all(abs(r["x"] - r["truth"]) < 6 for r in got if r["x_filled"] and r["i"] % 7) and all(r["x"] is not None and r["y"] is not None for r in got)
    assert sum(r["y_filled"] for r in got) == 100 and sum(r["x_filled"] for r in got) == 140


def test_small_groups_are_shrunk(spark):
    rows = [("big", 0, 10.0 + i % 3) for i in range(300)] + [("mid", 0, 20.0 + i % 3) for i in range(300)] + [("one", 0, 90.0)]
    means, effects = mixed_effects(spark.createDataFrame(rows, "g string, m int, y double"), ["y"], ["g", "m"])
    mean, e = means["y"], {r["level"]: r["y"] for r in effects["g"].collect()}
    assert 0 < e["one"] < 90 - mean and e["big"] == pytest.approx(11 - mean, abs=0.2)


def test_categories(spark):
    got = fill_category(cells(spark), "c", ["g"], "m").collect()
    filled = [r for r in got if r["c_filled"]]
    assert sum(r["c"] == r["c_truth"] for r in filled) > 0.8 * len(filled) and all(r["c"] for r in got)


def test_nothing_known(spark):
    df = spark.createDataFrame([(1, "a", 0, None, None), (2, None, None, None, None)], "i long, g string, m int, y double, c string")
    assert [(r["y"], r["y_filled"]) for r in fill_numbers(df, {"y": None}, ["g", "m"]).collect()] == [(None, True)] * 2
    assert [(r["c"], r["c_filled"]) for r in fill_category(df, "c", ["g"], "m").collect()] == [(None, True)] * 2
    assert fill_numbers(df.limit(0), {"y": None}, ["g", "m"]).count() == 0 and fill_category(df.limit(0), "c", ["g"], "m").count() == 0


def test_says_nothing(spark):
    yes = ["", " ", "\t", "?", "N.A.", "n/a", "NaN", "-", "Not Typed", "to be determined", "TBD", "unk.", None]
    no = ["Ring19b", "NAm58", "Kv31'", "UNq45", "Ix4'"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", says_nothing(F.col("t")).alias("m"))
    assert {r["t"] for r in df.where("m").collect()} == set(yes)
