import random

import numpy as np
import pytest

from axonlake.llm.sorted_ranks import merge_states, percentiles, value_states
from axonlake.llm.top_bands import top_n

SCHEMA = "g string, item long, score int, place int"


def items(n=4000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 10 + [f"g{i}" for i in range(300)] + [None]), i, rng.choice([None, 1, 1, 2, 3, rng.randint(1, 500)]), 0) for i in range(n)]


def best(data, n):
    groups = {}
    for g, i, s, _ in data:
        if s is not None:
            groups.setdefault(g, []).append((-s, i))
    return {(g, p + 1, i) for g, v in groups.items() for p, (_, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("lower", [None, [], [400, 100, 2], [1], [3, 2, 1]])
def test_bands_give_exact_places(spark, lower):
    data = items()
    df = spark.createDataFrame(data, SCHEMA)
    for limit in (0, 10_000):
        got = top_n(df, ["g"], "score", ["item"], 5, lower, limit)
        assert {(r["g"], r["place"], r["item"]) for r in got.collect()} == best(data, 5)


def test_repeated_items_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5, 0)] * 3 + [("a", 2, 5, 0), ("b", None, 1, 0)], SCHEMA)
    got = top_n(df, ["g"], "score", ["item"], 3)
    assert sorted((r["place"], r["item"]) for r in got.where("g = 'a'").collect()) == [(1, 1), (2, 1), (3, 1)]
    assert got.where("g = 'b'").count() == 1
    assert top_n(df.limit(0), ["g"], "score", ["item"], 3).count() == 0


def values(n=3000, seed=2):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, float("nan"), 0.5, 0.5, -0.0, 0.0, rng.gauss(0, 9), 1e300])
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(5), pick()) for _ in range(n)] + [("none", 0, None), ("one", 0, 7.0)]


def test_percentiles_are_exact_and_add_up(spark):
    data = values()
    df = spark.createDataFrame(data, "g string, day int, x double")
    daily = value_states(df, ["g", "day"], "x")
    probs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    for parts in (1, 7):
        for states, key in ((daily, ("g", "day")), (merge_states(daily, ["g"]), ("g",))):
            got = {tuple(r[k] for k in key): r for r in percentiles(states, list(key), probs, parts).collect()}
            want = {}
            for g, day, x in data:
                want.setdefault((g, day)[: len(key)], []).append(x)
            assert got.keys() == want.keys()
            for k, xs in want.items():
                known = [x for x in xs if x is not None and x == x]
                assert got[k]["n"] == len(known)
                for name, p in probs.items():
                    assert got[k][name] == (pytest.approx(np.quantile(known, p), rel=1e-12) if known else None)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert percentiles(value_states(df, ["g"], "x"), ["g"], {"p": 0.5}).count() == 0
