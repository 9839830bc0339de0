import pytest
from pyspark.sql import functions as F

from axonlake.operators.segmentation import _best, _expected, atoms, segment, unquote, unwrap

CASES = {
    'a; "b; c" ,d': ["a", "b; c", "d"], '["x","y z"]': ["x", "y z"], "{a,a}": ["a", "a"], "gaba |": ["gaba"], "a\tb\nc": ["a", "b", "c"], "nitric oxide": ["nitric oxide"], "5-HT+GABA-like": ["5-HT", "GABA-like"],
    "'o' & p": ["o", "p"], '"whole, one"': ["whole, one"], ",;": [], "": [], "  ": [], "a/b/c/d/e/f/g": list("abcdefg"), 'say "open, never': ['say "open', "never"], "(a, b)": ["a", "b"], "gaba (ring) , b": ["gaba (ring)", "b"],
}


def test_taking_apart():
    assert unwrap(" [a] ") == "a" and unwrap("[a],[b]") == "[a],[b]" and unwrap("{{a}}") == "a" and unwrap("(a") == "(a"
    assert unquote(' "a" ') == "a" and unquote('"a","b"') == '"a","b"'
    assert [("a;b"[i:j]) for i, j in atoms("a;b")] == ["a", "b"]


def test_forward_backward_equals_enumeration():
    import itertools
    import math

    n, w = 5, {}
    edges = [(i, j, f"{i}{j}", w.setdefault((i, j), -0.3 * (j - i) ** 2 - 0.1 * i)) for i in range(n) for j in range(i + 1, min(i + 3, n) + 1)]
    total, want, best = 0.0, {}, (-1e9, None)
    for cut in itertools.product([0, 1], repeat=n - 1):
        ends = [0, *[k + 1 for k, c in enumerate(cut) if c], n]
        spans = list(zip(ends, ends[1:]))
        if any(b - a > 3 for a, b in spans):
            continue
        s = sum(w[x] for x in spans)
        total += math.exp(s)
        best = max(best, (s, spans))
        for x in spans:
            want[f"{x[0]}{x[1]}"] = want.get(f"{x[0]}{x[1]}", 0) + math.exp(s)
    got, fit = _expected(edges)
    assert fit == pytest.approx(math.log(total)) and all(got[k] == pytest.approx(v / total) for k, v in want.items())
    assert _best(edges) == [f"{a}{b}" for a, b in best[1]]


def test_segment(spark):
    long = ";".join(["v"] * 3000)
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,), (long,)] + [("a; b",)] * 5, "text string").withColumn("value", F.lit("clash"))
    got = {}
    for r in segment(df, "text").orderBy("pos").collect():
        got.setdefault(r["text"], []).append(r["value"])
    assert len(got.pop(long)) == 3000 and got.pop("a; b") == ["a", "b"]
    assert got == {k: v for k, v in CASES.items() if v}


def test_segment_nothing(spark):
    assert segment(spark.createDataFrame([], "text string"), "text").count() == 0


def _cut(spark, texts, **more):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r["v"] for r in segment(df, "text", **more).groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v")).collect()}


def test_frequencies_decide(spark):
    """The same text is cut or kept whole by what the rest of the column holds."""
    quoted = ['"x, y"'] * 3000
    assert _cut(spark, quoted + ["x, y", "z; x, y"]) == {'"x, y"': ["x, y"], "x, y": ["x, y"], "z; x, y": ["z", "x, y"]}
    apart = ["x", "y"] * 3000
    assert _cut(spark, quoted + apart + ["x, y", "z; x, y"])["x, y"] == ["x", "y"]
    assert _cut(spark, ["x, y", "z; x, y"])["z; x, y"] == ["z", "x", "y"]


def test_the_size_of_the_column_does_not(spark):
    rare = ["p / q", "r | s | t", '"m, n"', "m, n"]
    want = {"p / q": ["p", "q"], "r | s | t": ["r", "s", "t"], "m, n": ["m", "n"]}
    for others in (0, 20_000):
        got = _cut(spark, rare + [f"name {i}" for i in range(others)])
        assert {k: got[k] for k in want} == want


def test_unfinished_rounds_raise(spark):
    with pytest.raises(RuntimeError):
        _cut(spark, ["a, b", '"a, b"', "a"], max_rounds=1)
