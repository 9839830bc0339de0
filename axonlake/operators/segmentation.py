"""Fields that hold several values, taken apart by a lattice whose segment frequencies are learnt from the whole column.

A field is cut into atoms at every possible separator: punctuation or signs, a tab or a line break outside quotes. Quoted spans and
round brackets stay in one atom, brackets around the whole field are taken off. Every run of up to `max_span` neighbouring atoms is a
candidate value. Expectation maximisation learns how frequent each candidate is: forward-backward sums over all ways to cut a field give
the expected counts, until the likelihood of the column stays. A cut that keeps a separator inside a value pays for it: it wins when the
expected count of the whole, times `glue`, exceeds the product of the counts of its parts. So the rule is one of counts and doesn't move
with the size of the column. The most likely cut of a field (Viterbi, the finer one on ties) gives its values, with nothing after it.

A value learnt elsewhere as a whole, as one in quotes, thus stays whole where it stands without quotes, if its parts are hardly ever seen
by themselves. `max_span` bounds the model: a value without quotes that holds more than max_span - 1 separators is not thought of; one in
quotes is one atom however long.

All passes run over distinct field texts with their counts, so a text in a third of all rows is one row; the lattices of a text are one
row as well, and texts of one atom, which can be cut in one way only, are counted once and take no part in the rounds. Frequencies are
joined by candidate, broadcast only up to `BROADCAST_VALUES`.

Defined cases: null, empty and blank fields, and those of separators only, have no values; a quote that is never closed is an ordinary
sign of its name; a value given twice stays twice; very long fields give long lattices, in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonlake.sources.scratch import materialize

BROADCAST_VALUES = 100_000
_PAIRS = {"[": "]", "{": "}", "(": ")"}
_QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "«": "»"}


def _is_separator(c: str) -> bool:
    """Names are made of letters, digits, blanks, hyphens, round brackets, quotes; the rest separates."""
    return c in "\t\n\r\x0b\x0c" or not (c.isalnum() or c.isspace() or c in "-‐‑()\"'’" or c in _QUOTES or c in "”“")


def _closing(text: str, i: int) -> int:
    """The place of the quote that closes the one at i: it is followed by a separator, a closing bracket or the end; -1 if there is none."""
    end = _QUOTES[text[i]]
    j = text.find(end, i + 1)
    while j >= 0:
        k = j + 1
        while k < len(text) and text[k] == " ":
            k += 1
        if k == len(text) or _is_separator(text[k]) or text[k] == ")":
            return j
        j = text.find(end, j + 1)
    return -1


def unwrap(text: str) -> str:
    """Without outer blanks and brackets around the whole."""
    text = text.strip()
    while len(text) > 1 and text[0] in _PAIRS and text[-1] == _PAIRS[text[0]]:
        depth, i = 0, 0
        while i < len(text):
            c = text[i]
            if c in _QUOTES and (i == 1 or _is_separator(text[i - 1]) or text[i - 1] in " (") and (j := _closing(text, i)) > 0:
                i = j + 1
                continue
            depth += (c == text[0]) - (c == _PAIRS[text[0]])
            if depth == 0 and i < len(text) - 1:
                return text
            i += 1
        if depth:
            return text
        text = text[1:-1].strip()
    return text


def unquote(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] in _QUOTES and value[-1] == _QUOTES[value[0]] and _closing(value, 0) == len(value) - 1:
        return value[1:-1].strip()
    return value


def atoms(text: str) -> list[tuple[int, int]]:
    """The stretches between possible separators, without empty ones."""
    found, start, i = [], 0, 0
    while i < len(text):
        c = text[i]
        if c in _QUOTES and not text[start:i].strip() and (j := _closing(text, i)) > 0:
            i = j + 1
            continue
        if _is_separator(c):
            found.append((start, i))
            start = i + 1
        i += 1
    found.append((start, len(text)))
    return [(a, b) for a, b in found if unquote(text[a:b])]


def lattice(text: str, max_span: int) -> list[tuple[int, int, str]]:
    """(first atom, end atom, candidate value)."""
    text = unwrap(text)
    cuts = atoms(text)
    return [(i, j, unquote(text[cuts[i][0] : cuts[j - 1][1]])) for i in range(len(cuts)) for j in range(i + 1, min(i + max_span, len(cuts)) + 1)]


def _expected(edges: list[tuple[int, int, str, float]]) -> tuple[dict[str, float], float]:
    """Expected number of times each candidate is a value, over all cuts of one field, and the log likelihood of the field. Sums are of logs, so long fields don't underflow."""
    n = max(e[1] for e in edges)
    into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for e in edges:
        into[e[1]].append(e)
        out[e[0]].append(e)
    a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    add = lambda xs: -math.inf if (m := max(xs)) == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))
    for j in range(1, n + 1):
        a[j] = add([a[e[0]] + e[3] for e in into[j]])
    for i in range(n - 1, -1, -1):
        b[i] = add([b[e[1]] + e[3] for e in out[i]])
    got: dict[str, float] = {}
    for i, j, value, w in edges:
        got[value] = got.get(value, 0.0) + math.exp(a[i] + w + b[j] - a[n])
    return got, a[n]


def _best(edges: list[tuple[int, int, str, float]]) -> list[str]:
    n = max(e[1] for e in edges)
    into = [[] for _ in range(n + 1)]
    for e in edges:
        into[e[1]].append(e)
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)] + [(-math.inf, 0, None)] * n
    for j in range(1, n + 1):
        for e in into[j]:
            s, pieces, _ = best[e[0]]
            if (s + e[3], pieces + 1) > best[j][:2]:
                best[j] = (s + e[3], pieces + 1, e)
    values, j = [], n
    while j:
        e = best[j][2]
        values.append(e[2])
        j = e[0]
    return values[::-1]


def _weighted(edges, glue: float, total: float) -> list[tuple[int, int, str, float]]:
    """Edges with log weights. A separator kept costs glue / total, as a cut brings one more factor of count / total."""
    cost = math.log(glue / total)
    return [(e["i"], e["j"], e["value"], e["logp"] + cost * (e["j"] - e["i"] - 1)) for e in edges]


def segment(texts: DataFrame, text: str, max_span: int = 4, glue: float = 1e-3, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """(text, pos, value) for every distinct text; pos from 1. Rounds end when the log likelihood of a text grows by less than tolerance on average; not to end within max_rounds is an error."""
    distinct = texts.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("n"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "n": batch["n"], "edges": [[{"i": i, "j": j, "value": v} for i, j, v in lattice(t, max_span)] for t in batch["text"]]})

    lattices = distinct.mapInPandas(build, "text string, n long, edges array<struct<i:int,j:int,value:string>>").where(F.size("edges") > 0)
    lattices = materialize(lattices.withColumn("tid", F.monotonically_increasing_id()), "lattices")
    one, several = lattices.where(F.size("edges") == 1), lattices.where(F.size("edges") > 1)
    whole = materialize(one.groupBy(F.col("edges")[0]["value"].alias("value")).agg(F.sum("n").cast("double").alias("c")), "single-values")
    spans = materialize(several.select("tid", "n", F.explode("edges").alias("e")).select("tid", "n", "e.i", "e.j", "e.value"), "spans")
    # where cutting begins: candidates count for as much as their separators allow
    open_ = spans.groupBy("value").agg(F.sum(F.col("n") * F.pow(F.lit(glue), F.col("j") - F.col("i") - 1)).alias("c"))
    freqs = materialize(whole.unionAll(open_).groupBy("value").agg(F.sum("c").alias("c")), "value-counts")

    def weighted_lattices(freqs: DataFrame) -> tuple[DataFrame, float]:
        rows, total = freqs.agg(F.count(F.lit(1)), F.sum("c")).first()
        total = float(total or 1.0)
        known = freqs.select("value", F.log(F.greatest("c", F.lit(1e-300)) / F.lit(total)).alias("logp"))
        if rows <= BROADCAST_VALUES:
            known = F.broadcast(known)
        joined = spans.join(known, "value")
        return joined.groupBy("tid", "n").agg(F.array_sort(F.collect_list(F.struct("i", "j", "value", "logp"))).alias("edges")), total

    def expectations(total: float):
        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got: dict[str | None, float] = {None: 0.0}
                for n, edges in zip(batch["n"], batch["edges"]):
                    counts, fit = _expected(_weighted(edges, glue, total))
                    got[None] += n * fit
                    for value, x in counts.items():
                        got[value] = got.get(value, 0.0) + n * x
                yield pd.DataFrame({"value": pd.Series(list(got), dtype=object), "c": list(got.values())})

        return expect

    n_texts, before = several.agg(F.sum("n")).first()[0] or 0, None
    for k in range(max_rounds if n_texts else 0):
        edges, total = weighted_lattices(freqs)
        counts = materialize(edges.mapInPandas(expectations(total), "value string, c double").groupBy("value").agg(F.sum("c").alias("c")), f"expected-{k}")
        fit = counts.where("value IS NULL").first()["c"]
        freqs = materialize(whole.unionAll(counts.where("value IS NOT NULL")).groupBy("value").agg(F.sum("c").alias("c")), f"value-counts-{k}")
        if before is not None and abs(fit - before) < tolerance * n_texts:
            break
        before = fit
    else:
        if n_texts:
            raise RuntimeError(f"value frequencies still change after {max_rounds} rounds")

    def decode(total: float):
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"tid": batch["tid"], "values": [_best(_weighted(edges, glue, total)) for edges in batch["edges"]]})

        return best

    edges, total = weighted_lattices(freqs)
    decoded = edges.mapInPandas(decode(total), "tid long, values array<string>")
    cut = decoded.join(lattices.select("tid", "text"), "tid").select("text", "values").unionAll(one.select("text", F.array(F.col("edges")[0]["value"])))
    return cut.select("text", F.posexplode("values").alias("p", "value")).select("text", (F.col("p") + 1).alias("pos"), "value")
