"""A linear readout of sparse codes: fitted from sums, measured over any vocabulary, taught one word at a time, and taken back.

The readout (labels times units) is small and travels to the tasks; MAX_WEIGHTS is checked. Vocabularies are DataFrames (word, units: the
active units). A readout isn't changed by teaching: `taught` returns another one, so undoing is going back to the one before, and what a
lesson did to the other words is a join of two measurements.

Defined cases: a word without units has the label of the largest bias; null words count as words without units; equal scores go to the
first label; a label not known before gets weights of 0 to begin with; an empty vocabulary has an empty measurement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.functions.text import keyed_hash, ngrams

MAX_WEIGHTS = 20_000_000


@dataclass(frozen=True)
class Readout:
    labels: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, units: list[int]) -> np.ndarray:
        return self.weights[:, units].sum(axis=1) + self.bias


def coded(words: DataFrame, word: str, units: int, salt: int = 0, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(word, units) by the hashed n-grams of each distinct word, in lower case."""
    grams: Column = F.flatten(F.array(*[ngrams(F.lower(word), n) for n in sizes]))
    each = words.select(word).where(F.col(word).isNotNull()).distinct().select(F.col(word).alias("word"), F.explode_outer(F.array_distinct(grams)).alias("g"))
    hit = each.select("word", F.pmod(keyed_hash(F.col("g"), salt), F.lit(units)).cast("int").alias("u"))
    return hit.groupBy("word").agg(F.array_sort(F.collect_set("u")).alias("units"))


def fitted(codes: DataFrame, units: int, ridge: float = 1.0) -> Readout:
    """The readout of codes (word, units, label) by ridge regression on one-hot labels. What comes to the driver are sums over all words: how often two units are active together, and a unit with a label."""
    labels = tuple(r["label"] for r in codes.select("label").where("label IS NOT NULL").distinct().orderBy("label").limit(MAX_WEIGHTS // max(1, units) + 1).collect())
    if len(labels) * units > MAX_WEIGHTS or units * units > MAX_WEIGHTS:
        raise ValueError(f"a readout has at most {MAX_WEIGHTS} weights")
    known = codes.where("label IS NOT NULL").withColumn("u", F.concat("units", F.array(F.lit(units))))  # the last unit is always active: the bias
    pairs = known.select("u", F.explode("u").alias("a")).select("a", F.explode("u").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    votes = known.select("label", F.explode("u").alias("a")).groupBy("a", "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    xx, xy, at = np.zeros((units + 1, units + 1)), np.zeros((units + 1, len(labels))), {x: i for i, x in enumerate(labels)}
    xx[pairs["a"].to_numpy(int), pairs["b"].to_numpy(int)] = pairs["n"].to_numpy(float)
    xy[votes["a"].to_numpy(int), [at[x] for x in votes["label"]]] = votes["n"].to_numpy(float)
    w = np.linalg.solve(xx + ridge * np.eye(units + 1), xy).T
    return Readout(labels, w[:, :-1], w[:, -1])


def measured(readout: Readout, codes: DataFrame, temperature: float = 0.4) -> DataFrame:
    """(word, label, confidence, margin): the softmax share of the best label, and how far its score lies above the next."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for units in batch["units"]:
                z = readout.scores([] if units is None else [int(u) for u in units])
                order = np.argsort(-z, kind="stable")
                share = 1 / np.exp((z - z[order[0]]) / temperature).sum()
                out.append((readout.labels[order[0]], float(share), float(z[order[0]] - z[order[1]]) if len(z) > 1 else None))
            label, share, margin = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"word": batch["word"], "label": pd.Series(label, dtype=object), "confidence": pd.Series(share, dtype=float), "margin": pd.Series(margin, dtype=float)})

    return codes.select("word", "units").mapInPandas(take, "word string, label string, confidence double, margin double")


def taught(readout: Readout, units: list[int], label: str, max_steps: int = 8, tolerance: float = 0.05) -> tuple[Readout, int]:
    """The readout after a lesson, one word by the delta rule until every score is within tolerance of its target, and the steps that took."""
    if label not in readout.labels:
        n = readout.weights.shape[1]
        readout = Readout((*readout.labels, label), np.vstack([readout.weights, np.zeros((1, n))]), np.append(readout.bias, 0.0))
    goal = np.array([float(x == label) for x in readout.labels])
    w, b, steps = readout.weights.copy(), readout.bias.copy(), 0
    rate = 1 / max(1, len(units))
    while steps < max_steps and np.abs(miss := goal - w[:, units].sum(axis=1) - b).max() > tolerance:
        w[:, units] += rate * miss[:, None]
        b += rate * miss
        steps += 1
    return replace(readout, weights=w, bias=b), steps


def lesson_effects(before: DataFrame, after: DataFrame, floor: float, drop: float) -> DataFrame:
    """One row: words, those whose label changed, those that lost more than `drop` of confidence, and those left below `floor`."""
    both = before.alias("b").join(after.alias("a"), F.col("a.word").eqNullSafe(F.col("b.word")))
    return both.agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("a.label") != F.col("b.label")).alias("n_changed"), F.count_if(F.col("b.confidence") - F.col("a.confidence") > drop).alias("n_dropped"),
        F.count_if((F.col("a.confidence") < floor) & (F.col("b.confidence") >= floor)).alias("n_below"),
    )
