"""Spectra, embeddings and planes. Matrices are those of bounded sets (classes, circuits): one group of an Arrow function holds one, and
more than MAX_ORDER rows raise. Points are never held: their planes come from sums of products, and what follows from a plane is an
expression over the rows.

Defined cases: absent entries are 0 and repeated ones add up; an empty matrix has no eigenvalues; constant points have no direction, their
residual is 0; rows with a null don't count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.operators.simulate import plane

#: Order of a matrix that one task takes.
MAX_ORDER = 6000


def _on_matrix(matrix: DataFrame, work: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(matrix, ids) over the rows (pre, post, v), with the value from pre to post in row post."""

    def whole(e: pd.DataFrame) -> pd.DataFrame:
        e = e.dropna(subset=["pre", "post"])
        ids = np.array(sorted({*e["pre"], *e["post"]}), dtype=object)
        if len(ids) > MAX_ORDER:
            raise ValueError(f"{len(ids)} rows; a matrix has at most {MAX_ORDER}")
        at = {x: i for i, x in enumerate(ids)}
        w = np.zeros((len(ids), len(ids)))
        np.add.at(w, ([at[x] for x in e["post"]], [at[x] for x in e["pre"]]), e["v"].fillna(0).to_numpy(float))
        return work(w, ids)

    return matrix.select("pre", "post", F.col("v").cast("double").alias("v"), F.lit(0).alias("__ax_one")).groupBy("__ax_one").applyInPandas(whole, schema)


def eigenvalues(matrix: DataFrame, top: int | None = None) -> DataFrame:
    """(place, re, im) of the eigenvalues, largest first by length, then by real and imaginary part."""

    def work(w: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        x = np.linalg.eigvals(w).astype(complex)
        x = x[np.lexsort((-x.imag, -x.real, -np.round(np.abs(x), 12)))][:top]
        return pd.DataFrame({"place": np.arange(1, len(x) + 1), "re": x.real, "im": x.imag})

    return _on_matrix(matrix, work, "place int, re double, im double")


def _shared(w: np.ndarray) -> np.ndarray:
    """How much rows share their columns, without themselves."""
    s = w @ w.T
    np.fill_diagonal(s, 0)
    return s


def laplacian(matrix: DataFrame) -> DataFrame:
    """(place, value, id, x): the eigenvalues of degree minus affinity of what rows share, smallest first, with their vectors, each turned so that its largest entry is positive."""
    kind = dict(matrix.dtypes)["pre"]

    def work(w: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        s = _shared(w)
        values, vectors = np.linalg.eigh(np.diag(s.sum(1)) - s)
        vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(ids))]) if len(ids) else 1
        n = len(ids)
        return pd.DataFrame({"place": np.repeat(np.arange(1, n + 1), n), "value": np.repeat(values, n), "id": pd.Series(np.tile(ids, n), dtype=object), "x": vectors.T.ravel()})

    return _on_matrix(matrix, work, f"place int, value double, id {kind}, x double")


def spectral_clusters(matrix: DataFrame, least: int, most: int, seed: int, tries: int = 8) -> DataFrame:
    """(id, cluster): rows alike by the cosine of what they get, cut into as many clusters, within least..most, as the largest gap of the normalised Laplacian's spectrum tells. Clusters are named 0, 1, ... by their first row; the best of several starts counts."""
    kind = dict(matrix.dtypes)["pre"]

    def work(w: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        n = len(ids)
        length = np.linalg.norm(w, axis=1, keepdims=True)
        unit = w / np.where(length > 0, length, 1)
        a = np.clip(unit @ unit.T, 0, None)
        root = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        values, vectors = np.linalg.eigh(np.eye(n) - root[:, None] * a * root)
        low, high = min(least, n), min(most, n - 1)
        k = low + int(np.argmax(np.diff(values)[low - 1 : high])) if high >= low >= 1 else max(n, 1)
        x = vectors[:, :k]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng, best = np.random.default_rng(seed), (np.inf, np.zeros(n, int))
        for _ in range(tries if n else 0):
            centre = x[[rng.integers(n)]]
            while len(centre) < k:  # the next start far from those there are
                far = ((x[:, None] - centre) ** 2).sum(2).min(1)
                centre = np.vstack([centre, x[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)]])
            while True:
                near = ((x[:, None] - centre) ** 2).sum(2)
                mine = near.argmin(1)
                moved = np.array([x[mine == c].mean(0) if (mine == c).any() else centre[c] for c in range(k)])
                if np.allclose(moved, centre):
                    break
                centre = moved
            best = min(best, (float(near.min(1).sum()), mine), key=lambda t: t[0])
        first = {c: i for i, c in reversed(list(enumerate(best[1])))}
        name = {c: i for i, c in enumerate(sorted(first, key=first.get))}
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "cluster": [name[c] for c in best[1]]})

    return _on_matrix(matrix, work, f"id {kind}, cluster int")


def separability(matrix: DataFrame, labels: dict[str, int]) -> DataFrame:
    """(rows, rank, accuracy): the rank of the rows with a label (1 or -1), and how many of them a least-squares plane tells."""

    def work(w: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        at = [i for i, x in enumerate(ids) if x in labels]
        x, y = np.column_stack([w[at], np.ones(len(at))]), np.array([labels[ids[i]] for i in at], float)
        fit = np.linalg.lstsq(x, y, rcond=None)[0] if at else np.zeros(0)
        right = float(np.mean(np.where(x @ fit >= 0, 1, -1) == y)) if at else None
        return pd.DataFrame({"rows": [len(at)], "rank": [int(np.linalg.matrix_rank(w[at])) if at else 0], "accuracy": [right]})

    return _on_matrix(matrix, work, "rows int, rank int, accuracy double")


def in_plane(points: DataFrame, axes: list[str], dims: int = 2) -> dict[str, Column]:
    """Columns over points: place_1, place_2, ... along the first principal axes, `angle` in their plane, and `residual`, the share of the distance from the centre that lies outside it."""
    centre, vectors = plane(points, axes)
    away = [F.col(a) - F.lit(float(c)) for a, c in zip(axes, centre)]
    along = [sum((x * F.lit(float(v)) for x, v in zip(away, vec)), F.lit(0.0)) for vec in vectors[:dims]]
    whole, inside = sum((x * x for x in away), F.lit(0.0)), sum((x * x for x in along), F.lit(0.0))
    out = {f"place_{i + 1}": x for i, x in enumerate(along)}
    out["residual"] = F.coalesce(F.sqrt(F.greatest(whole - inside, F.lit(0.0)) / F.nullif(whole, F.lit(0.0))), F.when(whole.isNotNull(), 0.0))
    if dims >= 2:
        out["angle"] = F.atan2(along[1], along[0])
    return out


def matched_null(points: DataFrame, axes: list[str], samples: int, seed: int) -> DataFrame:
    """(sample, axes): for every point of every sample a normal one, turned and stretched so that each sample has the mean and the covariance of the points, exactly."""
    whole = points.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in axes)).select(*axes)

    def moments(rows: DataFrame, names: list[str], keys: list[str]) -> list:
        return rows.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in names], *[F.covar_pop(a, b).alias(f"{a}__{b}") for a in names for b in names]).collect()  # one row per sample

    square = lambda row, names: np.array([[row[f"{a}__{b}"] for b in names] for a in names], float)
    half = lambda m, power: (lambda v, q: (q * np.where(v > 1e-14 * max(v.max(), 1e-300), np.maximum(v, 1e-300) ** power, 0)) @ q.T)(*np.linalg.eigh(m))
    real = moments(whole, axes, [])[0]
    noise = [f"__ax_z{i}" for i in range(len(axes))]
    drawn = whole.select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), F.xxhash64(*axes).alias("h"), F.monotonically_increasing_id().alias("i"))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sample", "h", "i"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    normal = [F.sqrt(-2 * F.log(uniform(2 * k))) * F.cos(2 * np.pi * uniform(2 * k + 1)) for k in range(len(axes))]
    drawn = drawn.select("sample", *[x.alias(z) for x, z in zip(normal, noise)])
    turns = []
    for row in moments(drawn, noise, ["sample"]):
        turn = half(square(real, axes), 0.5) @ half(square(row, noise), -0.5)
        shift = np.array([real[a] for a in axes]) - turn @ np.array([row[z] for z in noise])
        turns.append((row["sample"], turn.ravel().tolist(), shift.tolist()))
    by_sample = points.sparkSession.createDataFrame(turns, "sample int, turn array<double>, shift array<double>")
    n = len(axes)
    made = [F.col("shift")[i] + sum((F.col("turn")[i * n + j] * F.col(noise[j]) for j in range(n)), F.lit(0.0)) for i in range(n)]
    return drawn.join(F.broadcast(by_sample), "sample").select("sample", *[x.alias(a) for x, a in zip(made, axes)])
