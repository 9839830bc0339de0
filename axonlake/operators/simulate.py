"""Sequential models: spiking and rate dynamics of bounded circuits, and null models of whole graphs.

A circuit is what one group of an Arrow function holds, so its size is checked there: more than MAX_CIRCUIT_EDGES connections raise
CircuitTooLarge, and callers cut circuits first (a search with a limit, `graph_iter.levels`). All trials of a circuit run at once as
columns of one matrix. Null models have no such bound: rewiring works in blocks of the adjacency matrix that change from round to round,
deals and permutations go by distributed numbers or counts.

Defined cases: a circuit without connections or drives has no spikes; null ends, weights or values count as absent; repeated
connections add up; samples are numbered from 0 and repeat for the same seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.operators.dense_ids import dense_ids
from axonlake.sources.scratch import materialize

#: Connections of one circuit, which one task holds.
MAX_CIRCUIT_EDGES = 2_000_000
#: Edges of a block of the adjacency matrix that one task rewires.
BLOCK_EDGES = 50_000
#: Counts of (stratum, block) that go to all tasks of a permutation test.
MAX_BLOCKS = 100_000


class CircuitTooLarge(ValueError):
    """A circuit has more connections than a task may hold."""


class Wiring:
    """Connections grouped by their source, so that what a set of sources reaches is one gather."""

    def __init__(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray, n: int):
        if len(source) > MAX_CIRCUIT_EDGES:
            raise CircuitTooLarge(f"{len(source)} connections; cut the circuit to {MAX_CIRCUIT_EDGES}")
        order = np.argsort(source, kind="stable")
        self.n, self.target, self.weight = n, target[order], weight[order]
        self.fan = np.bincount(source, minlength=n)
        self.start = np.cumsum(self.fan) - self.fan

    def arrivals(self, cells: np.ndarray, trials: np.ndarray, n_trials: int) -> np.ndarray:
        """(cell, trial) sums of the weights that events (cell, trial) send out."""
        fan = self.fan[cells]
        which = np.repeat(self.start[cells] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        at = self.target[which] * n_trials + np.repeat(trials, fan)
        return np.bincount(at, self.weight[which], self.n * n_trials).reshape(self.n, n_trials)


@dataclass(frozen=True)
class Drive:
    """Outer current of a cell in a trial: level + slope * (t - begin) for begin <= t < end, in milliseconds. Drives of a cell add up."""

    cell: np.ndarray
    trial: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    level: np.ndarray
    slope: np.ndarray

    def phases(self, dt: float, steps: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first step, end step, indexes of the drives at work): stretches in which no drive begins or ends."""
        first, last = np.ceil(self.begin / dt - 1e-9).astype(int), np.ceil(self.end / dt - 1e-9).astype(int)
        marks = np.unique(np.clip(np.concatenate([[0, steps], first, last]), 0, steps))
        for a, b in zip(marks[:-1], marks[1:]):
            yield int(a), int(b), np.flatnonzero((first <= a) & (last >= b))


@dataclass(frozen=True)
class Membrane:
    """Leaky integrate-and-fire cells by Euler steps of dt milliseconds. Per step: current decays by dt / tau_synapse of itself; cells that are ready move
    by dt / tau_membrane of (current + drive - voltage); ready cells at the threshold fire: their weights times gain reach the targets' current, their voltage
    is 0, and they are ready again refractory / dt steps later."""

    dt: float = 0.1
    tau_membrane: float = 10.0
    tau_synapse: float = 5.0
    threshold: float = 15.0
    refractory: float = 2.0
    gain: float = 0.5

    def spikes(self, wiring: Wiring, drive: Drive, n_trials: int, duration: float) -> np.ndarray:
        """(step, cell, trial) of every spike."""
        shape, steps = (wiring.n, n_trials), int(round(duration / self.dt))
        keep, share, rest = 1 - self.dt / self.tau_synapse, self.dt / self.tau_membrane, max(1, int(round(self.refractory / self.dt)))
        current, voltage, ready_at = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)
        events = [np.zeros((0, 3), np.int64)]
        for a, b, on in drive.phases(self.dt, steps):
            level, slope = np.zeros(shape), np.zeros(shape)
            where = (drive.cell[on], drive.trial[on])
            np.add.at(level, where, drive.level[on] - drive.slope[on] * drive.begin[on])
            np.add.at(slope, where, drive.slope[on])
            for step in range(a, b):
                current *= keep
                pull = current + level + slope * (step * self.dt) - voltage
                voltage += np.where(ready_at <= step, share * pull, 0.0)
                cell, trial = np.nonzero((voltage >= self.threshold) & (ready_at <= step))
                if len(cell):
                    events.append(np.column_stack([np.full(len(cell), step), cell, trial]))
                    current += self.gain * wiring.arrivals(cell, trial, n_trials)
                    voltage[cell, trial], ready_at[cell, trial] = 0.0, step + rest
        return np.concatenate(events)


def spike_trains(edges: DataFrame, drives: DataFrame, circuit: str, duration: float = 200.0, membrane: Membrane = Membrane()) -> DataFrame:
    """(circuit, trial, id, t_ms) of every spike. edges: circuit, pre, post, v (signed weight); drives: circuit, trial INT, id, begin_ms, end_ms, level, slope."""
    kind = dict(edges.dtypes)[circuit]

    def simulate(key: tuple, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        e, d = e.dropna(subset=["pre", "post", "v"]), d.dropna()
        ids = np.unique(np.concatenate([e["pre"], e["post"], d["id"]]).astype(np.int64))
        trials = np.unique(d["trial"].to_numpy(np.int64))
        at = lambda x: np.searchsorted(ids, x.to_numpy(np.int64))
        wiring = Wiring(at(e["pre"]), at(e["post"]), e["v"].to_numpy(float), len(ids))
        columns = [d[c].to_numpy(float) for c in ("begin_ms", "end_ms", "level", "slope")]
        s = membrane.spikes(wiring, Drive(at(d["id"]), np.searchsorted(trials, d["trial"]), *columns), max(1, len(trials)), duration)
        return pd.DataFrame({circuit: pd.Series([key[0]] * len(s), dtype=object), "trial": trials[s[:, 2]] if len(trials) else [], "id": ids[s[:, 1]], "t_ms": np.round(s[:, 0] * membrane.dt, 3)})

    return edges.groupBy(circuit).cogroup(drives.groupBy(circuit)).applyInPandas(simulate, f"{circuit} {kind}, trial int, id long, t_ms double")


def rewired(pairs: DataFrame, samples: int, seed: int, rounds: int = 4, tries_per_edge: int = 3, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(sample, pre, post, w): random graphs with every cell's numbers of partners kept, of pairs (pre, post, w), each pair once.

    A round throws sources and targets into bands by a hash of its own; a block of the matrix is one band of sources times one of targets. Two
    edges of a block that exchange their targets stay in it, so whether the new edges exist already is known within the block. Exchanges that would
    repeat an edge or make a self-loop are left out. Weights are dealt anew within the blocks."""
    graph = pairs.where("pre IS NOT NULL AND post IS NOT NULL").select("pre", "post", F.col("w").cast("long").alias("w"))
    now = materialize(graph.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample"), "pre", "post", "w"), "rewired-0")
    bands = max(1, int(np.ceil(np.sqrt(now.count() / max(1, samples) / block_edges))))

    def exchange(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["pre", "post"])
        rng = np.random.default_rng([seed, *(int(k) for k in key)])
        ends = list(zip(block["pre"].tolist(), block["post"].tolist()))
        held = set(ends)
        for i, j in rng.integers(0, len(ends), (tries_per_edge * len(ends), 2)).tolist():
            (a, b), (c, d) = ends[i], ends[j]
            crossed = {(a, d), (c, b)}
            if a != d and c != b and len(crossed) == 2 and held.isdisjoint(crossed):
                held.difference_update((ends[i], ends[j]))
                held.update(crossed)
                ends[i], ends[j] = (a, d), (c, b)
        return pd.DataFrame({"sample": key[0], "pre": [e[0] for e in ends], "post": [e[1] for e in ends], "w": rng.permutation(block["w"].to_numpy())})

    for r in range(rounds):
        band = lambda c, side: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.lit(side), "sample", c), F.lit(bands)).cast("int")  # noqa: E731, B023
        cut = now.select("*", band("pre", 0).alias("__ax_i"), band("post", 1).alias("__ax_j"), F.lit(r).alias("__ax_r"))
        now = materialize(cut.groupBy("sample", "__ax_i", "__ax_j", "__ax_r").applyInPandas(exchange, "sample long, pre long, post long, w long"), f"rewired-{r + 1}")
    return now


def random_graphs(spark: SparkSession, nodes: int, edges: int, samples: int, seed: int) -> DataFrame:
    """(sample, pre, post): distinct random pairs without self-loops, `edges` of them for each sample where that many exist. Sources are drawn in parts of the pair numbers, so a large graph is made by many tasks: part k of p gets its share of the pairs."""
    whole = nodes * (nodes - 1)
    goal = min(edges, whole)
    parts = max(1, -(-goal // BLOCK_EDGES))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch["id"]:
                s, k = divmod(int(x), parts)
                low, high = whole * k // parts, whole * (k + 1) // parts
                want = goal * (k + 1) // parts - goal * k // parts
                rng, have = np.random.default_rng([seed, s, k]), np.zeros(0, np.int64)
                while len(have) < want:
                    have = np.union1d(have, rng.integers(low, high, 2 * (want - len(have)) + 8))
                have = rng.permutation(have)[:want]
                pre, rank = have // max(1, nodes - 1), have % max(1, nodes - 1)
                yield pd.DataFrame({"sample": s, "pre": pre, "post": rank + (rank >= pre)})  # the diagonal is left out

    return spark.range(samples * parts).repartition(min(samples * parts, 64)).mapInPandas(draw, "sample long, pre long, post long")


def _placed(edges: DataFrame, by: list, name: str) -> DataFrame:
    """edges with their place 0, 1, ... in the order of by, from a distributed sort and counts per partition."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__ax_pid"), F.monotonically_increasing_id().alias("__ax_at"))
    rows = materialize(rows.withColumn("__ax_at", F.col("__ax_at") - F.shiftleft(F.col("__ax_pid").cast("long"), 33)), "placed")
    counts = rows.groupBy("__ax_pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__ax_pid", (F.sum("n").over(Window.orderBy("__ax_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # one row per partition
    return rows.join(F.broadcast(before), "__ax_pid").withColumn(name, F.col("before") + F.col("__ax_at")).drop("__ax_pid", "__ax_at", "before")


def dealt_anew(edges: DataFrame, column: str, seed: int) -> DataFrame:
    """edges (pre, post, ...) with the values of column dealt to them anew: the k-th edge in one random order gets the value of the k-th in another."""
    rand = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "pre", "post")
    takes = _placed(edges.drop(column), [rand(0), "pre", "post"], "__ax_k")
    gives = _placed(edges.select("pre", "post", column), [rand(1), "pre", "post"], "__ax_k").select("__ax_k", column)
    return takes.join(gives, "__ax_k").select(*edges.columns)


def balanced_signs(edges: DataFrame, weight: str, seed: int) -> DataFrame:
    """edges with half of the weights, of edges taken at random, negative and the others positive; of an odd number one more is positive."""
    placed = _placed(edges, [F.xxhash64(F.lit(seed), "pre", "post"), "pre", "post"], "__ax_k")
    return placed.withColumn(weight, F.abs(weight) * F.when(F.col("__ax_k") % 2 == 0, 1).otherwise(-1)).select(*edges.columns)


def permuted_differences(values: DataFrame, group: str, value: str, a: str, b: str, samples: int, seed: int, stratum: str | None = None, block_values: int = 10_000) -> DataFrame:
    """(sample, diff): differences of the means of two groups after their labels are dealt out anew, within each stratum where one is given.

    Distinct values are counted and laid into blocks. How many of a stratum's a-labels fall to each block is a hypergeometric draw that every task makes from the
    blocks' sizes, which alone go to all tasks; which values of the block get them is drawn by the block's task from its own counts."""
    rows = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select((F.col(stratum).cast("string") if stratum else F.lit("")).alias("stratum"), F.col(value).cast("double").alias("x"), (F.col(group) == a).alias("is_a"))
    counts = materialize(rows.groupBy(F.coalesce("stratum", F.lit("")).alias("stratum"), "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_a").alias("n_a")), "value-counts")
    n_blocks = max(1, -(-counts.count() // block_values))
    blocked = counts.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(n_blocks)).cast("int"))
    sizes = blocked.groupBy("stratum", "block").agg(F.sum("n").alias("n"), F.sum("n_a").alias("n_a"), F.sum(F.col("n") * F.col("x")).alias("s")).orderBy("stratum", "block").limit(MAX_BLOCKS + 1).toPandas()
    if len(sizes) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks; enlarge block_values")
    all_n, all_a, all_sum = int(sizes["n"].sum()), int(sizes["n_a"].sum()), float(sizes["s"].sum())
    strata = {key: (rows_["block"].to_numpy(int), rows_["n"].to_numpy(int), int(rows_["n_a"].sum())) for key, rows_ in sizes.groupby("stratum")}
    order = {key: i for i, key in enumerate(sorted(strata))}

    def deal(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("x")
        x, n = mine["x"].to_numpy(float), mine["n"].to_numpy(int)
        blocks, n_of, labels = strata[key[0]]
        me = int(np.flatnonzero(blocks == key[1])[0])
        sums = []
        for s in range(samples):
            share = np.random.default_rng([seed, s, order[key[0]]]).multivariate_hypergeometric(n_of, labels)[me]
            sums.append(float(x @ np.random.default_rng([seed, s, order[key[0]], me + 1]).multivariate_hypergeometric(n, share, method="marginals")))
        return pd.DataFrame({"sample": range(samples), "s": sums})

    sums = blocked.groupBy("stratum", "block").applyInPandas(deal, "sample long, s double").groupBy("sample").agg(F.sum("s").alias("s"))
    if not 0 < all_a < all_n:
        return values.sparkSession.range(samples).select(F.col("id").alias("sample"), F.lit(0.0).alias("diff"))
    return sums.select("sample", (F.col("s") / all_a - (F.lit(all_sum) - F.col("s")) / (all_n - all_a)).alias("diff"))


def leaky_states(weights: np.ndarray, inputs: np.ndarray, leak: float = 0.5, start: np.ndarray | None = None) -> np.ndarray:
    """(step, cell, sequence): x(t) = (1 - leak) x(t-1) + leak tanh(weights x(t-1) + inputs(t)) for inputs (step, cell, sequence); x is 0 before the first step, or start."""
    states = np.zeros((len(inputs) + 1, *inputs.shape[1:]))
    if start is not None:
        states[0] = start
    for before, now, drive in zip(states[:-1], states[1:], inputs):
        np.tanh(weights @ before + drive, out=now)
        now += (1 - leak) / leak * before
        now *= leak
    return states[1:]


def pulse_inputs(pulses: np.ndarray, gates: np.ndarray, gap: int, steps: int, amplitude: float) -> np.ndarray:
    """(step, cell, sequence): pulse k of a sequence at step k * gap, amplitude times its size, by the first column of gates (cell, 2) if it's positive and by the second if negative."""
    drive = np.zeros((steps, len(gates), len(pulses)))
    at = np.arange(min(pulses.shape[1], -(-steps // gap)))
    sign = (pulses[:, at] < 0).astype(int)
    drive[at * gap] = amplitude * np.einsum("csk,sk->kcs", gates[:, sign], np.abs(pulses[:, at]))
    return drive


def ridge(train: np.ndarray, labels: np.ndarray, classes: int, lam: float) -> np.ndarray:
    """Weights of a linear readout (features times classes) by ridge regression; lam is relative to the mean squared length of a row."""
    target = np.eye(classes)[labels]
    kernel = train @ train.T
    scale = float(np.trace(kernel)) / max(1, len(kernel)) or 1.0
    return train.T @ np.linalg.solve(kernel + lam * scale * np.eye(len(kernel)), target)


def delta_rule(x: np.ndarray, y: np.ndarray, rate: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """A linear unit fitted by full-batch gradient descent from small random weights."""
    w, b = np.random.RandomState(seed).normal(0, 0.01, x.shape[1]), 0.0
    for _ in range(epochs):
        miss = y - x @ w - b
        w, b = w + rate * (miss @ x) / len(y), b + rate * float(miss.mean())
    return w, b


def memory_grid(circuit: DataFrame, seeds: int, lengths: list[int], max_cells: int = 500, sequences: int = 120, gap: int = 3) -> DataFrame:
    """(seed, k, chance, acc): how well a readout of the circuit (pre, post, v), scaled to spectral radius 1, tells the sum of k pulses of +1 and -1, the regularisation chosen on rows of its own. A circuit of more than max_cells cells raises."""
    spark = circuit.sparkSession
    ids = dense_ids(circuit.select(F.col("pre").alias("id")).unionAll(circuit.select("post")), "id")
    cells = ids.count()
    if cells > max_cells:
        raise CircuitTooLarge(f"{cells} cells; cut the circuit to {max_cells}")
    a, b = ids.select(F.col("id").alias("pre"), F.col("dense").alias("i")), ids.select(F.col("id").alias("post"), F.col("dense").alias("j"))
    e = circuit.join(a, "pre").join(b, "post").select("i", "j", F.col("v").cast("double").alias("v")).toPandas()  # at most max_cells squared
    w = np.zeros((cells, cells))
    np.add.at(w, (e["j"].to_numpy(int), e["i"].to_numpy(int)), e["v"].to_numpy(float))
    w /= max(1e-12, float(np.abs(np.linalg.eigvals(w)).max())) if cells else 1.0
    grid = spark.range(seeds).withColumnRenamed("id", "seed").crossJoin(spark.createDataFrame([(k,) for k in lengths], "k int"))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        seed, k = int(key[0]), int(key[1])
        rng = np.random.default_rng([seed, k])
        pulses = rng.choice([-1, 1], (3 * sequences, k))
        x = leaky_states(0.9 * w, pulse_inputs(pulses, rng.standard_normal((cells, 2)), gap, k * gap + 1, 0.5))[-1].T
        y = (pulses.sum(axis=1) + k) // 2
        part = [slice(i * sequences, (i + 1) * sequences) for i in range(3)]
        fits = [ridge(x[part[0]], y[part[0]], k + 1, lam) for lam in (1e-6, 1e-4, 1e-2, 1.0)]
        best = max(fits, key=lambda f: float((np.argmax(x[part[1]] @ f, axis=1) == y[part[1]]).mean()))
        acc = float((np.argmax(x[part[2]] @ best, axis=1) == y[part[2]]).mean())
        return pd.DataFrame({"seed": [seed], "k": [k], "chance": [1.0 / (k + 1)], "acc": [acc]})

    return grid.groupBy("seed", "k").applyInPandas(run, "seed long, k int, chance double, acc double")


def plane(points: DataFrame, axes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(centre, principal axes as rows, largest first) of points, from their sums of products; rows with a null don't count."""
    whole = points.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in axes))
    sums = whole.agg(*[F.avg(a).alias(a) for a in axes], *[F.covar_pop(a, b).alias(f"{a}__{b}") for a in axes for b in axes]).first()
    cov = np.array([[sums[f"{a}__{b}"] or 0.0 for b in axes] for a in axes])
    _, vectors = np.linalg.eigh(cov)
    return np.array([sums[a] or 0.0 for a in axes]), vectors.T[::-1]
