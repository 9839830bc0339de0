import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonlake.operators import edges as E
from axonlake.operators import graph_iter as G
from axonlake.operators import power_blocks as P
from axonlake.operators import simulate as M
from axonlake.operators import spectral as X
from axonlake.plans import graph_search as Q

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (2, 9), (9, 4), (1, 2)]


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "pre long, post long, w long")


def reach(pairs, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_levels_and_paths(spark):
    e = graph(spark, EDGES)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {(r["id"], r["hop"], r["parent"]) for r in G.levels(e, ids(1), 2).collect()} == {(1, 0, None), (2, 1, 1), (3, 2, 2), (9, 2, 2)}
    assert [r["id"] for r in G.levels(e, ids(1), 5, limit=3).collect()] == [1, 2, 3]
    assert G.shortest_path(e, ids(1), ids(4)) == [1, 2, 3, 4] and G.shortest_path(e, ids(4), ids(1)) is None and G.shortest_path(e, ids(1, 4), ids(4)) == [4]


def test_components_and_scc(spark):
    rng = random.Random(5)
    for pairs in (EDGES, [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]):
        both = pairs + [(b, a) for a, b in pairs]
        nodes = {x for p in pairs for x in p}
        got = {r["id"]: r["comp"] for r in G.components(graph(spark, pairs)).collect()}
        assert got == {x: min(reach(both, {x})) for x in nodes}
        sccs = {frozenset(y for y in reach(pairs, {x}) if x in reach(pairs, {y})) for x in nodes}
        most = max(len(s) for s in sccs)
        scc = {r["id"] for r in G.largest_scc(graph(spark, pairs)).collect()}
        assert frozenset(scc) in sccs and len(scc) == most if most > 1 else not scc


def test_limits_raise(spark):
    chain = graph(spark, [(i, i + 1) for i in range(15)])
    ids = lambda x: spark.createDataFrame([(x,)], "id long")
    assert G.shortest_path(chain, ids(0), ids(15)) == list(range(16))
    for unfinished in (lambda: G.shortest_path(chain, ids(0), ids(15), 3), lambda: G.components(chain, 1), lambda: G.largest_scc(graph(spark, [(1, 2), (2, 1), (3, 4), (4, 3), (3, 5), (5, 3)]), 1)):
        with pytest.raises(RuntimeError):
            unfinished()


def test_whole_graph_queries(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(9)]
    monkeypatch.setattr(Q, "edges", lambda *_: graph(spark, pairs))  # all weights are 1
    monkeypatch.setattr(Q, "nodes", lambda *_: spark.createDataFrame([(100, "Kenyon_Cell", "left"), (pairs[0][0], "Kenyon_Cell", "right")], "id long, cell_class string, side string"))
    both = pairs + [(b, a) for a, b in pairs]
    got = {r["id"]: r["comp"] for r in Q.QUERIES["g5_all_components"](spark, "").collect()}
    assert got == {x: min(reach(both, {x})) for p in pairs for x in p}
    assert {(r["id"], r["hop"]) for r in Q.QUERIES["g1_all_levels"](spark, "").collect()} == {(100 + i, i) for i in range(10)}


def test_power(spark):
    rng = np.random.default_rng(1)
    w = rng.random((6, 6)) + 0.1
    e = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(6) for j in range(6)], "pre long, post long, w double")
    radius, _ = G.power_iteration(e, 60)
    assert radius == pytest.approx(max(abs(np.linalg.eigvals(w))), rel=1e-6)
    assert G.power_iteration(e.limit(0), 3)[0] == 0.0


def test_power_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 300), rng.integers(0, 37, 300), rng.random(300))]
    w = np.zeros((40, 40))
    for a, b, x in rows:
        w[b, a] += x
    used = sorted({x for r in rows for x in r[:2]})
    v, length = np.where(np.isin(np.arange(40), used), len(used) ** -0.5, 0), 0.0
    for _ in range(25):
        v = w @ v
        length = np.linalg.norm(v)
        v = v / length
    e = spark.createDataFrame([*rows, (1, 2, None), (None, 3, 5.0), (3, None, 5.0)], "pre long, post long, w double")
    for nodes, pairs, broadcast in ((3, 2, 0), (7, 100, 1000), (16, 5, 1000), (1000, 1000, 1000)):  # nodes of a block and section, pairs of a batch
        for name, value in (("BLOCK_NODES", nodes), ("BATCH_PAIRS", pairs), ("BROADCAST_NODES", broadcast)):
            monkeypatch.setattr(P, name, value)
        radius, got, _ = G.spectrum(e, 25, 0.0)
        assert radius == pytest.approx(length, rel=1e-12)
        assert {r["id"]: pytest.approx(r["x"], abs=1e-12) for r in got.collect()} == {i: v[i] for i in used}


def test_power_rounds_are_one_stage(spark):
    """A round shuffles nothing: it is one job of one stage."""
    e = spark.createDataFrame([(1, 2, 4.0), (2, 1, 1.0), (2, 3, 1.0)], "pre long, post long, w double")  # its length never stays
    sc = spark.sparkContext

    def stages(rounds):
        sc.setJobGroup(f"power-{rounds}", "")
        assert not G.spectrum(e, rounds)[2]
        return sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup(f"power-{rounds}"))

    try:
        assert stages(7) - stages(3) == 4
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_rounded_spectrum_in_few_stages(spark, monkeypatch):
    rng = np.random.default_rng(2)
    w = rng.integers(1, 9, (25, 25)) * (rng.random((25, 25)) < 0.4)
    monkeypatch.setattr(Q, "edges", lambda *_: spark.createDataFrame([(int(i), int(j), int(w[i, j])) for i, j in zip(*np.nonzero(w))], "pre long, post long, w long"))
    sc = spark.sparkContext
    sc.setJobGroup("rounded", "")
    try:
        rows = Q.QUERIES["g6_rounded"](spark, "").collect()
        stages = sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup("rounded"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    values, vectors = np.linalg.eig(w.T.astype(float))
    top = np.argmax(abs(values))
    assert {r["radius"] for r in rows} == {round(abs(values[top]), 4)}
    assert [r["x"] for r in sorted(rows)] == pytest.approx(list(abs(vectors[:, top].real)), abs=2e-5)
    assert stages < 80  # of them one for each of about 20 rounds


def test_rounded_shuffles_edges_once(spark, small):
    """Before the rounds there is one shuffle, by pair; ids are gathered and looked up in files."""
    plan = E.pairs(Q.edges(spark, small, "pre", "post"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    sc = spark.sparkContext
    sc.setJobGroup("rounded-small", "")
    try:
        assert Q.QUERIES["g6_rounded"](spark, small).count() == 213
        stages = sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup("rounded-small"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages < 40  # of them one for each of about 24 rounds


def test_pairs_by_runs_and_blocks(tmp_path, monkeypatch):
    rng, folder = np.random.default_rng(5), f"file://{tmp_path}"
    nodes = np.append(rng.integers(-(2**63), 2**63 - 1, 60), [-(2**63), -1, 0, 1, 2**63 - 1])
    want = {(int(a), int(b)): float(k) for k, (a, b) in enumerate(zip(rng.choice(nodes, 400), rng.choice(nodes[5:], 400)))}
    want[-1, -1] = -2.5  # a loop; and the first five nodes receive nothing
    columns = [*zip(*want), list(want.values())]
    batches = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pre", "post", "w"])
    monkeypatch.setattr(P, "RUN_PAIRS", 50)
    monkeypatch.setattr(P, "BATCH_PAIRS", 7)
    made = [r for b in P._runs((batches.slice(a, 30) for a in range(0, len(want), 30)), folder) for r in b.to_pylist()]
    runs, bounds = [r["path"] for r in made], [0, 0, 300, 310, 1024]  # the first block has no nodes
    ids, counts = zip(*[P._own_ids(runs, a, z, folder) for a, z in zip(bounds, bounds[1:])])
    own = [P._read(p, np.int64) for p in ids]
    assert len(runs) > 3 and counts[0] == 0 and sorted(np.concatenate(own).tolist()) == sorted({i for pair in want for i in pair})
    size, per = max(counts), 2
    for keep in (True, False):
        got = []
        for b in range(4):
            for section, path in P._cells(runs, bounds, b, ids, size, per, keep, folder):
                rows = pa.ipc.open_file(path.removeprefix("file://")).read_all().to_pylist()
                got += [((int(own[section * per + r["at"] // size][r["at"] % size]), int(own[b][r["local"]])), r["w"]) for r in rows]
        assert len(got) == len(want) and dict(got) == want


def test_whole_spectrum(spark, monkeypatch):
    rng = np.random.default_rng(4)
    w = np.zeros((30, 30))
    w[:29, :29] = rng.random((29, 29)) * (rng.random((29, 29)) < 0.3) + 0.01
    w[3, :29], w[29, 0] = 1e-4, 0.5  # little comes from node 3; node 29 has no input
    e = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "pre long, post long, w double")
    monkeypatch.setattr(Q, "edges", lambda *_: e)
    rows = Q.QUERIES["g6_radius"](spark, "").collect()
    values, vectors = np.linalg.eig(w.T)
    top = np.argmax(abs(values))
    want = abs(vectors[:, top].real)
    assert len(rows) == 30 and all(r["converged"] and r["radius"] == pytest.approx(abs(values[top]), rel=1e-9) for r in rows)
    assert [r["x"] for r in sorted(rows)] == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)
    assert not G.spectrum(e, 2)[2]


def test_edge_slices(spark):
    e = spark.createDataFrame([(1, 2, "a", 2), (1, 2, "b", 2), (2, 1, "a", 5), (3, 3, "a", 4), (4, 1, None, 9)], "pre long, post long, np string, w long")
    assert E.pairs(E.strong(e, 3)).count() == 3  # rows of 2 + 2 don't pass a threshold of 3 per row
    assert {tuple(r) for r in E.returned(e).collect()} == {(1, 2), (2, 1), (3, 3)}
    assert E.touching(e, spark.createDataFrame([(4,), (3,)], "id long")).count() == 2
    assert {r["id"]: (r["n_out"], r["n_in"]) for r in E.degrees(e).collect()}[1] == (2, 2)
    assert {r["post"]: r["pre"] for r in E.strongest(E.pairs(e), "post", "pre").collect()} == {2: 1, 1: 4, 3: 3}


def lif_plain(w, drive, steps, m=M.Membrane()):
    """One cell at a time, as the rule is stated."""
    n = len(drive)
    v, cur, wait, out = [np.float32(0)] * n, [np.float32(0)] * n, [0] * n, []
    for s in range(steps):
        cur = [np.float32(c + (-c / np.float32(5)) * np.float32(0.1)) for c in cur]
        free = [x == 0 for x in wait]
        v = [np.float32(v[i] + ((cur[i] + np.float32(drive[i]) - v[i]) / np.float32(10)) * np.float32(0.1)) if free[i] else v[i] for i in range(n)]
        fired = [i for i in range(n) if free[i] and v[i] >= 15]
        for i in fired:
            out.append((s, i))
            for j in range(n):
                cur[j] = np.float32(cur[j] + np.float32(w[j][i] * 0.5))
        for i in fired:
            v[i], wait[i] = np.float32(0), 20
        wait = [x - 1 if x > 0 else 0 for x in wait]
    return out


def test_spikes(spark):
    w = np.array([[0, 0, 0], [60, 0, -40], [0, 0, 0.0]])
    drive = [25.0, 0.0, 30.0]
    post, pre = np.nonzero(w)
    const = lambda x: np.full(3, x)
    wiring = M.Wiring(pre, post, w[post, pre], 3)
    got = M.Membrane().spikes(wiring, M.Drive(np.arange(3), const(0), const(0.0), const(100.0), np.array(drive), const(0.0)), 1, 100.0)
    want = lif_plain(w, drive, 1000)
    assert len(got) > 5 and [tuple(x[:2]) for x in got] == want
    # trials don't touch each other, and drives come and go: trial 1 has the first cell from 20 to 50 ms, growing, and again from 60 ms
    two = M.Drive(np.array([0, 1, 2, 0, 0]), np.array([0, 0, 0, 1, 1]), np.array([0.0, 0, 0, 20, 60]), np.array([100.0, 100, 100, 50, 100]), np.array([*drive, 10.0, 25.0]), np.array([0, 0, 0, 1.0, 0]))
    both = M.Membrane().spikes(wiring, two, 2, 100.0)
    assert [tuple(x[:2]) for x in both if x[2] == 0] == want
    v, ready, own = 0.0, 0, []
    for s in range(1000):
        outer = 10.0 + (s * 0.1 - 20) if 200 <= s < 500 else 25.0 if s >= 600 else 0.0
        if s >= ready:
            v += (outer - v) / 10 * 0.1
            if v >= 15:
                own.append(s)
                v, ready = 0.0, s + 20
    assert [x[0] for x in both if x[2] == 1 and x[1] == 0] == own and own
    with pytest.raises(M.CircuitTooLarge):
        M.Wiring(np.zeros(M.MAX_CIRCUIT_EDGES + 1, int), np.zeros(1, int), np.zeros(1), 1)
    gaps = np.diff([s for s, i in want if i == 0])
    assert min(gaps) >= 20
    e = spark.createDataFrame([("c", int(b), int(a), float(w[a, b])) for a, b in zip(post, pre)], "circuit string, pre long, post long, v double")
    d = spark.createDataFrame([("c", 0, 0, 0.0, 200.0, 25.0, 0.0)], "circuit string, trial int, id long, begin_ms double, end_ms double, level double, slope double")
    assert M.spike_trains(e, d.limit(0), "circuit").count() == 0
    assert M.spike_trains(e, d, "circuit").where("id = 0").count() > 3


def test_rewiring_keeps_degrees(spark):
    rng = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(200)) if a != b})
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "pre long, post long, w long")
    for block in (50_000, 20):  # in one block, and in several that change from round to round
        got = M.rewired(df, 3, seed=1, block_edges=block).collect()
        for s in range(3):
            mine = [(r["pre"], r["post"]) for r in got if r["sample"] == s]
            assert len(set(mine)) == len(pairs) and all(a != b for a, b in mine) and len(set(mine) & set(pairs)) < 0.7 * len(pairs)
            for k in (0, 1):
                assert sorted(p[k] for p in mine) == sorted(p[k] for p in pairs)
            assert sorted(r["w"] for r in got if r["sample"] == s) == list(range(len(pairs)))
    dealt = M.dealt_anew(df, "w", 3).collect()
    assert sorted((r["pre"], r["post"]) for r in dealt) == pairs and sorted(r["w"] for r in dealt) == list(range(len(pairs))) and sum(pairs[r["w"]] == (r["pre"], r["post"]) for r in dealt) < 20
    signs = [np.sign(r["w"]) for r in M.balanced_signs(df.where("w > 0"), "w", 3).collect()]
    assert abs(sum(signs)) <= 1 and len(signs) == len(pairs) - 1
    graphs = M.random_graphs(spark, 40, 300, 2, seed=1).collect()
    assert len({(r["sample"], r["pre"], r["post"]) for r in graphs}) == 600 and all(r["pre"] != r["post"] and 0 <= r["post"] < 40 and 0 <= r["pre"] < 40 for r in graphs)


def test_reservoir_and_readouts():
    rng = np.random.default_rng(2)
    w, inputs, pulses = rng.standard_normal((4, 4)), rng.standard_normal((4, 2)), rng.choice([-1, 1], (5, 2))
    got = M.leaky_states(0.7 * w, M.pulse_inputs(pulses, inputs, 2, 4, 0.5))
    x = np.zeros((4, 5))
    for t in range(4):
        u = np.zeros((4, 5))
        if t in (0, 2):
            p = pulses[:, t // 2]
            u = 0.5 * (np.outer(inputs[:, 0], np.maximum(p, 0)) + np.outer(inputs[:, 1], np.maximum(-p, 0)))
        x = 0.5 * x + 0.5 * np.tanh(0.7 * w @ x + u)
        if t in (0, 3):
            assert np.allclose(got[t], x)
    f, y = rng.standard_normal((30, 5)), rng.integers(0, 3, 30)
    a = M.ridge(f, y, 3, 1e-3)
    lam = 1e-3 * np.trace(f @ f.T) / 30
    assert np.allclose(a, np.linalg.solve(f.T @ f + lam * np.eye(5), f.T @ np.eye(3)[y]))
    wt, b = M.delta_rule(f, f @ np.arange(5) + 2, 0.1, 3000, 0)
    assert np.allclose(wt, np.arange(5), atol=1e-3) and b == pytest.approx(2, abs=1e-3)


def test_memory_grid_and_null(spark):
    rng = random.Random(2)
    circuit = spark.createDataFrame([(a, b, rng.gauss(0, 1)) for a in range(30) for b in range(30) if rng.random() < 0.2], "pre long, post long, v double")
    rows = M.memory_grid(circuit, 2, [2], sequences=60).collect()
    assert len(rows) == 2 and all(r["acc"] > r["chance"] for r in rows)
    with pytest.raises(M.CircuitTooLarge):
        M.memory_grid(circuit, 1, [2], max_cells=10)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 9.0), ("c", 1.0), ("a", None)], "g string, x double")
    diffs = [r["diff"] for r in M.permuted_differences(df, "g", "x", "a", "b", 400, 1).collect()]
    assert len(diffs) == 400 and set(np.round(diffs, 6)) <= {-4.0, 4.0, -3.0, 3.0} | {round(a, 6) for a in (1.5 - 5.5, 5.5 - 1.5, 5.0 - 2.0, 2.0 - 5.0)}


def test_permutation_in_blocks_and_strata(spark):
    rng = random.Random(5)
    data = [("ab"[rng.random() < 0.3], rng.choice("uvw"), float(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, s string, x double")
    sd = lambda xs: float(np.std(xs))
    x, is_a = np.array([r[2] for r in data]), np.array([r[0] == "a" for r in data])
    free = [np.mean(p[is_a]) - np.mean(p[~is_a]) for p in (np.random.default_rng(i).permutation(x) for i in range(400))]
    for block in (5, 10_000):
        diffs = [r["diff"] for r in M.permuted_differences(df, "g", "x", "a", "b", 400, 1, block_values=block).collect()]
        assert len(diffs) == 400 and abs(np.mean(diffs)) < 0.4 and sd(diffs) == pytest.approx(sd(free), rel=0.2)
    # strata that decide everything leave nothing to permute
    fixed = spark.createDataFrame([("a", "u", 1.0), ("b", "u", 1.0), ("a", "w", 5.0), ("a", "w", 5.0), ("b", "w", 5.0)], "g string, s string, x double")
    assert {round(r["diff"], 9) for r in M.permuted_differences(fixed, "g", "x", "a", "b", 50, 1, stratum="s").collect()} == {round(11 / 3 - 3, 9)}
    assert len({round(r["diff"], 9) for r in M.permuted_differences(fixed, "g", "x", "a", "b", 50, 1).collect()}) > 1


def test_spectra(spark):
    rng = np.random.default_rng(8)
    w = rng.standard_normal((6, 6))
    m = spark.createDataFrame([(f"n{j}", f"n{i}", float(w[i, j])) for i in range(6) for j in range(6)], "pre string, post string, v double")
    got = [complex(r["re"], r["im"]) for r in X.eigenvalues(m).orderBy("place").collect()]
    assert np.allclose(sorted(map(abs, got)), sorted(abs(np.linalg.eigvals(w)))) and X.eigenvalues(m, 2).count() == 2 and X.eigenvalues(m.limit(0)).count() == 0
    rows = X.laplacian(m).collect()
    s = w @ w.T - np.diag(np.diag(w @ w.T))
    lap = np.diag(s.sum(1)) - s
    for k in range(1, 7):
        v = np.array([r["x"] for r in sorted(rows, key=lambda r: r["id"]) if r["place"] == k])
        assert np.allclose(lap @ v, next(r["value"] for r in rows if r["place"] == k) * v)
    blocks = [(f"{g}{i}", f"{g}{j}", 5.0 + (i * j) % 3) for g in "xyz" for i in range(5) for j in range(5)] + [("x1", "y2", 0.1)]
    clusters = {r["id"]: r["cluster"] for r in X.spectral_clusters(spark.createDataFrame(blocks, m.schema), 2, 6, 1).collect()}
    assert {tuple(sorted({c for i, c in clusters.items() if i[0] == g})) for g in "xyz"} == {(0,), (1,), (2,)}
    r = X.separability(m, {"n0": 1, "n1": -1, "n2": 1}).first()
    assert (r["rows"], r["rank"], r["accuracy"]) == (3, 3, 1.0)


def test_planes_and_matched_nulls(spark):
    rng = np.random.default_rng(3)
    p = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 3)) + [5, 1, 2]
    df = spark.createDataFrame([tuple(map(float, r)) for r in p] + [(None, 1.0, 1.0)], "x double, y double, z double")
    c = X.in_plane(df, ["x", "y", "z"])
    got = np.array([tuple(r) for r in df.where("x IS NOT NULL").select(c["residual"], c["angle"]).collect()])
    away = p - p.mean(0)
    _, _, vt = np.linalg.svd(away)
    assert np.allclose(got[:, 0], np.linalg.norm(away - away @ vt[:2].T @ vt[:2], axis=1) / np.linalg.norm(away, axis=1))
    assert [r[0] for r in spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double").select(X.in_plane(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), ["x", "y"], 1)["residual"]).collect()] == [0.0] * 3
    null = X.matched_null(df, ["x", "y", "z"], 2, 5).toPandas()
    for s in (0, 1):
        mine = null[null["sample"] == s][["x", "y", "z"]].to_numpy()
        assert mine.shape == p.shape and np.allclose(mine.mean(0), p.mean(0)) and np.allclose(np.cov(mine.T), np.cov(p.T))


def test_plane(spark):
    rng = np.random.default_rng(3)
    p = rng.standard_normal((200, 3)) * [5, 2, 0.1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in p] + [(None, 1.0, 1.0)], "x double, y double, z double")
    _, axes = M.plane(df, ["x", "y", "z"])
    assert abs(axes[0][0]) > 0.95 and abs(axes[2][2]) > 0.99
