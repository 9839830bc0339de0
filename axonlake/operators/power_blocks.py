"""Power iteration over blocks of a weight matrix.

A node's bucket is a hash of its id, and a block is a range of buckets, so hubs whose ids are close lie in different ones. Pairs are summed once, in a
shuffle by pair, and the tasks that sum them write them as runs, sorted by the bucket of the receiving node, with the ids that occur. A task per block
gathers its ids from the runs; a node's place is the one among them in order. A second one looks up the places of its pairs' ends and writes
an Arrow file for each section of sending nodes. A round is one job of a task per block: it reads
its files batch by batch, and the vector a section at a time, and writes its block of the next vector; only paths and one sum of squares
a block come to the driver, and no rows are shuffled. A vector is deleted when the next one has been written.

Files are read and written by pyarrow in the tasks, so the shared folder must be of a file system it knows (file, hdfs, s3, gs, abfs).
A task writes to a path of its own, so a repeated one changes no file that is read. Defined cases: ids are LONG; null ends are no pairs; a null weight
counts as 0; an empty table gives radius 0 and no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonlake.sources.scratch import delete, materialize, new_path

#: Nodes of a section of the vector, which a task holds at a time.
BLOCK_NODES = 4_000_000
#: Ids that a task gathers for its block, before repeats are dropped, about; as long as there are fewer blocks than buckets.
BLOCK_IDS = 8_000_000
#: Pairs of a run, and those whose places are looked up at a time.
RUN_PAIRS = 1 << 21
#: Pairs that a task reads at a time in a round.
BATCH_PAIRS = 1 << 19
#: Nodes whose ids a task keeps while it looks up places; above, it reads a block's ids anew for each RUN_PAIRS pairs.
BROADCAST_NODES = 1_000_000
BUCKETS = 1024  # more than blocks; the shift in _buckets goes with it
_HEAD = 2 * (BUCKETS + 1) * 8
_PAIR = pa.schema([("local", pa.int32()), ("at", pa.int32()), ("w", pa.float64())])


def _buckets(ids: np.ndarray) -> np.ndarray:
    """The upper bits of the ids' hashes (the final mix of murmur3)."""
    h = ids.view(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(54)).astype(np.uint16)


def _sorted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order of ids by bucket, where each bucket begins and the last ends)."""
    b = _buckets(ids)
    return np.argsort(b, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(b, minlength=BUCKETS))])


def _write(folder: str, *arrays: np.ndarray) -> str:
    """The path of a new file of the arrays' bytes."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{root}/{name}") as f:
        for a in arrays:
            f.write(a.tobytes())
    return f"{folder}/{name}"


def _runs(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes pairs (pre, post, w) as files of where buckets begin, of pairs and of ids; then the pairs by bucket of post, and their distinct ids by bucket. Gives (path, number of ids)."""
    held, rows, done = [], 0, []

    def flush() -> None:
        nonlocal held, rows
        if rows:
            pre, post, w = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            ids = pc.unique(pa.array(np.concatenate([pre, post]))).to_numpy()
            (order, at), (id_order, id_at) = _sorted(post), _sorted(ids)
            done.append((_write(folder, at, id_at, post[order], pre[order], w[order], ids[id_order]), len(ids)))
        held, rows = [], 0

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN_PAIRS:
            flush()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ([], []), (pa.string(), pa.int64()))], ["path", "ids"])


def _of_run(path: str, low: int, high: int, ids: bool) -> list[np.ndarray]:
    """[ids], or [post, pre, w], of the buckets low to high - 1."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        starts = np.frombuffer(f.read_at(_HEAD, 0), np.int64).reshape(2, -1)
        a, z, n = (int(x) for x in (starts[int(ids), low], starts[int(ids), high], starts[0, -1]))
        kinds, base = ([np.int64], 3 * n) if ids else ([np.int64, np.int64, np.float64], 0)
        return [np.frombuffer(f.read_at((z - a) * 8, _HEAD + (base + k * n + a) * 8), kind) for k, kind in enumerate(kinds)]


def _own_ids(runs: list[str], low: int, high: int, folder: str) -> tuple[str, int]:
    """Writes the ids of a block's buckets, once each and in order; (path, number)."""
    own = np.unique(np.concatenate([np.empty(0, np.int64), *(_of_run(p, low, high, True)[0] for p in runs)]))
    return _write(folder, own), len(own)


def _cells(runs: list[str], bounds: list[int], b: int, ids: list[str], size: int, per: int, keep: bool, folder: str) -> list[tuple[int, str]]:
    """Writes the pairs of block b, as places in it and in the sender's section, to a file for each section; [(section, path)]."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    blocks, kept, out = len(ids), {}, {}
    block_of = np.repeat(np.arange(blocks, dtype=np.uint16), np.diff(bounds))

    def ids_of(c: int) -> np.ndarray:
        if c not in kept:
            got = _read(ids[c], np.int64)
            if not keep:
                return got
            kept[c] = got
        return kept[c]

    own, held, rows = _read(ids[b], np.int64), [], 0

    def flush() -> None:
        nonlocal held, rows
        if rows:
            post, pre, w = (np.concatenate(x) for x in zip(*held))
            sender = block_of[_buckets(pre)]
            order = np.argsort(sender, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(sender, minlength=blocks))]).tolist()
            pre, local, w = pre[order], np.searchsorted(own, post)[order].astype(np.int32), w[order]
            at = np.concatenate([c % per * size + np.searchsorted(ids_of(c), pre[cut[c] : cut[c + 1]]) for c in range(blocks) if cut[c] < cut[c + 1]]).astype(np.int32)
            for s in range(-(-blocks // per)):
                last = cut[min(blocks, (s + 1) * per)]
                for a in range(cut[s * per], last, BATCH_PAIRS):
                    if s not in out:
                        name = uuid.uuid4().hex
                        sink = fs.open_output_stream(f"{root}/{name}")
                        out[s] = f"{folder}/{name}", sink, pa.ipc.new_file(sink, _PAIR)
                    z = min(last, a + BATCH_PAIRS)
                    out[s][2].write_batch(pa.RecordBatch.from_arrays([pa.array(x[a:z]) for x in (local, at, w)], schema=_PAIR))
        held, rows = [], 0

    for path in runs:
        held.append(_of_run(path, bounds[b], bounds[b + 1], False))
        rows += len(held[-1][0])
        if rows >= RUN_PAIRS:
            flush()
    flush()
    for _, sink, writer in out.values():
        writer.close()
        sink.close()
    return [(s, path) for s, (path, _, _) in out.items()]


def _read(path: str, kind: type = np.float64) -> np.ndarray:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def _multiplied(cells: list[tuple[int, str]], size: int, per: int, start: float, vector: list[str], length: float) -> np.ndarray:
    """A block of the next vector, from its cells (section, path), the files of the vector's blocks (none in the first round, when every entry is start), and the vector's length."""
    y, have = np.zeros(size), None
    for section, path in sorted(cells):
        if section != have:
            x, have = np.concatenate([_read(p) for p in vector[section * per : (section + 1) * per]]) / length if vector else np.full(per * size, start), section
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            file = pa.ipc.open_file(f)
            for k in range(file.num_record_batches):
                local, at, w = (c.to_numpy() for c in file.get_batch(k).columns)
                y += np.bincount(local, weights=w * x[at], minlength=size)
    return y


def power_blocks(edges: DataFrame, rounds: int, tolerance: float) -> tuple[float, DataFrame, bool]:
    """(spectral radius, (id, x), converged): v[post] = sum w * v[pre] over the edges (pre, post, w), scaled to length 1 each round, until the length stays. x is 0 where nothing arrives."""
    spark = edges.sparkSession
    folder = new_path(spark, "power")
    pairs = edges.where("pre IS NOT NULL AND post IS NOT NULL").groupBy(F.col("pre").cast("long").alias("pre"), F.col("post").cast("long").alias("post")).agg(F.coalesce(F.sum("w").cast("double"), F.lit(0.0)).alias("w"))
    written = pairs.mapInArrow(lambda batches: _runs(batches, f"{folder}/runs"), "path string, ids long").collect()  # runs of a task's pairs
    runs, width = [r["path"] for r in written], max(1, spark.sparkContext.defaultParallelism)
    blocks = min(BUCKETS, width * max(1, -(-sum(r["ids"] for r in written) // (BLOCK_IDS * width))))  # all tasks of a job run at once, or in full turns
    bounds = [BUCKETS * b // blocks for b in range(blocks + 1)]
    each = spark.sparkContext.parallelize(range(blocks), blocks)  # a job of few tasks starts in half the time that one of a DataFrame takes
    ids, counts = zip(*each.map(lambda b: _own_ids(runs, bounds[b], bounds[b + 1], f"{folder}/ids")).collect())
    n, size = sum(counts), max(1, *counts)  # vectors of blocks are of one size; the places past a block's last node are never sent from and stay 0
    per, start, keep = max(1, BLOCK_NODES // size), 1.0 / max(1, n) ** 0.5, n <= BROADCAST_NODES
    cells = each.map(lambda b: _cells(runs, bounds, b, ids, size, per, keep, f"{folder}/cells")).collect()  # blocks times sections
    delete(spark, f"{folder}/runs")

    def turn(vector: list[str], length: float, to: str) -> tuple[list[str], float]:
        def take(b: int) -> tuple[str, float]:
            y = _multiplied(cells[b], size, per, start, vector, length)
            return _write(to, y), float(y @ y)

        paths, squares = zip(*each.map(take).collect())
        return list(paths), sum(squares) ** 0.5

    vector, scale, radius, done, old = [], 1.0, 0.0, False, None
    for k in range(rounds):
        y, length = turn(vector, scale, f"{folder}/vector-{k}")
        if not length:
            radius, done = 0.0, True
            break
        done = abs(length - radius) <= tolerance * length
        if old:
            delete(spark, old)
        old = f"{folder}/vector-{k}"
        vector, scale, radius = y, length, length
        if done:
            break

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                own = _read(ids[b], np.int64)
                x = _read(vector[b]) / scale if vector else np.full(size, start)
                for a in range(0, len(own), BATCH_PAIRS):
                    part = own[a : a + BATCH_PAIRS]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(x[a : a + len(part)])], ["id", "x"])

    found = materialize(spark.range(0, blocks, 1, blocks).mapInArrow(entries, "id long, x double"), "power-vector")
    delete(spark, folder)
    return radius, found, done
