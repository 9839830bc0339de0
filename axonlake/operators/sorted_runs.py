"""Consolidation of very many small sorted files into few well-sized ones by an external k-way merge per key range.

1. Each input task sorts what it reads, which gives long sorted runs on the shared file system. Runs of more than FAN_IN files are
   merged in groups into longer ones until at most FAN_IN are left.
2. Every INDEX_ROWS-th row of a run goes into an index, from which key ranges of about `target_bytes` are cut. The cut includes the file
   number, so copies of one record, however many, may lie in several ranges.
3. Each range is merged by a task that reads its stretch of every run block by block, a heap of the runs' next rows giving the smallest:
   a task holds one block per run, whatever the range's size. Copies stay, numbered `copy_no` 0, 1, ... in the order of file numbers;
   output files are rolled when the first copies in them reach `target_bytes`.
4. The range metadata (first and last key, rows, bytes of each output file) tells which ranges go on with the key of an earlier range;
   the copies there are no first copies, and the metadata is put right.

`Store` keeps the result under a path: a folder per version with the merged files and, written last, their metadata. A new delivery is
merged with the files of the latest version, whose rows are sorted runs already, into the next one; readers see a version when its
metadata is complete, so a job that dies leaves the store as it was.

Runs and merged files are read by pyarrow in the tasks, so their path must be of a file system it knows (file, hdfs, s3, gs, abfs).
Defined cases: a null key is not a record and is dropped; equal (key, file) rows are copies of each other; an empty table gives empty
results; a key longer than `target_bytes` gets a file of its own.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.sources.scratch import materialize, new_path

BLOCK_ROWS = 4096
INDEX_ROWS = 1024
#: Sorted files that are merged at a time.
FAN_IN = 256
_ROW = "key string, file_id long, n_bytes int"
Row = tuple[str, int, int]


def stretch(path: str, low: tuple[str, int] | None, high: tuple[str, int] | None, block: int = BLOCK_ROWS) -> Iterator[Row]:
    """The rows (key, file_id, n_bytes) of a sorted file with low <= (key, file_id) < high, read block by block; row groups outside are passed over by their statistics."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        file = pq.ParquetFile(f)
        at = file.schema_arrow.get_field_index("key")
        groups = []
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(at).statistics
            known = stats is not None and stats.has_min_max
            if not known or ((low is None or stats.max >= low[0]) and (high is None or stats.min <= high[0])):
                groups.append(g)
        for batch in file.iter_batches(block, row_groups=groups, columns=["key", "file_id", "n_bytes"]):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "file_id", "n_bytes"))))
            first = 0 if low is None else bisect.bisect_left(rows, low, key=lambda r: r[:2])
            end = len(rows) if high is None else bisect.bisect_left(rows, high, key=lambda r: r[:2])
            yield from rows[first:end]
            if end < len(rows):
                return


def merge_runs(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """The rows of all sorted runs in order. A heap holds the next row of each run."""
    heap = []
    for k, run in enumerate(runs):
        for row in run:
            heap.append((row, k, run))
            break
    heapq.heapify(heap)
    while len(heap) > 1:
        row, k, run = heap[0]
        yield row
        for following in run:
            heapq.heapreplace(heap, (following, k, run))
            break
        else:
            heapq.heappop(heap)
    for row, _, run in heap:
        yield row
        yield from run


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, BLOCK_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def _numbered(rows: Iterator[Row], range_id: int, target_bytes: int) -> Iterator[tuple]:
    """Rows with copy_no, range_id and part_no."""
    last_key, copy, done, part = None, -1, 0, 0
    for key, file_id, size in rows:
        if key == last_key:
            copy += 1
        else:
            copy, last_key, part = 0, key, done // target_bytes
            done += size
        yield key, file_id, size, copy, range_id, part


def _merge_ranges(paths: list[str], target_bytes: int):
    schema = pa.schema([("key", pa.string()), ("file_id", pa.int64()), ("n_bytes", pa.int32()), ("copy_no", pa.int64()), ("range_id", pa.int32()), ("part_no", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low = None if r["low_key"] is None else (r["low_key"], r["low_file"])
                high = None if r["high_key"] is None else (r["high_key"], r["high_file"])
                yield from _batches(_numbered(merge_runs([stretch(p, low, high) for p in paths]), r["range_id"], target_bytes), schema)

    return merge


def _merge_groups(paths: list[str], fan_in: int):
    schema = pa.schema([("key", pa.string()), ("file_id", pa.int64()), ("n_bytes", pa.int32())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                yield from _batches(merge_runs([stretch(p, None, None) for p in paths[g * fan_in : (g + 1) * fan_in]]), schema)

    return merge


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, INDEX_ROWS):
            part = batch.slice(i, INDEX_ROWS)
            yield pa.RecordBatch.from_pydict({"key": part["key"].slice(0, 1), "file_id": part["file_id"].slice(0, 1), "n_bytes": pa.array([sum(part["n_bytes"].to_pylist())], pa.int64())})


@dataclass(frozen=True)
class Consolidated:
    """merged: key, file_id, n_bytes, copy_no, range_id, part_no, in order within each output file; continued: (range_id, key) of the ranges that begin with a key of an earlier range; files: the metadata of the output files."""

    merged: DataFrame
    continued: DataFrame
    files: DataFrame

    def firsts(self) -> DataFrame:
        """Every distinct record once, with the smallest file that holds it."""
        m, c = self.merged.where(F.col("copy_no") == 0).alias("m"), self.continued.alias("c")
        return m.join(c, (F.col("m.range_id") == F.col("c.range_id")) & (F.col("m.key") == F.col("c.key")), "left_anti")


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_ROW).parquet(*paths) if paths else spark.createDataFrame([], _ROW)


def _ends(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(continued, files) of the merged rows."""
    ends = merged.groupBy("range_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    begun = ends.groupBy(F.col("last_key").alias("key")).agg(F.min("range_id").alias("begun"))
    continued = ends.join(begun, (ends["first_key"] == begun["key"]) & (begun["begun"] < ends["range_id"])).select("range_id", "key")
    stats = merged.join(continued.withColumn("goes_on", F.lit(True)), ["range_id", "key"], "left")
    first = (F.col("copy_no") == 0) & F.col("goes_on").isNull()
    files = stats.groupBy("range_id", "part_no").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n_copies"),
        F.count(F.when(first, 1)).alias("n_records"), F.coalesce(F.sum(F.when(first, F.col("n_bytes"))), F.lit(0)).alias("n_bytes"),
    )
    return continued, files


def consolidate(records: DataFrame, target_bytes: int, path: str | None = None, more_runs: list[str] = (), fan_in: int = FAN_IN) -> Consolidated:
    """records: key STRING (in which equal records are equal), file_id LONG. The merged files are written under path, if given, else for this session only; more_runs are sorted files of (key, file_id, n_bytes) that take part."""
    spark = records.sparkSession
    runs = records.where(F.col("key").isNotNull()).select("key", F.col("file_id").cast("long").alias("file_id"))
    runs = materialize(runs.select("*", F.octet_length("key").alias("n_bytes")).sortWithinPartitions("key", "file_id"), "sorted-runs")
    paths = [*runs.inputFiles(), *more_runs]
    while len(paths) > fan_in:  # driver: one path per sorted file
        groups = math.ceil(len(paths) / fan_in)
        longer = spark.range(0, groups, 1, groups).mapInArrow(_merge_groups(paths, fan_in), _ROW)
        paths = materialize(longer, "longer-runs").inputFiles()
    index = materialize(_rows(spark, paths).mapInArrow(_index, "key string, file_id long, n_bytes long"), "run-index")
    total = index.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    ranges = max(1, math.ceil(total / target_bytes))
    lows = index.repartitionByRange(ranges, "key", "file_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "file_id")).alias("low"))
    order = Window.orderBy("low")  # one row per range
    cut = lows.select(F.row_number().over(order).alias("r"), "low", F.lead("low").over(order).alias("high"))
    low = lambda c: F.when(F.col("r") > 1, F.col(f"low.{c}"))
    cut = cut.select((F.col("r") - 1).cast("int").alias("range_id"), low("key").alias("low_key"), low("file_id").alias("low_file"), F.col("high.key").alias("high_key"), F.col("high.file_id").alias("high_file"))
    cut = materialize(cut, "ranges").repartition(ranges, "range_id")
    merged = cut.mapInArrow(_merge_ranges(paths, target_bytes), f"{_ROW}, copy_no long, range_id int, part_no long")
    if path is None:
        merged = materialize(merged, "consolidated", ["range_id", "part_no"])
    else:
        schema = merged.schema
        merged.write.partitionBy("range_id", "part_no").parquet(path)
        merged = spark.read.schema(schema).parquet(path)
    return Consolidated(merged, *_ends(merged))


class Store:
    """Consolidated records under a path, version by version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "store")

    def _entries(self, path: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [e.getPath().getName() for e in fs.listStatus(p)] if fs.exists(p) else []

    def _complete(self) -> list[int]:
        found = [int(m[1]) for e in self._entries(self.path) if (m := re.fullmatch(r"v(\d+)", e))]
        return sorted(v for v in found if "_SUCCESS" in self._entries(f"{self.path}/v{v}/files"))

    def latest(self) -> int | None:
        """The highest version whose metadata is complete."""
        return max(self._complete(), default=None)

    def read(self, version: int | None = None) -> Consolidated:
        v = self.latest() if version is None else version
        base = f"{self.path}/v{v}"
        merged = self.spark.read.schema(f"{_ROW}, copy_no long, range_id int, part_no long").parquet(f"{base}/data")
        return Consolidated(merged, *(self.spark.read.parquet(f"{base}/{x}") for x in ("continued", "files")))

    def deliver(self, records: DataFrame, target_bytes: int) -> Consolidated:
        """Merges records into the store; the version before the last one is deleted."""
        kept = self._complete()
        was = kept[-1] if kept else None
        old = self.read(was).merged.inputFiles() if was is not None else []
        started = [int(m[1]) for e in self._entries(self.path) if (m := re.fullmatch(r"v(\d+)", e))]
        v = max(started, default=0) + 1  # past unfinished ones too
        got = consolidate(records, target_bytes, f"{self.path}/v{v}/data", old)
        got.continued.write.parquet(f"{self.path}/v{v}/continued")
        got.files.write.parquet(f"{self.path}/v{v}/files")  # last: makes the version visible
        for x in kept[:-1]:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{x}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return self.read(v)
