"""Tables that cut a lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a session in this one process gets a folder of its own; a cluster has to set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="axonlake-")
        _delete_at_exit(spark, _own_roots[app])
    return _own_roots[app]


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is read no more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path not yet used, deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/axonlake/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df once and returns the written table, whose plan is a plain scan: it is never computed again, also after the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
