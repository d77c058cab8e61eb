"""Parquet tables, repeated deliveries, partition spread and the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key: the last delivery by `ts`, equal times decided by a hash of the row's other values.

    Rows with a null key are kept as one group per null key; a null `ts` loses against any time. Keys repeat a few
    times at most, so the window never sees a large group. Only the columns of `df` are read: select those needed first.
    """
    others = [f.name for f in df.schema if f.name not in keys and f.name != ts and f.dataType.typeName() != "map"]
    tie = [F.xxhash64(*others).desc()] if others else []
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), *tie)
    return df.withColumn("_latest_rn", F.row_number().over(w)).filter("_latest_rn = 1").drop("_latest_rn")


#: Bytes of (compressed) input a task gets before `spread` leaves the partitions as they are.
BYTES_A_TASK = 32 << 20


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """Round-robin over more tasks where a small input would leave cores idle; large inputs stay as they are.

    Decided by the plan's estimate of its size, which runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * BYTES_A_TASK:
        return df
    return df.repartition(factor * cores)


def is_local(spark: SparkSession) -> bool:
    """Whether all runs in one process on one machine."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not is_local(spark):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="velum-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def publish(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Writes `data` once into the shared folder and hands it to every executor, later ones included.

    Returns the name to pass to `SparkFiles.get` inside a task.
    """
    name = f"velum-{uuid.uuid4().hex}{suffix}"
    uri = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


_written: list[tuple[SparkSession, str]] = []


def _delete_written() -> None:
    """Deletes what `saved` wrote, when the driver ends: results that read it are lazy until then."""
    while _written:
        spark, uri = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001, S112 - the session is gone already
            continue


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_written)
    _written.append((spark, uri))
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
