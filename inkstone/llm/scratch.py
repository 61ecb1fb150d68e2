"""Tables written to the folder that driver and executors share.

A written table cuts lineage: it survives lost executors, and a join over two of them reads plain
exchanges, whose skewed partitions the engine can split. Tables are removed by drop(), or else when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, where their number is known.
FILE_ROWS = 1 << 13
#: Bytes of a batch for Python, within narrow().
NARROW, _NARROW_KEY = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where that is unset a local master gets a folder of the process's own; on a cluster, whose machines wouldn't share it, this is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "at" not in _own:
        keeper = tempfile.TemporaryDirectory(prefix="inkstone-")
        atexit.register(keeper.cleanup)
        _own["at"] = keeper.name
    return "file://" + _own["at"]


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def keep(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Write df under the shared folder and read it back with the same schema.

    most: a bound on its rows, if known. A small table then has a file for each FILE_ROWS of them (two for each core at least), not one for each
    partition of the exchange before it: some stores start several processes for a file.
    """
    spark, seen = df.sparkSession, getattr(df, "_inkstone_seen", None)
    if most is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
    at = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    store, path = _path(spark, at)
    store.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._inkstone_path, out._inkstone_seen = at, seen
    return out


def counted(df: DataFrame, where: Column | None = None) -> DataFrame:
    """df, for keep(): its rows, or those where a condition holds, are counted as they are written. rows() gives their number without another job."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("rows"))
    out._inkstone_seen = seen
    return out


def rows(df: DataFrame) -> int:
    """What was counted while df, counted(), was kept."""
    return df._inkstone_seen.get["rows"]


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage after many small jobs.

    Their plans go, with what they broadcast and the shuffle files that wait for it, and its heap, which grows while jobs are planned, shrinks to what is in use.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def narrow(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send Python functions batches of NARROW bytes (or one longer row), not of 10000 rows whatever their size.

    All rows still go there; of each batch there are copies in the executor and in its worker. For functions that give the same for any batches.
    """
    before = spark.conf.get(_NARROW_KEY, None)
    spark.conf.set(_NARROW_KEY, str(NARROW))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_NARROW_KEY)
        else:
            spark.conf.set(_NARROW_KEY, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """df itself if its rows come in one order whenever a task is repeated (it exchanges nothing), else df written and read back."""
    return keep(df, label) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def drop(df: DataFrame) -> None:
    """Remove what keep() wrote; df must not be read afterwards."""
    at = getattr(df, "_inkstone_path", None)
    if at:
        store, path = _path(df.sparkSession, at)
        store.delete(path, True)
