"""Scratch tables in the folder that all executors share, and small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode.

    A cluster that names no shared folder is an error: a machine-local folder
    would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_tindera_scratch", None)
    if made is None:
        made = spark.sparkContext._tindera_scratch = tempfile.mkdtemp(prefix="tindera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tindera/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    This cuts the lineage, computes the rows once and survives the loss of any
    executor.  Unlike ``checkpoint()`` it doesn't run the last stage twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system interface, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this library; only when no query is in use."""
    delete_path(spark, f"{scratch_root(spark)}/tindera")


#: Bytes and rows in an Arrow batch at most: what a worker holds at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill a worker; only where the session hasn't set its own."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: list[str]) -> str:
    """A column's name that is not taken; names that differ by case only count as one, as they do in Spark."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys named in a broadcast at most (16 MB of longs).
BROADCAST_KEYS = 2_000_000


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (a null key never is); broadcast if these are few enough."""
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_anti")
