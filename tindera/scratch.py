"""Folders and tables for work in between, where all executors see them, and bounds of what a worker holds at once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one in local mode; a cluster without that setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tindera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
    return f"{root.rstrip('/')}/tindera-files/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table: computed once, and not again when an executor is lost."""
    path = scratch_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Bytes and rows in an Arrow batch at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't grow with its task or with long texts; only where the session hasn't set its own."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def free(name: str, *taken: list[str]) -> str:
    """A column's name that none of the lists has, upper and lower case alike."""
    low = {x.lower() for names in taken for x in names}
    while name.lower() in low:
        name += "_"
    return name
