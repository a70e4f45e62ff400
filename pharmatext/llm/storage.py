"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the session's shared folder. Only a local session may do without the setting."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="pharmatext-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open and not lasting:
        _open[-1].append(path)
    return path


#: Paths of the tables that open scopes will remove.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A step whose tables go when it ends, but for those written as ``lasting``: the step's result must
    read no others."""
    _open.append([])
    try:
        yield
    finally:
        for name in _open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written once and read back: later steps re-read it if an executor is lost. A ``lasting``
    table outlives the scope that it is made in."""
    path = shared_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``written`` made, once no step reads it any more."""
    spark = table.sparkSession
    for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` (in any case) begins with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    """Number of shuffle tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver has collected
    the frames that made them, which long jobs can't wait for."""
    for _ in range(2):  # what the first round frees on one side the second finds free on the other
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs started inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers by ``rows`` at a time, unless the session asks for less: at the
    engine's own 10,000 a batch of long texts would take more memory than the work on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
