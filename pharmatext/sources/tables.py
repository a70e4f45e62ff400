"""Parquet tables as input of row-by-row work (tokenizing, page parsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASKS_PER_CORE = 2
#: File bytes worth one task: what a task makes of its texts (tokens, counts, pages) is many times their size.
TASK_BYTES = 8 * 1024 * 1024


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def spread(scan: DataFrame, key: str, n_bytes: int = 0) -> DataFrame:
    """Redistribute a plain file scan that gives fewer tasks than would keep the cores busy, or larger ones
    than ``TASK_BYTES`` of its ``n_bytes``.

    A small table is often one file with one row group, hence one task; of a large one a split holds too
    much for what is made of it. ``key`` is a unique column, and rows are dealt by it: so grouping by it and
    more needs no further shuffle.
    """
    wanted = max(TASKS_PER_CORE * scan.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, key)


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spread(spark.read.parquet(path), key, file_bytes(spark, path))


def spread_stream(arriving: DataFrame, key: str) -> DataFrame:
    """Each batch of a stream over all cores, whatever number of files it comes in."""
    return arriving.repartition(TASKS_PER_CORE * arriving.sparkSession.sparkContext.defaultParallelism, key)
