"""Positions in a sorted order without sorting one group in one task.

A window without (or with a coarse) partition key runs in a single task. Here the rows are
range-partitioned by (group, order), sorted inside their partition and stored with their place in
it; what is missing is only how many rows of the group lie in earlier partitions, which a table of
one row per (group, partition) tells. A group that holds most rows is spread over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pharmatext.plans.joins import BROADCAST_BYTES, table_size
from pharmatext.plans.storage import materialize


def with_rank(
    df: DataFrame, by: str | list[str | Column], within: list[str] | None = None,
    name: str = "rank", total: str | None = None, slices: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the 0-based position of each row by ``by`` (unique) inside its ``within`` group.

    ``total`` names an optional column with the group's row count. One shuffle of the rows; the
    result reads a stored table, so it is cheap to use more than once. ``slices`` is the number of
    range partitions (the session's shuffle partitions if not given).
    """
    within, order = within or [], [by] if isinstance(by, str) else list(by)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in within]
    ordered = df.repartitionByRange(n, *within, *order).sortWithinPartitions(*within, *order)
    # Within a partition the generated ids are consecutive and follow the sort.
    stored = materialize(ordered.select(
        "*", F.concat_ws("\u0001", *parts).alias("_group"), F.spark_partition_id().alias("_slice"),
        F.monotonically_increasing_id().alias("_at")), "ranked")
    cells = stored.groupBy("_group", "_slice").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_group")
    before = F.sum("_n").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    shifts = materialize(cells.select(
        "_group", "_slice", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias("_total")), "rank_shifts")
    if table_size(shifts, "_group")[1] <= limit:
        shifts = F.broadcast(shifts)
    extra = [(F.col("_at") + F.col("_shift")).cast("bigint").alias(name)]
    if total:
        extra.append(F.col("_total").cast("bigint").alias(total))
    return stored.join(shifts, ["_group", "_slice"]).select(*df.columns, *extra)


def with_global_rank(
    df: DataFrame, first: str, by: str, descending: bool = False, name: str = "rank",
    slices: int | None = None,
) -> DataFrame:
    """0-based position by (``first``, ``by``) over the whole frame."""
    lead = F.col(first).desc() if descending else F.col(first)
    return with_rank(df, [lead, F.col(by)], name=name, slices=slices)
