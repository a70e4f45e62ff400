"""Joins of a token-sized frame with a vocabulary-sized table.

Word frequencies follow a power law, so a plain shuffle join on the word puts a large share of all
rows in one task. The table is broadcast while its measured size is small; beyond that adaptive
execution splits the hot keys of a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pharmatext.plans.storage import materialize

BROADCAST_BYTES = 128 * 1024 * 1024
ROW_BYTES = 64  # what a row of a broadcast table needs beside its key


def table_size(table: DataFrame, key: str, row_bytes: int = ROW_BYTES) -> tuple[int, int]:
    """Measured rows and bytes of a table: the keys' own length and ``row_bytes`` for the rest."""
    size = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("b")).first()
    return size.n, (size.b or 0) + size.n * row_bytes


def join_table(
    rows: DataFrame, table: DataFrame, on: str, n_bytes: int, how: str = "left", limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` (large, skewed on ``on``) with ``table`` (unique on ``on``, ``n_bytes`` large).

    Beyond ``limit`` it is a shuffle join whose hot keys the engine splits at run time (adaptive
    execution): a part of the table is read again only where a split needs it.
    """
    return rows.join(F.broadcast(table) if n_bytes <= limit else table, on, how)


def join_measured(
    rows: DataFrame, table: DataFrame, on: str, how: str, limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``join_table`` with a table that is stored and measured first, so that it is computed once."""
    table = materialize(table, "join_side")
    return join_table(rows, table, on, table_size(table, on)[1], how, limit)
