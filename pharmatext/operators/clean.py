"""Cleaning of a text table with a text, a label and a unique id column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _is_filled(text: str, label: str) -> Column:
    return F.col(text).isNotNull() & (F.col(text) != "") & F.col(label).isNotNull()


def remove_empty(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Drop null texts, empty texts and null labels; a text of blanks only is kept."""
    return df.filter(_is_filled(text, label))


def text_key(text: Column) -> Column:
    """Digest that stands for the exact text in shuffles (null for a null text)."""
    return F.sha2(text, 256)


def dedup_text(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """Keep the first row (lowest id) of each distinct text; nulls count as equal.

    Only digests and ids are grouped, combined before the shuffle: copies of one text are reduced to
    one row per task, and no task holds a whole group. Texts move once, to meet the ids that stay.
    """
    first = df.groupBy(text_key(F.col(text)).alias("_key")).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_semi").select(*df.columns)


def clean(df: DataFrame, text: str = "text", label: str = "label", id_col: str = "id") -> DataFrame:
    """Duplicates go first, then empty rows: a text whose first copy has no label disappears."""
    return remove_empty(dedup_text(df, text, id_col), text, label)


def clean_audit(
    df: DataFrame, text: str = "text", label: str = "label", id_col: str = "id"
) -> DataFrame:
    """Number of rows read, removed by each step, and kept; texts are reduced to digests first."""
    row = df.select(text_key(F.col(text)).alias("_key"), _is_filled(text, label).alias("_ok"),
                    F.col(id_col).alias("_id"))
    groups = row.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_ok", "_id").alias("first_ok")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum((~F.col("first_ok")).cast("bigint")), F.lit(0)).alias("empty_removed"),
        F.coalesce(F.sum(F.col("first_ok").cast("bigint")), F.lit(0)).alias("rows_kept"),
    )
