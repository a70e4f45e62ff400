"""Stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pharmatext.plans.ranking import with_rank
from pharmatext.plans.storage import materialize


def stratified_folds(
    df: DataFrame, k: int = 10, label: str = "label", id_col: str = "id", slices: int | None = None
) -> DataFrame:
    """Add ``fold`` (0 .. k-1): k consecutive blocks by id in each class, the first ones larger.

    The blocks follow from each id's place in its class and the class size; no task holds a whole
    class. Only labels and ids are sorted: the first id of each block then tells every row its fold
    where it lies.
    """
    ranked = with_rank(df.select(label, id_col), id_col, [label], "_rank", "_size", slices)
    small = F.floor(F.col("_size") / k)
    surplus = F.col("_size") % k
    border = surplus * (small + 1)
    fold = F.when(F.col("_rank") < border, F.floor(F.col("_rank") / (small + 1))).otherwise(
        surplus + F.floor((F.col("_rank") - border) / F.nullif(small, F.lit(0))))
    firsts = ranked.groupBy(F.col(label).alias("_label"), fold.alias("_fold")).agg(F.min(id_col).alias("_first"))
    # folds of a class are numbered from 0 without gaps, so the number of blocks begun is the fold
    blocks = materialize(firsts.groupBy("_label").agg(F.sort_array(F.collect_list("_first")).alias("_firsts")), "fold_blocks")
    begun = F.size(F.filter("_firsts", lambda first: first <= F.col(id_col)))
    joined = df.join(blocks, df[label].eqNullSafe(blocks["_label"]))
    return joined.select(*[df[c] for c in df.columns], (begun - 1).cast("int").alias("fold"))
