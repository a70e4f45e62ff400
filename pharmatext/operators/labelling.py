"""Rating columns and labels of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from pharmatext.functions import ratings


def star_types(df: DataFrame, rating: str = "rating") -> list[str]:
    """Names of all star types in a rating column; they become columns, so their set goes to the driver."""
    stars = _as_map(df, rating)
    return sorted(r.k for r in df.select(F.explode(F.map_keys(stars)).alias("k")).distinct().collect())


def _as_map(df: DataFrame, rating: str) -> Column:
    is_map = isinstance(df.schema[rating].dataType, MapType)
    return F.col(rating) if is_map else ratings.rating_map(F.col(rating))


def explode_ratings(
    df: DataFrame, types: list[str] | None = None, rating: str = "rating"
) -> DataFrame:
    """Replace a rating map (or its text form) by one column per star type.

    A scalar rating has no types and passes through. Without ``types`` they are read from the data.
    """
    if rating not in df.columns:
        return df
    names = types if types is not None else star_types(df, rating)
    if not names:
        return df.drop(rating) if isinstance(df.schema[rating].dataType, MapType) else df
    stars = _as_map(df, rating)
    columns = [F.try_element_at(stars, F.lit(n)).alias(n) for n in names]
    return df.select(*[c for c in df.columns if c != rating], *columns)


def add_label(df: DataFrame, label: Column, drop_null: bool = False, name: str = "label") -> DataFrame:
    """Add a label column unless there is one already; a second call changes nothing."""
    if name in df.columns:
        return df
    labelled = df.withColumn(name, label)
    return labelled.filter(F.col(name).isNotNull()) if drop_null else labelled


def label_stars(df: DataFrame, stars: str = "effectiveness", num_classes: int = 2) -> DataFrame:
    """Sentiment labels from a star column; with two classes the rows between are dropped."""
    return add_label(df, ratings.star_label(F.col(stars), num_classes), num_classes == 2)


def select_label(df: DataFrame, source: str, name: str = "label") -> DataFrame:
    """Any column as the label."""
    return df.withColumn(name, F.col(source).cast("double"))
