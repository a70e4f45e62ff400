"""Star ratings to columns and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import MapType, StringType

LOW = [1.0, 2.0]
HIGH = [4.0, 5.0]


def rating_map(rating: Column) -> Column:
    """Star map of a rating kept as text: a Python dict literal, possibly with ``None`` values.

    A text that is no dict (a scalar rating) gives null.
    """
    as_json = F.regexp_replace(rating, r": None", ": null")
    return F.from_json(as_json, MapType(StringType(), StringType())).cast("map<string,double>")


def rating_scalar(rating: Column) -> Column:
    """The number of a rating that is not a map."""
    return rating.try_cast("double")


def label_two_class(stars: Column) -> Column:
    """0 for one or two stars, 1 for four or five, else null; half stars are null too."""
    return F.when(stars.isin(LOW), 0.0).when(stars.isin(HIGH), 1.0)


def label_three_class(stars: Column) -> Column:
    """0 / 1 / 2; everything that is neither low nor high is the middle class, null included."""
    return F.when(stars.isin(LOW), 0.0).when(stars.isin(HIGH), 2.0).otherwise(1.0)


def label_five_class(stars: Column) -> Column:
    """Whole stars 1 to 5 become 0 to 4; anything else is null."""
    return F.when(stars.isin([1.0, 2.0, 3.0, 4.0, 5.0]), stars - 1.0)


def label_threshold(
    stars: Column, positive: float = 4.0, negative: float = 2.0, neutral: float | None = None
) -> Column:
    """1 from ``positive`` upward, 0 down from ``negative``, ``neutral`` between; null stays null."""
    return (
        F.when(stars >= positive, 1.0)
        .when(stars <= negative, 0.0)
        .when(stars.isNotNull(), F.lit(neutral).cast("double"))
    )


LABELS = {2: label_two_class, 3: label_three_class, 5: label_five_class}


def star_label(stars: Column, num_classes: int = 2) -> Column:
    if num_classes not in LABELS:
        raise ValueError("num_classes must be 2, 3 or 5")
    return LABELS[num_classes](stars)
