"""Per-label metrics, confusion matrices and their text forms.

Input frames have ``actual`` and ``predicted``; ``by`` names columns to report per group (the fold).
Everything derives from one (group, actual, predicted) count table, which is as large as the
squared class set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.plans.storage import materialize


def pair_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    right = F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy")
    return df.groupBy(*by).agg(right) if by else df.agg(right)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def label_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., label, precision, recall, f1)`` for the labels that occur as actual; 0/0 is 0."""
    by = by or []
    pairs = pair_counts(df, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = pairs.groupBy(*by, F.col("actual").alias("label")).agg(
        F.sum(hit).alias("_hit"), F.sum("n").alias("_actual"))
    predicted = pairs.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("_predicted"))
    n_predicted = F.coalesce("_predicted", F.lit(0))
    return actual.join(predicted, [*by, "label"], "left").select(
        *by, "label",
        _ratio(F.col("_hit"), n_predicted).alias("precision"),
        _ratio(F.col("_hit"), F.col("_actual")).alias("recall"),
        _ratio(2 * F.col("_hit"), n_predicted + F.col("_actual")).alias("f1"),
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """``(actual, predicted, n)`` over the actual labels, zero cells included.

    Predictions outside the label set are left out.
    """
    pairs = materialize(pair_counts(df).filter(F.col("actual").isNotNull()), "pairs")  # the rows are read once
    labels = sorted(r[0] for r in pairs.select("actual").distinct().collect())
    found = F.map_from_entries(F.collect_list(F.when(F.col("predicted").isNotNull(), F.struct("predicted", "n"))))
    each = pairs.groupBy("actual").agg(found.alias("_n")).withColumn("predicted", F.explode(F.array(*[F.lit(x) for x in labels])))
    return each.select("actual", "predicted", F.coalesce(F.try_element_at("_n", F.col("predicted")), F.lit(0).cast("bigint")).alias("n"))


def metric_rows(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., metric, label, value)``: accuracy (null label) and each label's metrics."""
    by = by or []
    overall = accuracy(df, by).select(
        *by, F.lit("accuracy").alias("metric"), F.lit(None).cast("double").alias("label"),
        F.col("accuracy").alias("value"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                      for m in ("precision", "recall", "f1")])
    each = label_metrics(df, by).select(*by, "label", F.explode(cells).alias("x")).select(
        *by, "x.metric", F.col("label").cast("double").alias("label"), "x.value")
    return overall.unionByName(each)


def cv_summary(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population standard deviation of every metric over the folds."""
    return metric_rows(df, [fold]).groupBy("metric", "label").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def cv_confusion(df: DataFrame) -> DataFrame:
    """Element-wise sum of the folds' matrices: each row is in one fold, so it is the whole matrix."""
    return confusion_matrix(df)


def percent(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f%%", F.round(100 * value, decimals))


def evaluation_report(df: DataFrame) -> DataFrame:
    """Metrics as percentages with two decimals."""
    return metric_rows(df).select("metric", "label", percent(F.col("value"), 2).alias("percent"))


def validation_report(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean +/- deviation over folds as percentages with four decimals."""
    return cv_summary(df, fold).select("metric", "label", F.concat(
        percent(F.col("mean"), 4), F.lit(" +/- "), percent(F.col("sd"), 4)).alias("percent"))
