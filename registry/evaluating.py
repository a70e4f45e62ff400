"""Metrics, folds, cross-validation and classification reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmatext.operators import clean, folds, metrics, naive_bayes
from pharmatext.plans.classifier import TextClassifier
from pharmatext.plans.dataset import TextDataset
from pharmatext.plans.storage import materialize, new_path
from pharmatext.sources.reports import report_entry, write_report
from registry.common import LABELLED_SQL, TEXTS_SQL, labelled, query, table, texts, token_rows_sql
from registry.learning import nb_sql

K = 10  # folds of a cross-validation
HOLD_OUT = 5  # parts of which the flagship holds one out


def predictions(spark, sf):
    """(id, actual, predicted): one label column of ``labels`` read as a prediction of the other."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("actual"),
        F.col("toxic").cast("double").alias("predicted"))


PREDICTIONS_SQL = (
    "SELECT doc_id AS id, CAST(quality AS DOUBLE) AS actual, CAST(toxic AS DOUBLE) AS predicted FROM labels")


def label_metrics_sql(source: str, by: str = "") -> str:
    """SELECT of (by, label, precision, recall, f1)."""
    g = f"{by}, " if by else ""
    using = f"({g}label)"
    return f"""
SELECT {g}label, coalesce(hit / CAST(nullif(n_pred, 0) AS DOUBLE), 0) AS precision,
       hit / CAST(n_act AS DOUBLE) AS recall, 2 * hit / CAST(coalesce(n_pred, 0) + n_act AS DOUBLE) AS f1
FROM (SELECT {g}actual AS label, count(*) AS n_act, count(*) FILTER (actual = predicted) AS hit
      FROM ({source}) GROUP BY {g}actual)
LEFT JOIN (SELECT {g}predicted AS label, count(*) AS n_pred FROM ({source}) GROUP BY {g}predicted) USING {using}"""


def metric_rows_sql(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    each = label_metrics_sql(source, by)
    parts = [f"SELECT {g}'accuracy' AS metric, CAST(NULL AS DOUBLE) AS label, "
             f"avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END) AS value FROM ({source})"
             + (f" GROUP BY {by}" if by else "")]
    parts += [f"SELECT {g}'{m}', label, {m} FROM ({each})" for m in ("precision", "recall", "f1")]
    return " UNION ALL ".join(parts)


def confusion_sql(source: str) -> str:
    return f"""
SELECT a.label AS actual, p.label AS predicted, count(d.actual) AS n
FROM (SELECT DISTINCT actual AS label FROM ({source})) a CROSS JOIN (SELECT DISTINCT actual AS label FROM ({source})) p
LEFT JOIN ({source}) d ON d.actual = a.label AND d.predicted = p.label GROUP BY a.label, p.label"""


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("accuracy", f"SELECT round(avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ({PREDICTIONS_SQL})")
def accuracy(spark, sf):
    return metrics.accuracy(predictions(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def _one_metric(name):
    @query(name, f"SELECT label, round({name}, 6) AS {name} FROM ({label_metrics_sql(PREDICTIONS_SQL)})")
    def one(spark, sf):
        return metrics.label_metrics(predictions(spark, sf)).select("label", F.round(name, 6).alias(name))


for _name in ("precision", "recall", "f1"):
    _one_metric(_name)


@query("confusion_matrix", confusion_sql(PREDICTIONS_SQL))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predictions(spark, sf))


@query("metric_report", f"""
SELECT metric, label, printf('%.2f%%', round(100 * value, 2)) AS percent FROM ({metric_rows_sql(PREDICTIONS_SQL)})""")
def metric_report(spark, sf):
    return metrics.evaluation_report(predictions(spark, sf))


# ---- folds and cross-validation ----

FOLDS_SQL = f"""
SELECT *, CAST(ntile({K}) OVER (PARTITION BY label ORDER BY id) - 1 AS INTEGER) AS fold FROM ({LABELLED_SQL})"""


@query("stratified_folds", f"SELECT id, label, fold FROM ({FOLDS_SQL})")
def stratified_folds(spark, sf):
    return folds.stratified_folds(labelled(spark, sf).select("id", "label"), K)


CV_SQL = f"""
WITH data AS MATERIALIZED ({FOLDS_SQL}),
tok AS MATERIALIZED ({token_rows_sql("SELECT * FROM data", "id, label, fold")}),
f AS (SELECT CAST(range AS INTEGER) AS f FROM range({K})),
cls AS (SELECT f, label, ln(count(*) FILTER (fold <> f) / CAST(sum(count(*) FILTER (fold <> f)) OVER (PARTITION BY f) AS DOUBLE)) AS prior
        FROM data CROSS JOIN f GROUP BY f, label),
cnt AS MATERIALIZED (SELECT f, label, term, count(*) AS n FROM tok CROSS JOIN f WHERE fold <> f GROUP BY f, label, term),
voc AS (SELECT f, term FROM cnt GROUP BY f, term),
siz AS (SELECT f, label, sum(n) + (SELECT count(*) FROM voc WHERE voc.f = cnt.f) AS total FROM cnt GROUP BY f, label),
theta AS MATERIALIZED (
  SELECT siz.f, siz.label, voc.term, ln((coalesce(n, 0) + 1) / CAST(total AS DOUBLE)) AS log_prob
  FROM siz JOIN voc ON voc.f = siz.f
  LEFT JOIN cnt ON cnt.f = siz.f AND cnt.label = siz.label AND cnt.term = voc.term),
hits AS (SELECT tok.id, theta.label, sum(log_prob) AS s FROM tok JOIN theta ON theta.f = tok.fold AND theta.term = tok.term
         GROUP BY tok.id, theta.label),
score AS (SELECT data.id, data.fold, data.label AS actual, cls.label, round(prior + coalesce(s, 0), 4) AS score
          FROM data JOIN cls ON cls.f = data.fold LEFT JOIN hits ON hits.id = data.id AND hits.label = cls.label),
cv AS MATERIALIZED (SELECT id, fold, actual, label AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn FROM score) WHERE rn = 1)"""


def out_of_fold(spark, sf):
    folded = folds.stratified_folds(labelled(spark, sf), K)
    return naive_bayes.cross_validate(folded, K).withColumnRenamed("label", "actual")


@query("cross_validate", f"{CV_SQL} SELECT id, fold, actual, predicted FROM cv")
def cross_validate(spark, sf):
    return out_of_fold(spark, sf)


@query("cv_summary", f"""
{CV_SQL} SELECT metric, label, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd
FROM ({metric_rows_sql("SELECT * FROM cv", "fold")}) GROUP BY metric, label""")
def cv_summary(spark, sf):
    summary = metrics.cv_summary(materialize(out_of_fold(spark, sf), "out_of_fold"))
    return summary.select("metric", "label", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("cv_confusion", f"{CV_SQL} {confusion_sql('SELECT * FROM cv')}")
def cv_confusion(spark, sf):
    return metrics.cv_confusion(materialize(out_of_fold(spark, sf), "out_of_fold"))


@query("validation_report", f"""
{CV_SQL} SELECT metric, label, printf('%.4f%%', round(100 * avg(value), 4)) || ' +/- ' || printf('%.4f%%', round(100 * stddev_pop(value), 4)) AS percent
FROM ({metric_rows_sql("SELECT * FROM cv", "fold")}) GROUP BY metric, label""")
def validation_report(spark, sf):
    return metrics.validation_report(materialize(out_of_fold(spark, sf), "out_of_fold"))


# ---- evaluate and classify ----

HELD_OUT_SQL = (
    "WITH data AS MATERIALIZED (" + FOLDS_SQL + "), "
    + nb_sql("SELECT * FROM data WHERE fold <> 0", "SELECT id, text, label FROM data WHERE fold = 0", "id, label")
    + ", ev AS (SELECT id, label AS actual, predicted FROM pred)"
)


@query("evaluate", f"""
{HELD_OUT_SQL} SELECT metric, label, round(value, 6) AS value FROM ({metric_rows_sql("SELECT * FROM ev")})""")
def evaluate(spark, sf):
    data = folds.stratified_folds(labelled(spark, sf), K)
    clf = TextClassifier()
    model = clf.fit(TextDataset(data.filter("fold <> 0")))
    rows, _ = clf.evaluate(TextDataset(data.filter("fold = 0")), model)
    return rounded(rows)


ENTRY_SQL = "'Comment: ' || text || chr(10) || 'Predicted Class: ' || CAST(predicted AS INTEGER)"


@query("classify", f"""
WITH {nb_sql(LABELLED_SQL, TEXTS_SQL, 'id, text')}
SELECT id, predicted, md5({ENTRY_SQL} || chr(10) || chr(10)) AS entry FROM pred""")
def classify(spark, sf):
    """All documents, with or without a label."""
    clf = TextClassifier()
    model = clf.fit(TextDataset(labelled(spark, sf)))
    found = clf.classify(TextDataset(texts(spark, sf)), model)
    entry = report_entry(F.col("text"), F.col("predicted"))
    return found.select("id", "predicted", F.md5(F.encode(entry, "UTF-8")).alias("entry"))


@query("classification_report_sink", f"""
SELECT line, count(*) AS n FROM (
  SELECT unnest(string_split('Comment: ' || text || chr(10) || 'Predicted Class: ' || toxic || chr(9) || 'Actual Class: ' || quality || chr(10), chr(10))) AS line
  FROM documents JOIN labels USING (doc_id)) GROUP BY line""")
def classification_report_sink(spark, sf):
    """The lines of a written report."""
    path = new_path(spark, "report")
    write_report(texts(spark, sf).join(predictions(spark, sf), "id"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# ---- the whole way ----

FLAGSHIP_SQL = (
    f"""WITH data AS MATERIALIZED (
SELECT *, CAST(ntile({HOLD_OUT}) OVER (PARTITION BY label ORDER BY id) - 1 AS INTEGER) AS fold FROM (
  SELECT id, text, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM ({LABELLED_SQL}))
  WHERE rn = 1 AND text <> '')), """
    + nb_sql("SELECT * FROM data WHERE fold <> 0", "SELECT id, text, label FROM data WHERE fold = 0", "id, label")
    + ", ev AS (SELECT id, label AS actual, predicted FROM pred) "
    + confusion_sql("SELECT * FROM ev")
)


@query("clean_fit_evaluate", FLAGSHIP_SQL)
def clean_fit_evaluate(spark, sf):
    """Clean, fold, fit naive Bayes on all folds but the first, and its confusion matrix there."""
    cleaned = materialize(clean.clean(labelled(spark, sf)), "cleaned")
    data = folds.stratified_folds(cleaned, HOLD_OUT)
    model = naive_bayes.fit(data.filter("fold <> 0"))
    scored = model.predict(data.filter("fold = 0"), keep=["label"])
    return metrics.confusion_matrix(scored.withColumnRenamed("label", "actual"))
