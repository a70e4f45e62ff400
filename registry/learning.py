"""Naive Bayes as tables, the ML learners, and saved models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmatext.operators import features, kernel_svm, naive_bayes
from pharmatext.operators.folds import stratified_folds
from pharmatext.plans.classifier import REPRESENTATIONS, ModelSpec, TextClassifier, TrainedModel
from pharmatext.plans.dataset import TextDataset
from pharmatext.plans.storage import materialize, new_path
from pharmatext.streaming.jobs import classify_stream
from registry.common import (
    LABELLED_SQL, TEXTS_SQL, labelled, query, table, texts, token_rows_sql, word_vector_table,
)
from registry.texts import REMOVED, REMOVED_SQL, tag_sql

# ---- naive Bayes in SQL ----


def nb_sql(train: str, test: str, cols: str = "id") -> str:
    """CTEs that end in ``pred(cols.., predicted)``; ``train`` and ``test`` are SELECTs."""
    return f"""
train AS MATERIALIZED ({train}), test AS MATERIALIZED ({test}),
ttok AS MATERIALIZED ({token_rows_sql("SELECT * FROM train", "id, label")}),
cls AS (SELECT label, ln(count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE)) AS prior FROM train GROUP BY label),
voc AS (SELECT DISTINCT term FROM ttok),
siz AS (SELECT label, count(*) + (SELECT count(*) FROM voc) AS total FROM ttok GROUP BY label),
cnt AS (SELECT label, term, count(*) AS n FROM ttok GROUP BY label, term),
theta AS MATERIALIZED (
  SELECT cls.label, voc.term, ln((coalesce(n, 0) + 1) / CAST(total AS DOUBLE)) AS log_prob
  FROM cls JOIN siz USING (label) CROSS JOIN voc LEFT JOIN cnt ON cnt.label = cls.label AND cnt.term = voc.term),
hits AS (SELECT tok.id, theta.label, sum(log_prob) AS s
         FROM ({token_rows_sql("SELECT id, text FROM test")}) tok JOIN theta USING (term) GROUP BY tok.id, theta.label),
score AS (SELECT test.id, cls.label, round(prior + coalesce(s, 0), 4) AS score
          FROM test CROSS JOIN cls LEFT JOIN hits ON hits.id = test.id AND hits.label = cls.label),
best AS (SELECT id, label AS predicted FROM (
           SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn FROM score) WHERE rn = 1),
pred AS (SELECT {', '.join('test.' + c.strip() for c in cols.split(','))}, predicted FROM test JOIN best USING (id))"""


ALL_SQL = nb_sql(LABELLED_SQL, TEXTS_SQL)
THETA_SQL = f"WITH {ALL_SQL} SELECT label, term, round(log_prob, 6) AS log_prob FROM theta"
PRED_SQL = f"WITH {ALL_SQL} SELECT id, predicted FROM pred"


def theta(model):
    return model.terms().withColumn("log_prob", F.round("log_prob", 6))


@query("nb_fit", THETA_SQL)
def nb_fit(spark, sf):
    return theta(naive_bayes.fit(labelled(spark, sf)))


@query("nb_predict", f"""
WITH {ALL_SQL}
SELECT pred.id, predicted, max(score) FILTER (label = 0) AS score_0, max(score) FILTER (label = 1) AS score_1
FROM pred JOIN score USING (id) GROUP BY pred.id, predicted""")
def nb_predict(spark, sf):
    scored = naive_bayes.fit(labelled(spark, sf)).score(texts(spark, sf))
    return scored.select("id", "predicted", F.col("scores")[0].alias("score_0"), F.col("scores")[1].alias("score_1"))


# ---- ML learners ----

FOLDS = 5

def word_vectors(spark, sf, length=1.0):
    """Word vectors, each times ``length``."""
    longer = F.transform("vec", lambda x: (x * length).cast("float"))
    return features.WordVectors.of(word_vector_table(spark, sf).withColumn("vec", longer))


def dataset(spark, sf):
    return TextDataset(materialize(labelled(spark, sf), "labelled"))


def fit_and_score(spark, sf, learner, representation=None, length=1.0):
    """(id, label, predicted) of every document that the learner can read: fitted on the labelled ones."""
    vectors = word_vectors(spark, sf, length) if learner in ("svm", "cnn") else None
    data = dataset(spark, sf)
    model = TextClassifier(learner, representation, vectors).fit(data)
    return model.predict(texts(spark, sf)).join(data.table.select("id", "label"), "id", "left")


@query("rf_fit_predict")
def rf_fit_predict(spark, sf):
    return fit_and_score(spark, sf, "rf")


@query("rf_recall", f"""
WITH bags AS (SELECT id, label, list_sort(list(term)) AS bag FROM ({token_rows_sql(LABELLED_SQL, "id, label")}) GROUP BY id, label),
texts AS (SELECT t.id, t.label, coalesce(bag, []) AS bag FROM ({LABELLED_SQL}) t LEFT JOIN bags USING (id)),
votes AS (SELECT bag, label, count(*) AS n FROM texts GROUP BY bag, label),
best AS (SELECT bag, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY n DESC, label) AS rn FROM votes) WHERE rn = 1)
SELECT id, label, predicted FROM texts JOIN best USING (bag)""")
def rf_recall(spark, sf):
    """What unlimited trees know of the texts they were grown on: the label of each bag of terms, the more
    frequent one where equal bags have different labels."""
    data = dataset(spark, sf)
    return TextClassifier("rf").fit(data).predict(data.table, keep=["label"])


@query("svm_fit_predict")
def svm_fit_predict(spark, sf):
    """The vectors are ten long, as trained ones are: between unit vectors' means the fixed kernel width sees no difference."""
    return fit_and_score(spark, sf, "svm", length=10.0)


@query("svm_multiclass")
def svm_multiclass(spark, sf):
    """The kernel SVM on given vectors with ten classes; they are unit vectors, so the width is one over their variance in all."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), features.array_to_vector("embedding").alias("features"),
        F.col("label").cast("double").alias("label"))
    return kernel_svm.fit(rows, gamma=1.0).predict(rows, ["id", "label"])


@query("conv_fit_predict")
def conv_fit_predict(spark, sf):
    return fit_and_score(spark, sf, "cnn")


@query("cross_validate_rf")
def cross_validate_rf(spark, sf):
    """(id, fold, actual, predicted) of five forests, each blind to the fold it scores, fitted side by side."""
    data = dataset(spark, sf)
    folded = stratified_folds(data.table, FOLDS)
    return TextClassifier("rf").out_of_fold(data, folded, FOLDS)


@query("model_spec", f"""
WITH tok AS (SELECT id, term FROM ({token_rows_sql(LABELLED_SQL)}))
SELECT learner, representation, (SELECT count(*) FROM ({LABELLED_SQL})) AS n_texts,
  CASE representation WHEN 'bow' THEN (SELECT count(DISTINCT term) FROM tok)
    WHEN 'pos' THEN (SELECT count(DISTINCT term) FROM tok WHERE {tag_sql()} NOT IN ({REMOVED_SQL}))
    ELSE (SELECT max(len(embedding)) FROM embeddings) END AS n_features
FROM (VALUES {', '.join(f"('{k}', '{r}')" for k, v in REPRESENTATIONS.items() for r in v)}) AS v(learner, representation)""")
def model_spec(spark, sf):
    """Every valid pair of learner and representation, with the size of its input."""
    data = labelled(spark, sf)
    n = data.count()
    sizes = {
        "bow": features.BagOfWords.fit(data).n_terms,
        "pos": features.BagOfWords.fit(data, remove_tags=REMOVED).n_terms,
        "embedding": table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0],
    }
    sizes["matrix"] = sizes["embedding"]
    specs = [ModelSpec(k, r, REMOVED).checked() for k, v in REPRESENTATIONS.items() for r in v]
    rows = [(s.learner, s.representation, n, sizes[s.representation]) for s in specs]
    return spark.createDataFrame(rows, "learner string, representation string, n_texts bigint, n_features bigint")


# ---- saved models ----

@query("fit_and_save", THETA_SQL)
def fit_and_save(spark, sf):
    path = new_path(spark, "model")
    TextClassifier().fit(TextDataset(labelled(spark, sf)), output=path)
    return theta(TrainedModel.load(spark, path).fitted)


@query("model_save", f"""
WITH {ALL_SQL} SELECT label, CAST(count(*) AS BIGINT) AS n_terms, round(sum(log_prob), 2) AS total FROM theta GROUP BY label""")
def model_save(spark, sf):
    """What a saved model holds per class."""
    path = new_path(spark, "model")
    TextClassifier.save(TextClassifier().fit(TextDataset(labelled(spark, sf))), path)
    terms = TrainedModel.load(spark, path).fitted.terms()
    return terms.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("log_prob"), 2).alias("total"))


@query("model_load", PRED_SQL)
def model_load(spark, sf):
    path = new_path(spark, "model")
    TextClassifier().fit(TextDataset(labelled(spark, sf)), output=path)
    return TextClassifier.load(spark, path).predict(texts(spark, sf))


@query("stream_classify", PRED_SQL)
def stream_classify(spark, sf):
    model = naive_bayes.fit(labelled(spark, sf))
    trained = TrainedModel(ModelSpec().checked(), model)
    landed = materialize(texts(spark, sf), "landed")
    folder = landed.inputFiles()[0].rsplit("/", 1)[0]
    arriving = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    output, checkpoint = new_path(spark, "scored"), new_path(spark, "scored_state")
    classify_stream(arriving, trained, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).select("id", "predicted")
