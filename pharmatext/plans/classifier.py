"""Fit, evaluate, validate, apply, save and load text classifiers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pharmatext.operators import features, folds, forest, kernel_svm, learners, metrics, naive_bayes, network
from pharmatext.operators.features import WordVectors
from pharmatext.operators.forest import Forest
from pharmatext.operators.kernel_svm import KernelSvm
from pharmatext.operators.naive_bayes import NaiveBayesModel
from pharmatext.operators.network import ConvNetwork
from pharmatext.plans.dataset import TextDataset
from pharmatext.plans.lookup import LOOKUP_BYTES
from pharmatext.plans.storage import materialize
from pharmatext.sources.reports import write_report

# Learner -> representations it can use; the first is the default.
REPRESENTATIONS = {
    "nb": ("bow", "pos"),
    "rf": ("bow", "pos", "embedding"),
    "svm": ("embedding", "bow", "pos"),
    "cnn": ("matrix",),
}
ALIASES = {"embeddings": "embedding"}
#: Folds that are fitted side by side: their jobs share the cluster, and each holds one model on the driver.
FOLDS_AT_A_TIME = 4


@dataclass(frozen=True)
class ModelSpec:
    """A learner and how its texts become numbers; the two are kept together."""

    learner: str = "nb"
    representation: str | None = None
    remove_tags: list[str] = field(default_factory=list)
    hashed_terms: int = learners.HASHED_TERMS  # columns of the term counts of svm
    depth: int | None = None  # of the trees of rf; None grows them to the end

    def checked(self) -> ModelSpec:
        """The spec with its default filled in; a pair that cannot work is an error."""
        if self.learner not in REPRESENTATIONS:
            raise ValueError(f"learner must be one of {', '.join(REPRESENTATIONS)}")
        allowed = REPRESENTATIONS[self.learner]
        wanted = ALIASES.get(self.representation, self.representation) or allowed[0]
        if wanted not in allowed:
            raise ValueError(f"{self.learner} works with {', '.join(allowed)}, not with {wanted}")
        if wanted == "pos" and not self.remove_tags:
            raise ValueError("the pos representation needs the tags to remove")
        return replace(self, representation=wanted, remove_tags=self.remove_tags if wanted == "pos" else [])


@dataclass
class TrainedModel:
    spec: ModelSpec
    fitted: NaiveBayesModel | Forest | KernelSvm | ConvNetwork | PipelineModel
    vectors: WordVectors | None = None
    lexicon: DataFrame | None = None

    def predict(self, df: DataFrame, text: str = "text", id_col: str = "id",
                keep: list[str] | None = None) -> DataFrame:
        """``(id, keep.., predicted)`` for every text, also those without known words.

        Of the matrix representation texts of three tokens or fewer are no part: they have no row.
        """
        keys = [id_col, *(keep or [])]
        if isinstance(self.fitted, NaiveBayesModel):
            return self.fitted.predict(df, text, id_col, keep)
        rows = vectorize(self.spec, df, text, keys, self.vectors, self.lexicon)
        return score(self.fitted, rows, keys, self.vectors)

    def save(self, path: str, mode: str = "error") -> None:
        """Learner, spec, word vectors and lexicon below one path."""
        spark = SparkSession.active()
        row = (self.spec.learner, self.spec.representation, ",".join(self.spec.remove_tags),
               self.lexicon is not None, self.spec.hashed_terms, self.spec.depth)
        columns = "learner string, representation string, remove_tags string, has_lexicon boolean, hashed_terms int, depth int"
        spark.createDataFrame([row], columns).coalesce(1).write.mode(mode).parquet(f"{path}/spec")
        if isinstance(self.fitted, PipelineModel):
            writer = self.fitted.write()
            (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/learner")
        else:
            self.fitted.save(f"{path}/learner", mode)
        if self.vectors is not None:
            self.vectors.table.write.mode(mode).parquet(f"{path}/vectors")
        if self.lexicon is not None:
            self.lexicon.write.mode(mode).parquet(f"{path}/lexicon")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        row = spark.read.parquet(f"{path}/spec").first()
        spec = ModelSpec(row.learner, row.representation, row.remove_tags.split(",") if row.remove_tags else [], row.hashed_terms, row.depth)
        lexicon = spark.read.parquet(f"{path}/lexicon") if row.has_lexicon else None
        vectors = None
        if spec.representation in ("embedding", "matrix"):
            vectors = WordVectors.stored(spark.read.parquet(f"{path}/vectors"))
        if spec.learner == "nb":
            return TrainedModel(spec, NaiveBayesModel.load(spark, f"{path}/learner", lexicon), None, lexicon)
        if spec.learner == "rf" and spec.representation == "embedding":
            return TrainedModel(spec, PipelineModel.load(f"{path}/learner"), vectors, lexicon)
        kind = {"rf": Forest, "svm": KernelSvm, "cnn": ConvNetwork}[spec.learner]
        return TrainedModel(spec, kind.load(spark, f"{path}/learner"), vectors, lexicon)


def vectorize(spec: ModelSpec, df: DataFrame, text: str, keys: list[str],
              vectors: WordVectors | None, lexicon: DataFrame | None) -> DataFrame:
    """``keys`` and what the learner reads, one row per text; ``keys`` starts with the id.

    The matrix representation has the word places of a text and leaves out texts of three tokens or fewer.
    """
    if spec.representation in ("embedding", "matrix") and vectors is None:
        raise ValueError(f"the {spec.representation} representation needs word vectors")
    if spec.representation == "embedding":
        return features.mean_vectors(df, vectors, text, keys[0], keys[1:])
    if spec.representation == "matrix":
        sequences = features.tokens_to_indices(df, vectors, text, keys[0], keys[1:])
        return sequences.filter(F.size("indices") > features.MIN_LENGTH)
    if spec.learner == "rf":
        return forest.bags(df, text, keys, spec.remove_tags, lexicon)
    return learners.hashed_counts(df, text, keys, spec.hashed_terms, spec.remove_tags, lexicon)


def score(fitted, rows: DataFrame, keys: list[str], vectors: WordVectors | None) -> DataFrame:
    """``(keys.., predicted)`` for every row of ``vectorize``."""
    if isinstance(fitted, PipelineModel):
        return learners.predict(fitted, rows, keys)
    if isinstance(fitted, ConvNetwork):
        return fitted.predict(rows, vectors, keys)
    return fitted.predict(rows, keys)


class TextClassifier:
    """Front end over the learners: 'nb', 'rf', 'svm' or 'cnn' with a representation."""

    def __init__(self, learner: str = "nb", representation: str | None = None,
                 vectors: WordVectors | None = None, remove_tags: list[str] | None = None,
                 lexicon: DataFrame | None = None, hashed_terms: int = learners.HASHED_TERMS, depth: int | None = None):
        self.spec = ModelSpec(learner, representation, list(remove_tags or []), hashed_terms, depth).checked()
        self.vectors, self.lexicon = vectors, lexicon

    def fit(self, data: TextDataset, output: str | None = None) -> TrainedModel:
        """Vectorize, fit and, with ``output``, save."""
        df, text, label, id_col = data.table, data.text, data.label, data.id
        if self.spec.learner == "nb":
            fitted = naive_bayes.fit(df, text, label, id_col, self.spec.remove_tags or None, self.lexicon)
        else:
            fitted = self._fit_rows(vectorize(self.spec, df, text, [id_col, label], self.vectors, self.lexicon), label, id_col)
        model = TrainedModel(self.spec, fitted, self.vectors, self.lexicon)
        if output:
            model.save(output)
        return model

    def _fit_rows(self, rows: DataFrame, label: str, id_col: str) -> Forest | KernelSvm | ConvNetwork | PipelineModel:
        """Fit a learner on the rows of ``vectorize``."""
        if self.spec.learner == "cnn":
            return network.fit(rows, self.vectors, label, id_col)
        if self.spec.learner == "svm":
            return kernel_svm.fit(rows, label)
        if self.spec.representation == "embedding":
            return learners.fit_forest(rows, label, depth=min(self.spec.depth or learners.MAX_DEPTH, learners.MAX_DEPTH))
        return forest.fit(rows, label, depth=self.spec.depth)

    def _scored(self, data: TextDataset, model: TrainedModel) -> DataFrame:
        scored = model.predict(data.table, data.text, data.id, [data.label])
        return scored.withColumnRenamed(data.label, "actual")

    def evaluate(self, data: TextDataset, model: TrainedModel | str) -> tuple[DataFrame, DataFrame]:
        """``(metric rows, confusion matrix)``; the model may be a saved model's path."""
        scored = materialize(self._scored(data, self._model(model)), "scored")
        return metrics.metric_rows(scored), metrics.confusion_matrix(scored)

    def validate(self, data: TextDataset, k_folds: int = 10) -> tuple[DataFrame, DataFrame]:
        """``(mean and deviation per metric, summed confusion matrix)`` over stratified folds."""
        table = data.table.select(data.id, data.text, data.label)
        folded = folds.stratified_folds(table, k_folds, data.label, data.id)
        scored = materialize(self.out_of_fold(data, folded, k_folds), "out_of_fold")
        return metrics.cv_summary(scored), metrics.cv_confusion(scored)

    def out_of_fold(self, data: TextDataset, folded: DataFrame, k: int) -> DataFrame:
        """``(id, actual, fold, predicted)`` of k models, each blind to the fold it scores. Other learners than
        naive Bayes are fitted a few folds at a time over one stored table."""
        if self.spec.learner == "nb":
            scored = naive_bayes.cross_validate(
                folded, k, data.text, data.label, data.id, remove_tags=self.spec.remove_tags or None, lexicon=self.lexicon)
            return scored.withColumnRenamed(data.label, "actual")
        # what a text looks like doesn't depend on the fold: made once for all fits
        keys = [data.id, data.label, "fold"]
        rows = materialize(vectorize(self.spec, folded, data.text, keys, self.vectors, self.lexicon), "fold_features")
        if self.vectors is not None:
            self.vectors.workers(LOOKUP_BYTES)  # sent once, before the fits start

        def refit(i: int) -> DataFrame:
            fitted = self._fit_rows(rows.filter(F.col("fold") != i), data.label, data.id)
            part = score(fitted, rows.filter(F.col("fold") == i), keys, self.vectors)
            return materialize(part.select(data.id, F.col(data.label).cast("double").alias("actual"), "fold", "predicted"), "fold_scores")

        context = rows.sparkSession.sparkContext
        with ThreadPoolExecutor(FOLDS_AT_A_TIME) as pool:
            def submit(i: int):
                context.setLocalProperty("spark.scheduler.pool", f"fold{i % FOLDS_AT_A_TIME}")  # for fair scheduling, where it is on
                return pool.submit(inheritable_thread_target(rows.sparkSession)(lambda: refit(i)))

            before = context.getLocalProperty("spark.scheduler.pool")
            started = [submit(i) for i in range(k)]
            context.setLocalProperty("spark.scheduler.pool", before)
            parts = [x.result() for x in started]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def classify(self, data: TextDataset, model: TrainedModel | str, output: str | None = None) -> DataFrame:
        """``(id, text, predicted[, actual])``, and a text report with ``output``; labels are optional."""
        labelled = data.label in data.table.columns
        keep = [data.label] if labelled else []
        scored = self._model(model).predict(data.table, data.text, data.id, keep)
        if labelled:
            scored = scored.withColumnRenamed(data.label, "actual")
        out = data.table.select(data.id, data.text).join(scored, data.id)
        if output:
            write_report(out, output, data.text, actual="actual" if labelled else None)
        return out

    @staticmethod
    def save(model: TrainedModel, path: str, mode: str = "error") -> None:
        model.save(path, mode)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        return TrainedModel.load(spark, path)

    def _model(self, model: TrainedModel | str) -> TrainedModel:
        return TrainedModel.load(SparkSession.active(), model) if isinstance(model, str) else model
