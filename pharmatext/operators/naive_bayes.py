"""Multinomial naive Bayes over term counts, as one grouped count table.

Smoothing is alpha = 1 and the prior is the empirical class share. (``pyspark.ml`` smooths the prior
too and keeps the vocabulary on the driver; here it stays a table.)

The table is sparse: a term holds the classes that it occurs in. With k known tokens in a text and v terms,

    score(class) = log prior - k * log(tokens of the class + v) + sum over tokens of log(count in the class + 1)

and the last part is 0 for a class that lacks the term, so only stored counts are read. The plan is the
same for any number of classes: priors and sizes are array literals, never columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pharmatext.operators.features import token_rows
from pharmatext.plans.joins import BROADCAST_BYTES, ROW_BYTES, join_table
from pharmatext.plans.storage import materialize

SCORE_DECIMALS = 4
CELL_BYTES = 32  # what a stored count of a broadcast table needs


def class_counts(df: DataFrame, label: str) -> dict[float, int]:
    """Rows per class in label order, without null labels. The class set goes to the driver."""
    found = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[label]: r.n for r in sorted(found, key=lambda r: r[label])}


def numbers(values: list) -> Column:
    """An array literal of doubles, one node of the plan at any length."""
    return F.lit(np.array(values, dtype=np.float64))


def label_array(labels: list) -> Column:
    if all(isinstance(x, (int, float)) for x in labels):
        return numbers(labels)
    return F.array(*[F.lit(x) for x in labels])


def term_cells(rows: DataFrame, label: str, labels: list, *counts: Column) -> DataFrame:
    """``(term, cells)``: for each class number with the term its token count ``n`` and further ``counts``.

    Rows are combined per (term, class) before they move; only cells are grouped by term.
    """
    typed = F.col(label).cast("double") if all(isinstance(x, (int, float)) for x in labels) else F.col(label)
    number = (F.array_position(label_array(labels), typed) - 1).cast("int")
    each = rows.groupBy("term", label).agg(F.count(F.lit(1)).alias("n"), *counts).withColumn("c", number)
    return each.groupBy("term").agg(F.collect_list(F.struct("c", *each.drop("term", "c", label).columns)).alias("cells"))


def text_scores(met: DataFrame, keys: list[str], labels: list, prior, size) -> DataFrame:
    """``(keys.., predicted, scores)`` of rows ``(keys.., hits)``, one row per token.

    ``hits`` holds ``(c, v)``: the classes with the token and the log of its count + 1; it is null or empty
    for a token that the model does not know. ``prior(c)`` and ``size(c)`` are the logs of a class's share
    and of its tokens with the vocabulary. The lower label wins a tie.
    """
    rows = met.select(*keys, F.posexplode_outer("hits").alias("_pos", "_hit"))
    sums = rows.groupBy(*keys, F.col("_hit.c").alias("_c")).agg(
        F.sum("_hit.v").alias("_v"), F.count_if(F.col("_pos") == 0).alias("_k"))
    stored = F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("c"), F.lit(1).alias("kind"), F.col("_v").alias("v")))
    texts = sums.groupBy(*keys).agg(F.collect_list(stored).alias("_s"), F.sum("_k").cast("double").alias("_k"))
    base = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda c: F.struct(
        c.alias("c"), F.lit(0).alias("kind"), (prior(c) - F.col("_k") * size(c)).alias("v")))
    # sorted by class, each class's base stands just before its stored sum
    def totals(m: Column) -> Column:
        def total(x: Column, i: Column) -> Column:
            after = F.get(m, i + 1)
            whole = x["v"] + F.when(after["kind"] == 1, after["v"]).otherwise(0.0)
            return F.when(x["kind"] == 0, F.round(F.coalesce(whole, F.lit(float("-inf"))), SCORE_DECIMALS))

        return F.filter(F.transform(m, total), lambda x: x.isNotNull())

    def answer(scores: Column) -> Column:
        best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
        return F.struct(F.get(label_array(labels), best).alias("predicted"), scores.alias("scores"))

    merged = once(F.array_sort(F.concat(base, F.col("_s"))), lambda m: once(totals(m), answer))
    return texts.select(*keys, merged.alias("_r")).select(*keys, "_r.predicted", "_r.scores")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, also where the optimizer merges projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_hits(cells: Column, count=lambda x: x["n"]) -> Column:
    found = F.filter(cells, lambda x: count(x) > 0)
    return F.transform(found, lambda x: F.struct(x["c"].alias("c"), F.log(count(x) + 1).alias("v")))


@dataclass
class NaiveBayesModel:
    """Per class: prior and number of tokens; per term: its counts in the classes that have it."""

    labels: list[float]
    priors: list[float]
    totals: list[int]
    n_terms: int
    n_bytes: int
    table: DataFrame
    remove_tags: list[str] | None = None
    lexicon: DataFrame | None = None

    def log_sizes(self) -> Column:
        return numbers([math.log(t + self.n_terms) if t + self.n_terms else 0.0 for t in self.totals])

    def terms(self) -> DataFrame:
        """``(label, term, log_prob)`` for every class and vocabulary term."""
        counts = F.map_from_entries(F.transform("cells", lambda x: F.struct(x["c"], x["n"])))
        each = self.table.select("term", counts.alias("_n"), F.posexplode(label_array(self.labels)).alias("_c", "label"))
        count = F.coalesce(F.try_element_at("_n", F.col("_c")), F.lit(0))
        return each.select("label", "term", (F.log(count + 1) - F.get(self.log_sizes(), F.col("_c"))).alias("log_prob"))

    def score(self, df: DataFrame, text: str = "text", id_col: str = "id",
              keep: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``(id, keep.., predicted, scores)``; scores are in label order.

        A text without known terms gets the priors alone. While the model fits a broadcast, only sums
        per text and class are shuffled.
        """
        keys = [id_col, *(keep or [])]
        model = self.table.select("term", log_hits(F.col("cells")).alias("hits"))
        rows = token_rows(df, text, keys, self.remove_tags, self.lexicon)
        joined = join_table(rows, model, "term", self.n_bytes, limit=limit)
        priors, sizes = numbers([math.log(p) for p in self.priors]), self.log_sizes()
        return text_scores(joined, keys, self.labels, lambda c: F.get(priors, c), lambda c: F.get(sizes, c))

    def predict(self, df: DataFrame, text: str = "text", id_col: str = "id",
                keep: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
        return self.score(df, text, id_col, keep, limit).drop("scores")

    def save(self, path: str, mode: str = "error") -> None:
        """Term table and class table, side by side as parquet (a lexicon is saved by its owner)."""
        spark = self.table.sparkSession
        rows = list(zip(range(len(self.labels)), self.labels, self.priors, self.totals))
        spark.createDataFrame(rows, "i int, label double, prior double, total bigint").withColumn(
            "n_terms", F.lit(self.n_terms).cast("bigint")
        ).withColumn("n_bytes", F.lit(self.n_bytes).cast("bigint")).withColumn("remove_tags", F.lit(",".join(self.remove_tags or []))).coalesce(1) \
            .write.mode(mode).parquet(f"{path}/classes")
        self.table.write.mode(mode).parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str, lexicon: DataFrame | None = None) -> NaiveBayesModel:
        classes = spark.read.parquet(f"{path}/classes").orderBy("i").collect()
        return NaiveBayesModel(
            [r.label for r in classes], [r.prior for r in classes], [r.total for r in classes],
            classes[0].n_terms, classes[0].n_bytes, spark.read.parquet(f"{path}/terms"),
            classes[0].remove_tags.split(",") if classes[0].remove_tags else None, lexicon,
        )


def fit(df: DataFrame, text: str = "text", label: str = "label", id_col: str = "id",
        remove_tags: list[str] | None = None, lexicon: DataFrame | None = None) -> NaiveBayesModel:
    """Count terms per class, combined before each shuffle. Texts without a label don't count."""
    df = df.filter(F.col(label).isNotNull())
    sizes = class_counts(df, label)
    labels = list(sizes)
    keep = [label] if lexicon is None else [id_col, label]
    rows = token_rows(df, text, keep, remove_tags, lexicon).filter(F.col("term").isNotNull())
    table = materialize(term_cells(rows, label, labels), "term_class_counts")
    found = table.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b"),
                      F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("cells")).first()
    totals = dict(table.select(F.explode("cells").alias("x")).groupBy("x.c").agg(F.sum("x.n")).collect())
    n = sum(sizes.values())
    return NaiveBayesModel(
        [float(x) for x in labels], [sizes[x] / n for x in labels], [totals.get(i, 0) for i in range(len(labels))],
        found.v, found.b + found.v * ROW_BYTES + found.cells * CELL_BYTES, table, remove_tags, lexicon)


def cross_validate(
    df: DataFrame, k: int, text: str = "text", label: str = "label", id_col: str = "id",
    fold: str = "fold", limit: int = BROADCAST_BYTES, remove_tags: list[str] | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Predictions ``(id, fold, label, predicted)`` of k models, each blind to the fold it scores.

    The terms are counted once per (class, fold). What fold f's model knows is the total minus the
    fold's own count; a term only seen in fold f is outside that model's vocabulary. Texts without a label
    are left out. A class that a fold's training part lacks cannot be predicted there.
    """
    df = df.filter(F.col(label).isNotNull())
    in_cells = {(r[label], r[fold]): r.n for r in df.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted({x for x, _ in in_cells})
    folds, classes = range(k), range(len(labels))
    keep = [label, fold] if lexicon is None else [id_col, label, fold]
    rows = token_rows(df, text, keep, remove_tags, lexicon).filter(F.col("term").isNotNull())
    by_fold = F.array(*[F.count_if(F.col(fold) == f) for f in folds]).alias("own")
    counts = materialize(term_cells(rows, label, labels, by_fold), "term_fold_counts")

    train = lambda f: lambda x: x["n"] - F.get(x["own"], f)
    seen = lambda f: lambda x: train(f)(x) > 0
    known = [F.exists("cells", seen(F.lit(f))) for f in folds]
    found = counts.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b"),
        F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("cells"),
        *[F.count_if(each).alias(f"v{f}") for f, each in zip(folds, known)]).first()
    x = F.col("x")
    totals = {r[0]: r[1:] for r in counts.select(F.explode("cells").alias("x")).groupBy("x.c").agg(
        *[F.sum(train(F.lit(f))(x)) for f in folds]).collect()}

    n_class = [sum(in_cells.get((c, f), 0) for f in folds) for c in labels]
    n_fold = [sum(in_cells.get((c, f), 0) for c in labels) for f in folds]
    priors, sizes = [], []  # of class c in the model of fold f at place f * classes + c
    for f in folds:
        n_train = sum(n_class) - n_fold[f]
        for c in classes:
            own = n_class[c] - in_cells.get((labels[c], f), 0)
            size = totals.get(c, (0,) * k)[f] + found[f"v{f}"]
            priors.append(math.log(own / n_train) if own else float("-inf"))
            sizes.append(math.log(size) if size else 0.0)
    priors, sizes = numbers(priors), numbers(sizes)
    place = lambda c: (F.col(fold) * len(labels) + c).cast("int")

    keys = [id_col, fold, label]
    n_bytes = found.b + found.n * ROW_BYTES + found.cells * (CELL_BYTES + 8 * k)
    joined = join_table(token_rows(df, text, keys, remove_tags, lexicon), counts, "term", n_bytes, limit=limit)
    met = joined.select(*keys, log_hits(F.col("cells"), train(F.col(fold))).alias("hits"))
    scored = text_scores(met, keys, labels, lambda c: F.get(priors, place(c)), lambda c: F.get(sizes, place(c)))
    return scored.select(*keys, "predicted")
