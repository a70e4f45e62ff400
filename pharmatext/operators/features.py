"""Text to features, as long tables ``(id, term, n)``, arrays per text, or ML vectors.

All functions take a frame with an id and a text column. Texts without tokens stay in every result
that has one row per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from pharmatext.functions import text as rules
from pharmatext.plans.joins import BROADCAST_BYTES, ROW_BYTES, join_measured, join_table, table_size
from pharmatext.plans.lookup import (
    LOOKUP_BYTES, filled, flat_lists, list_of_rows, list_with_offsets, map_batches, map_lists, mean_of, missed_in, rows_of,
    worker_table, worker_words,
)
from pharmatext.plans.ranking import with_global_rank, with_rank
from pharmatext.plans.storage import materialize

BATCH_SIZE = 25
MIN_LENGTH = 3


def tokenize(df: DataFrame, text: str = "text", id_col: str = "id", stop_words=rules.STOP_WORDS) -> DataFrame:
    """One row per token: ``(id, pos, token)``."""
    found = rules.tokens(F.col(text), stop_words)
    return df.select(id_col, F.posexplode(found).alias("pos", "token"))


def token_arrays(
    df: DataFrame, text: str, keep: list[str], remove_tags: list[str] | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns and ``tokens``, one row per text, without the tokens of the given tags.

    ``keep`` starts with the id. Only a lexicon needs a join, hence a shuffle.
    """
    found = F.coalesce(rules.tokens(F.col(text)), F.array().cast("array<string>"))
    if not remove_tags:
        return df.select(*keep, found.alias("tokens"))
    wanted = rules.check_tags(remove_tags)
    if lexicon is None:
        kept = F.filter(found, lambda t: ~rules.rule_tag(t).isin(wanted))
        return df.select(*keep, kept.alias("tokens"))
    rows = df.select(*keep, F.posexplode_outer(found).alias("pos", "token"))
    tagged = tag_tokens(rows, "token", lexicon)
    kept = F.when(F.col("pos").isNotNull() & ~F.col("tag").isin(wanted), F.struct("pos", "token"))
    # One text per group: it was one row of the input.
    texts = tagged.groupBy(*keep).agg(F.array_sort(F.collect_list(kept)).alias("_p"))
    return texts.select(*keep, F.col("_p.token").alias("tokens"))


def token_rows(
    df: DataFrame, text: str, keep: list[str], remove_tags: list[str] | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``keep`` columns and ``term``, one row per token; a text without tokens gives one null term.

    The rows of a text stay in the task that read it. With a lexicon ``keep`` starts with the id.
    """
    texts = token_arrays(df, text, keep, remove_tags, lexicon)
    return texts.select(*keep, F.explode_outer("tokens").alias("term"))


def tag_tokens(
    rows: DataFrame, token: str = "token", lexicon: DataFrame | None = None
) -> DataFrame:
    """Add ``tag``: from a lexicon ``(term, tag)`` where it has the word, else by rule."""
    by_rule = rules.rule_tag(F.col(token))
    if lexicon is None:
        return rows.withColumn("tag", by_rule)
    known = lexicon.select(F.col("term").alias(token), F.col("tag").alias("_tag"))
    joined = join_table(rows, known, token, table_size(lexicon, "term")[1])
    return joined.withColumn("tag", F.coalesce("_tag", by_rule)).drop("_tag")


def pos_filter(tokens: DataFrame, remove_tags: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    """Drop the tokens whose tag is in the list; an unknown tag is an error."""
    wanted = rules.check_tags(remove_tags)
    return tag_tokens(tokens, lexicon=lexicon).filter(~F.col("tag").isin(wanted))


@dataclass
class BagOfWords:
    """Vocabulary of the training texts, and term counts of any texts against it."""

    terms: DataFrame
    n_terms: int
    n_bytes: int
    remove_tags: list[str] | None = None
    lexicon: DataFrame | None = None

    @staticmethod
    def fit(df: DataFrame, text: str = "text", id_col: str = "id",
            remove_tags: list[str] | None = None, lexicon: DataFrame | None = None) -> BagOfWords:
        rows = token_rows(df, text, [id_col], remove_tags, lexicon)
        found = rows.select("term").filter(F.col("term").isNotNull()).distinct()
        terms = materialize(found, "vocabulary")
        return BagOfWords(terms, *table_size(terms, "term"), remove_tags, lexicon)

    def with_index(self) -> DataFrame:
        """``(term, idx)``: alphabetical position, numbered without one global sort."""
        return with_rank(self.terms, "term", name="idx")

    def transform(self, df: DataFrame, text: str = "text", id_col: str = "id",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
        """``(id, term, n)``; terms outside the vocabulary drop, a text with none keeps a null row."""
        rows = token_rows(df, text, [id_col], self.remove_tags, self.lexicon)
        counts = rows.groupBy(id_col, "term").agg(F.count("term").alias("n"))
        known = self.terms.withColumn("_known", F.lit(True))
        joined = join_table(counts, known, "term", self.n_bytes, limit=limit)
        per_text = Window.partitionBy(id_col).orderBy("term")
        whole = per_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        marked = joined.withColumn("_k", F.count("_known").over(whole)).withColumn(
            "_r", F.row_number().over(per_text))
        is_known = F.col("_known").isNotNull()
        return marked.filter(is_known | ((F.col("_k") == 0) & (F.col("_r") == 1))).select(
            id_col, F.when(is_known, F.col("term")).alias("term"),
            F.when(is_known, F.col("n")).otherwise(0).alias("n"),
        )


@dataclass
class TfIdf:
    """Document frequencies of the training texts, and weights of any texts against them."""

    doc_freq: DataFrame
    n_texts: int
    n_bytes: int

    @staticmethod
    def fit(df: DataFrame, text: str = "text", id_col: str = "id") -> TfIdf:
        pairs = token_rows(df, text, [id_col]).filter(F.col("term").isNotNull()).distinct()
        doc_freq = materialize(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "doc_freq")
        return TfIdf(doc_freq, df.count(), table_size(doc_freq, "term")[1])

    def transform(self, df: DataFrame, text: str = "text", id_col: str = "id", limit: int = BROADCAST_BYTES) -> DataFrame:
        """``(id, term, n, df, weight)`` with weight = n * ln((texts + 1) / (df + 1)); unknown terms drop."""
        rows = token_rows(df, text, [id_col]).filter(F.col("term").isNotNull())
        counts = rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
        joined = join_table(counts, self.doc_freq, "term", self.n_bytes, "inner", limit)
        idf = F.log(F.lit(float(self.n_texts + 1)) / (F.col("df") + 1))
        return joined.select(id_col, "term", "n", "df", (F.col("n") * idf).alias("weight"))


def tf_idf(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """``(id, term, n, df, weight)`` with weight = n * ln((texts + 1) / (df + 1))."""
    rows = token_rows(df, text, [id_col]).filter(F.col("term").isNotNull())
    counts = materialize(rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n")), "term_counts")
    doc_freq = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "doc_freq")
    n_texts = df.count()
    joined = join_table(counts, doc_freq, "term", table_size(doc_freq, "term")[1], how="inner")
    idf = F.log(F.lit(float(n_texts + 1)) / (F.col("df") + 1))
    return joined.select(id_col, "term", "n", "df", (F.col("n") * idf).alias("weight"))


# ---- word vectors: a table (term, idx, vec), idx = position in the file from 0 ----

def first_places(table: DataFrame) -> DataFrame:
    """One row for each word, that of its first place; rows without a word drop. Only words and places are grouped,
    and vectors travel only beside a table of repeated words that is too large to be broadcast."""
    named = table.filter(F.col("term").isNotNull())
    places = named.groupBy("term").agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = places.filter("_n > 1").select("term", "_first")
    joined = join_measured(named, repeated, "term", "left")
    return joined.filter(F.col("_first").isNull() | (F.col("_first") == F.col("idx"))).select(*table.columns)


@dataclass
class WordVectors:
    """Word vectors with what the joins need to know about them."""

    table: DataFrame
    n_words: int
    dim: int
    n_bytes: int
    _workers: object = None
    _sent: dict | None = None

    @staticmethod
    def of(table: DataFrame) -> WordVectors:
        """Write the table once, then measure it; of a word that stands twice the first place counts."""
        return WordVectors.stored(materialize(
            first_places(table.select("term", F.col("idx").cast("bigint").alias("idx"), "vec")), "word_vectors"))

    @staticmethod
    def stored(table: DataFrame) -> WordVectors:
        """From a table that is cheap to read again."""
        size = table.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"),
            F.sum(F.octet_length("term") + 4 * F.size("vec") + ROW_BYTES).alias("bytes")).first()
        return WordVectors(table, size.n, size.dim or 0, size.bytes or 0)

    def workers(self, limit: int):
        """The table in every Python worker, or None if it is larger than ``limit`` bytes."""
        if self.n_bytes > limit or not self.n_words:
            return None
        self._workers = self._workers or worker_table(self.table)
        return self._workers

    def first_words(self, limit: int, vec: bool = True):
        """``(sent, cut)``: the words before place ``cut``, as many as ``limit`` bytes hold, in every Python worker, with
        their vectors or without; ``cut`` is None if these are all words."""
        if vec and self.workers(limit) is not None:
            return self._workers, None
        n_bytes = self.n_bytes - (0 if vec else 4 * self.dim * self.n_words)
        cut = int(limit * self.n_words / n_bytes) if n_bytes > limit else None
        if self._sent is None:
            self._sent = {}
        if (cut, vec) not in self._sent:
            words = self.table if cut is None else self.table.filter(F.col("idx") < cut)
            self._sent[cut, vec] = (worker_table if vec else worker_words)(words)
        return self._sent[cut, vec], cut

    def after(self, cut: int) -> DataFrame:
        """The rows from place ``cut`` on."""
        return self.table.filter(F.col("idx") >= cut)

    def lookup(self) -> DataFrame:
        """``(idx, vec)`` with a zero vector in row 0 and each word one further on."""
        zero = self.table.sparkSession.range(1).select(
            F.lit(0).cast("bigint").alias("idx"),
            F.array_repeat(F.lit(0.0).cast("float"), self.dim).alias("vec"),
        )
        return zero.unionByName(self.table.select((F.col("idx") + 1).alias("idx"), "vec"))


def mean_vectors(
    df: DataFrame, vectors: WordVectors, text: str = "text", id_col: str = "id",
    keep: list[str] | None = None, limit: int = LOOKUP_BYTES, join_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, keep.., features)``: mean vector of a text's tokens that have one, else zeros.

    Repeats count. Texts are mapped in place with the first words, ``limit`` bytes of them; the other words of
    each text, if there are any, are joined with their vectors and added to its sum.
    """
    keys = [id_col, *(keep or [])]
    dim = vectors.dim
    workers, cut = vectors.first_words(limit)
    texts = token_arrays(df, text, keys)
    if cut is None:
        def mean(tokens):
            terms, _, matrix = workers.value
            offsets, rows = rows_of(tokens, terms)
            out = np.zeros((len(tokens), dim))
            for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:]) if matrix is not None else ()):
                out[i] = mean_of(rows[start:end], matrix)
            return list_of_rows(out)

        return map_lists(texts, keys, "tokens", "array<double>", mean).select(
            *keys, array_to_vector("_new").alias("features"))

    def begun(batch):
        terms, _, matrix = workers.value
        offsets, rows = rows_of(batch.column("tokens"), terms)
        missed, starts = missed_in(offsets, rows)
        hits = np.diff(offsets) - np.diff(starts)
        out = np.zeros((batch.num_rows, dim))
        for i in np.flatnonzero(hits):
            out[i] = mean_of(rows[offsets[i]:offsets[i + 1]], matrix) * hits[i]
        words = flat_lists(batch.column("tokens"))[1].take(pa.array(missed))
        return [list_of_rows(out), pa.array(hits, pa.int64()), list_with_offsets(starts, words)]

    sums = map_batches(texts, keys, begun, "_sum array<double>, _hits bigint, _missed array<string>")
    sums = materialize(sums.withColumn("_row", F.monotonically_increasing_id()), "sums")
    rows = sums.select("_row", F.explode("_missed").alias("term")).groupBy("_row", "term").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    rest = vectors.after(cut).select("term", "vec")
    met = join_table(rows, rest, "term", vectors.n_bytes, "inner", join_limit)
    # a text's own words
    others = met.groupBy("_row").agg(F.collect_list(F.struct("_n", "vec")).alias("_p"))
    joined = sums.select(*keys, "_sum", "_hits", "_row").join(others, "_row", "left").select(
        *keys, "_sum", "_hits", F.flatten("_p.vec").alias("_flat"), F.col("_p._n").alias("_ns"))

    def ended(batch):
        total = flat_lists(batch.column("_sum"))[1].to_numpy().reshape(-1, dim).copy()
        hits = batch.column("_hits").to_numpy().copy()
        starts, times = flat_lists(batch.column("_ns"))
        matrix = flat_lists(batch.column("_flat"))[1].to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        times = times.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(np.diff(starts)):
            own = slice(starts[i], starts[i + 1])
            total[i] += times[own] @ matrix[own]
            hits[i] += times[own].sum()
        return [list_of_rows(total / np.maximum(1, hits)[:, None])]

    return map_batches(joined, keys, ended, "_new array<double>").select(*keys, array_to_vector("_new").alias("features"))


def mean_vector_values(means: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean vectors as one row per dimension."""
    return means.select(id_col, F.posexplode(vector_to_array("features")).alias("dim", "value"))


def tokens_to_indices(
    df: DataFrame, vectors: WordVectors, text: str = "text", id_col: str = "id",
    keep: list[str] | None = None, limit: int = LOOKUP_BYTES, join_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, keep.., indices)``: word position + 1 per token in text order, 0 for unknown words."""
    keys = [id_col, *(keep or [])]
    sent, cut = vectors.first_words(limit, vec=False)
    texts = token_arrays(df, text, keys)

    def index(tokens):
        terms, idx = sent.value
        offsets, rows = rows_of(tokens, terms)
        return offsets, rows, list_with_offsets(offsets, pa.array(np.append(idx + 1, 0)[rows].astype(np.int32)))

    if cut is None:
        return map_lists(texts, keys, "tokens", "array<int>", lambda tokens: index(tokens)[2]).select(
            *keys, F.col("_new").alias("indices"))

    def begun(batch):
        offsets, rows, known = index(batch.column("tokens"))
        missed, starts = missed_in(offsets, rows)
        at = missed - np.repeat(offsets[:-1], np.diff(starts))
        words = flat_lists(batch.column("tokens"))[1].take(pa.array(missed))
        return [known, list_with_offsets(starts, pa.array(at.astype(np.int32))), list_with_offsets(starts, words)]

    stored = map_batches(texts, keys, begun, "indices array<int>, _places array<int>, _missed array<string>")
    stored = materialize(stored.withColumn("_row", F.monotonically_increasing_id()), "indices")
    rows = stored.select("_row", F.explode(F.arrays_zip("_places", "_missed")).alias("_z")).select(
        "_row", F.col("_z._places").alias("_at"), F.col("_z._missed").alias("term"))
    rest = vectors.after(cut).select("term", (F.col("idx") + 1).cast("int").alias("_v"))
    return _with_met(stored, rows, rest, "term", vectors, join_limit, keys, "indices")


def indices_to_tokens(
    sequences: DataFrame, vectors: WordVectors, id_col: str = "id",
    limit: int = LOOKUP_BYTES, join_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, tokens)``: the words of an index sequence; index 0 gives null."""
    sent, cut = vectors.first_words(limit, vec=False)

    def word(lists):
        terms, idx = sent.value
        offsets, indices = flat_lists(lists)
        top = int(idx.max()) + 1 if len(idx) else 0
        at = np.full(top + 1, -1)
        at[idx + 1] = np.arange(len(idx))
        indices = indices.to_numpy(zero_copy_only=False)
        rows = np.where(indices <= top, at[np.minimum(indices, top)], -1)
        return list_with_offsets(offsets, terms.take(pa.array(rows, mask=rows < 0)))

    if cut is None:
        return map_lists(sequences, [id_col], "indices", "array<string>", word).select(
            id_col, F.col("_new").alias("tokens"))
    stored = materialize(sequences.select(id_col, "indices").withColumn("_row", F.monotonically_increasing_id()), "indices")
    rows = stored.select("_row", F.posexplode("indices").alias("_at", "_i")).filter(F.col("_i") > cut)
    rest = vectors.after(cut).select((F.col("idx") + 1).cast("int").alias("_i"), F.col("term").alias("_v"))
    words = map_lists(stored, [id_col, "_row"], "indices", "array<string>", word).withColumnRenamed("_new", "tokens")
    return _with_met(words, rows, rest, "_i", vectors, join_limit, [id_col], "tokens")


def _with_met(lists: DataFrame, rows: DataFrame, rest: DataFrame, on: str, vectors: WordVectors, limit: int,
              keys: list[str], name: str) -> DataFrame:
    """``keys`` and the lists ``name`` with what the entries ``(_row, _at, on)`` meet in ``rest (on, _v)`` put in their places."""
    met = join_table(rows, rest, on, vectors.n_bytes, "inner", limit)
    # a text's own entries: no more than its tokens
    found = met.groupBy("_row").agg(F.collect_list(F.struct("_at", "_v")).alias("_p"))
    joined = lists.select(*keys, name, "_row").join(found, "_row", "left").select(
        *keys, name, F.col("_p._at").alias("_at"), F.col("_p._v").alias("_v"))
    kind = joined.schema[name].dataType.simpleString()
    whole = map_batches(joined, keys, lambda b: [filled(b.column(name), b.column("_at"), b.column("_v"))], f"_new {kind}")
    return whole.select(*keys, F.col("_new").alias(name))


def by_length(sequences: DataFrame, id_col: str = "id") -> DataFrame:
    """Sequences longer than three, with ``length`` and their ``place`` by (length, id).

    The sequences are stored; only lengths are ranked.
    """
    return _placed(sequences, id_col).drop("_row")


def _placed(sequences: DataFrame, id_col: str, width: int | None = None) -> DataFrame:
    """``by_length``, and with a ``width`` the ``batch`` of so many neighbours and the longest length in it."""
    long = sequences.withColumn("length", F.size("indices")).filter(F.col("length") > MIN_LENGTH)
    stored = materialize(long.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    places = with_global_rank(stored.select("_row", "length", id_col), "length", id_col, name="place").select("_row", "length", "place")
    if width:
        places = places.withColumn("batch", F.floor(F.col("place") / width))
        places = places.withColumn("width", F.max("length").over(Window.partitionBy("batch")))
    return stored.join(places.drop("length"), "_row")


def pad_batches(sequences: DataFrame, id_col: str = "id", size: int = BATCH_SIZE) -> DataFrame:
    """Batches of ``size`` neighbours by length, right-padded with 0 to the longest of the batch."""
    return _placed(sequences, id_col, size).select(
        "batch", id_col, "place", "length", "width",
        F.concat("indices", F.array_repeat(F.lit(0), F.col("width") - F.col("length"))).alias("padded"),
    )
