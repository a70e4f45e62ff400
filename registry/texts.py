"""Tokens, tags, bags of words, vectors and index sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmatext.functions.fixed_values import POS_TAGS
from pharmatext.functions.text import CLOSED_CLASS, DEFAULT_TAG, TAG_RULES
from pharmatext.operators import features
from pharmatext.plans.storage import materialize
from registry.common import (
    LABELLED_SQL, TEXTS_SQL, WORD_VECTORS_SQL, labelled, query, quoted, table, texts, token_rows_sql,
    word_vector_table,
)

TOKENS_SQL = token_rows_sql(TEXTS_SQL)
TRAIN_TOKENS_SQL = token_rows_sql(LABELLED_SQL, "id, label")
REMOVED = ["VERB", "ADV", "NUM"]


def tag_sql(term: str = "term") -> str:
    cases = [f"WHEN {term} IN ({', '.join(quoted(w) for w in words)}) THEN '{tag}'" for tag, words in CLOSED_CLASS.items()]
    cases += [f"WHEN regexp_matches({term}, '{pattern}') THEN '{tag}'" for pattern, tag in TAG_RULES]
    return f"CASE {' '.join(cases)} ELSE '{DEFAULT_TAG}' END"


@query("tokenize", token_rows_sql(TEXTS_SQL, raw=True).replace("AS term", "AS token"))
def tokenize(spark, sf):
    return features.tokenize(texts(spark, sf), stop_words=())


@query("drop_stopwords", f"SELECT id, term AS token, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY id, term")
def drop_stopwords(spark, sf):
    return features.tokenize(texts(spark, sf)).groupBy("id", "token").agg(F.count("pos").alias("n"))


@query("drop_punct_space", f"""
SELECT term AS token, count(*) AS n FROM ({token_rows_sql(TEXTS_SQL, raw=True)})
WHERE NOT regexp_matches(term, '[\\p{{L}}]') GROUP BY term""")
def drop_punct_space(spark, sf):
    """What stays of everything that is no word: symbols and numbers, but no punctuation."""
    raw = features.tokenize(texts(spark, sf), stop_words=())
    return raw.filter(~F.col("token").rlike(r"\p{L}")).groupBy("token").agg(F.count("pos").alias("n"))


@query("pos_tag_list", f"""
SELECT tag, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"('{t}')" for t in POS_TAGS)}) AS v(tag)
LEFT JOIN (SELECT {tag_sql()} AS tag, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY 1) USING (tag)""")
def pos_tag_list(spark, sf):
    """Every valid tag with its number of tokens."""
    found = features.tag_tokens(features.tokenize(texts(spark, sf))).groupBy("tag").agg(F.count("pos").alias("n"))
    tags = spark.createDataFrame([(t,) for t in POS_TAGS], "tag string")
    return tags.join(found, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


REMOVED_SQL = ", ".join(quoted(t) for t in REMOVED)


@query("pos_filter", f"""
SELECT tag, term AS token, count(*) AS n FROM (SELECT {tag_sql()} AS tag, term FROM ({TOKENS_SQL}))
WHERE tag NOT IN ({REMOVED_SQL}) GROUP BY tag, term""")
def pos_filter(spark, sf):
    kept = features.pos_filter(features.tokenize(texts(spark, sf)), REMOVED)
    return kept.groupBy("tag", "token").agg(F.count("pos").alias("n"))


PART_TEXTS_SQL = "SELECT p_partkey AS id, p_name || ' quickly ' || p_type || ' 5' AS text FROM part"
LEXICON_SQL = """
SELECT term, min(tag) AS tag FROM (
  SELECT string_split(p_name, ' ')[1] AS term, 'ADJ' AS tag FROM part
  UNION ALL SELECT string_split(p_name, ' ')[2], 'NOUN' FROM part
  UNION ALL SELECT lower(p_type), 'X' FROM part) WHERE term <> '' GROUP BY term"""


@query("pos_lexicon", f"""
SELECT term AS token, coalesce(l.tag, {tag_sql("t.term")}) AS tag, count(*) AS n
FROM ({token_rows_sql(PART_TEXTS_SQL)}) t LEFT JOIN ({LEXICON_SQL}) l USING (term) GROUP BY ALL""")
def pos_lexicon(spark, sf):
    """Tags from a lexicon table, built from the names and types of parts, before the rules."""
    part = table(spark, sf, "part")
    named = F.split("p_name", " ")
    entries = F.array(
        F.struct(F.get(named, 0).alias("term"), F.lit("ADJ").alias("tag")),
        F.struct(F.get(named, 1).alias("term"), F.lit("NOUN").alias("tag")),
        F.struct(F.lower("p_type").alias("term"), F.lit("X").alias("tag")))
    lexicon = part.select(F.explode(entries).alias("e")).select("e.term", "e.tag").filter("term <> ''")
    lexicon = materialize(lexicon.groupBy("term").agg(F.min("tag").alias("tag")), "lexicon")
    words = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" quickly "), "p_type", F.lit(" 5")).alias("text"))
    tagged = features.tag_tokens(features.tokenize(words), lexicon=lexicon)
    return tagged.groupBy("token", "tag").agg(F.count("pos").alias("n"))


@query("bow_fit", f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM ({TRAIN_TOKENS_SQL}))")
def bow_fit(spark, sf):
    return features.BagOfWords.fit(labelled(spark, sf)).with_index()


def bow_sql(keep: str = "true") -> str:
    return f"""
WITH tok AS (SELECT id, term FROM ({TOKENS_SQL}) WHERE {keep}),
voc AS (SELECT DISTINCT term FROM ({TRAIN_TOKENS_SQL}) WHERE {keep}),
cnt AS (SELECT id, term, count(*) AS n FROM tok JOIN voc USING (term) GROUP BY id, term)
SELECT id, term, n FROM cnt
UNION ALL SELECT id, NULL, 0 FROM ({TEXTS_SQL}) WHERE id NOT IN (SELECT id FROM cnt)"""


@query("bow_transform", bow_sql())
def bow_transform(spark, sf):
    return features.BagOfWords.fit(labelled(spark, sf)).transform(texts(spark, sf))


@query("pos_bow", bow_sql(f"{tag_sql()} NOT IN ({REMOVED_SQL})"))
def pos_bow(spark, sf):
    return features.BagOfWords.fit(labelled(spark, sf), remove_tags=REMOVED).transform(texts(spark, sf))


@query("tfidf", f"""
WITH cnt AS (SELECT id, term, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term)
SELECT id, term, n, df, round(n * ln(((SELECT count(*) FROM documents) + 1) / CAST(df + 1 AS DOUBLE)), 6) AS weight
FROM cnt JOIN dfs USING (term)""")
def tfidf(spark, sf):
    return features.tf_idf(texts(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("tfidf_fitted", f"""
WITH cnt AS (SELECT id, term, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY id, term),
dfs AS (SELECT term, count(DISTINCT id) AS df FROM ({TRAIN_TOKENS_SQL}) GROUP BY term)
SELECT id, term, n, df, round(n * ln(((SELECT count(*) FROM ({LABELLED_SQL})) + 1) / CAST(df + 1 AS DOUBLE)), 6) AS weight
FROM cnt JOIN dfs USING (term)""")
def tfidf_fitted(spark, sf):
    """Weights learned from the labelled documents, for all documents."""
    fitted = features.TfIdf.fit(labelled(spark, sf))
    return fitted.transform(texts(spark, sf)).withColumn("weight", F.round("weight", 6))


def vectors(spark, sf):
    return features.WordVectors.of(word_vector_table(spark, sf))


@query("mean_embedding", f"""
WITH vec AS MATERIALIZED ({WORD_VECTORS_SQL}),
cell AS (SELECT term, unnest(vec) AS v, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim FROM vec),
cnt AS (SELECT id, term, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY id, term),
hit AS (SELECT id, dim, sum(n * CAST(v AS DOUBLE)) / sum(n) AS value FROM cnt JOIN cell USING (term) GROUP BY id, dim)
SELECT id, dim, round(coalesce(value, 0), 5) AS value
FROM (SELECT id, CAST(unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS INTEGER) AS dim FROM ({TEXTS_SQL}))
LEFT JOIN hit USING (id, dim)""")
def mean_embedding(spark, sf):
    means = features.mean_vectors(texts(spark, sf), vectors(spark, sf))
    # Adding 0 turns a rounded -0.0 into 0.0.
    return features.mean_vector_values(means).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query("lookup_table", f"""
SELECT idx + 1 AS idx, CAST(vec[1] AS DOUBLE) AS first_value,
       round(list_sum(list_transform(vec, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS total FROM ({WORD_VECTORS_SQL})
UNION ALL SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE""")
def lookup_table(spark, sf):
    # each value weighs by its place, so an exchange of two values shows
    total = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, sf).lookup().select(
        "idx", F.col("vec")[0].cast("double").alias("first_value"), F.round(total, 4).alias("total"))


SEQUENCES_SQL = f"""
SELECT id, coalesce(seq, []) AS seq, coalesce(words, []) AS words FROM ({TEXTS_SQL}) LEFT JOIN (
  SELECT t.id, list(coalesce(v.idx + 1, 0) ORDER BY pos) AS seq, list(v.term ORDER BY pos) AS words
  FROM ({TOKENS_SQL}) t LEFT JOIN ({WORD_VECTORS_SQL}) v USING (term) GROUP BY t.id) USING (id)"""


@query("tokens_to_indices", f"""
SELECT id, CAST(len(seq) AS INTEGER) AS n, coalesce(array_to_string(seq, ' '), '') AS indices FROM ({SEQUENCES_SQL})""")
def tokens_to_indices(spark, sf):
    found = features.tokens_to_indices(texts(spark, sf), vectors(spark, sf))
    return found.select("id", F.size("indices").alias("n"), F.array_join("indices", " ").alias("indices"))


@query("indices_to_tokens", f"""
SELECT id, CAST(len(words) AS INTEGER) AS n,
       coalesce(array_to_string(list_transform(words, lambda w: coalesce(w, '?')), ' '), '') AS tokens FROM ({SEQUENCES_SQL})""")
def indices_to_tokens(spark, sf):
    known = vectors(spark, sf)
    back = features.indices_to_tokens(features.tokens_to_indices(texts(spark, sf), known), known)
    return back.select("id", F.size("tokens").alias("n"), F.array_join("tokens", " ", "?").alias("tokens"))


PLACED_SQL = f"""
SELECT id, CAST(len(seq) AS INTEGER) AS length, row_number() OVER (ORDER BY len(seq), id) - 1 AS place, seq
FROM ({SEQUENCES_SQL}) WHERE len(seq) > 3"""


@query("length_filter_sort", f"SELECT id, length, place FROM ({PLACED_SQL})")
def length_filter_sort(spark, sf):
    found = features.tokens_to_indices(texts(spark, sf), vectors(spark, sf))
    return features.by_length(found).select("id", "length", "place")


@query("pad_batches", f"""
SELECT batch, id, width, md5(array_to_string(list_concat(seq, [0 for x in range(width - length)]), ' ')) AS padded
FROM (SELECT *, max(length) OVER (PARTITION BY batch) AS width FROM (SELECT *, place // 25 AS batch FROM ({PLACED_SQL})))""")
def pad_batches(spark, sf):
    found = features.tokens_to_indices(texts(spark, sf), vectors(spark, sf))
    return features.pad_batches(found).select(
        "batch", "id", "width", F.md5(F.encode(F.array_join("padded", " "), "UTF-8")).alias("padded"))
