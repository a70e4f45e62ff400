"""Files, cleaning, ratings, labels and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmatext.functions import ratings
from pharmatext.functions.fixed_values import NA_STRINGS, STOP_WORDS
from pharmatext.operators import clean, features, labelling, stats
from pharmatext.plans.storage import new_path
from pharmatext.sources import pages, text_files, word_vectors
from pharmatext.sources.tables import file_bytes
from registry.common import (
    DEDUP_SQL, FILLED, LABELLED_SQL, RAW_REVIEWS_SQL, STOPS_SQL, TEXTS_SQL, WORD_VECTORS_SQL,
    labelled, query, quoted, raw_reviews, table, texts, token_rows_sql, word_vector_table,
)

# ---- files ----

NA_SQL = ", ".join(quoted(x) for x in NA_STRINGS)


CSV_SQL = f"""
SELECT doc_id AS id, CASE WHEN text NOT IN ({NA_SQL}) THEN text END AS text,
       CASE WHEN lang NOT IN ({NA_SQL}) THEN lang END AS lang, n_chars FROM documents"""


#: Bytes of documents that one task writes to one file; each such file is still read by several tasks.
CSV_FILE_BYTES = 256 * 1024 * 1024


@query("csv_scan_split", CSV_SQL)
def csv_scan_split(spark, sf):
    """All documents as one file (of many documents a few large ones), their line breaks in quotes, read by byte ranges."""
    path = new_path(spark, "csv_scan_split")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars")
    files = -(-file_bytes(spark, f"{sf}/documents.parquet") // CSV_FILE_BYTES)
    text_files.write_csv(docs.coalesce(1) if files <= 1 else docs.repartition(files, "id"), path)
    return text_files.read_csv_split(spark, path, "id bigint, text string, lang string, n_chars bigint")


@query("csv_scan", CSV_SQL)
def csv_scan(spark, sf):
    path = new_path(spark, "csv_scan")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars")
    text_files.write_csv(docs, path)
    return text_files.read_csv(spark, path, "id bigint, text string, lang string, n_chars bigint")


OLD_RATINGS_SQL = """
SELECT doc_id AS id, CAST(1 + n_chars % 5 AS DOUBLE) AS effectiveness,
       CASE WHEN quality IS NOT NULL THEN CAST(1 + n_chars % 4 AS DOUBLE) END AS "ease of use"
FROM documents LEFT JOIN labels USING (doc_id)"""


def old_ratings(spark, sf):
    """(id, rating): ratings kept as a Python dict literal, with None where a document has no label."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    ease = F.when(F.col("quality").isNull(), "None").otherwise(F.format_string("%d.0", 1 + F.col("n_chars") % 4))
    return joined.select(F.col("doc_id").alias("id"), F.format_string(
        "{'effectiveness': %d.0, 'ease of use': %s}", 1 + F.col("n_chars") % 5, ease).alias("rating"))


@query("csv_sink", OLD_RATINGS_SQL)
def csv_sink(spark, sf):
    path = new_path(spark, "csv_sink")
    text_files.write_csv(old_ratings(spark, sf), path, ["effectiveness", "ease of use"])
    return text_files.read_csv(spark, path, "id bigint, effectiveness double, `ease of use` double")


@query("url_list_scan", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def url_list_scan(spark, sf):
    path = new_path(spark, "urls")
    # Trailing blanks and empty lines as in hand-made lists.
    lines = table(spark, sf, "pages").select(F.explode(F.array(F.concat("url", F.lit(" ")), F.lit(""))).alias("u"))
    text_files.write_lines(lines, "u", path)
    return text_files.url_list(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("name_list_scan", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name")
def name_list_scan(spark, sf):
    path = new_path(spark, "names")
    text_files.write_lines(table(spark, sf, "part").select(F.concat(F.lit(" \t"), "p_name", F.lit("  ")).alias("v")), "v", path)
    return text_files.read_names(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("url_list_sink", "SELECT url AS line, count(*) AS n FROM pages GROUP BY url")
def url_list_sink(spark, sf):
    path = new_path(spark, "url_sink")
    text_files.write_lines(table(spark, sf, "pages"), "url", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("embedding_scan", f"""
SELECT term, idx, CAST(len(vec) AS INTEGER) AS dim, CAST(vec[1] AS DOUBLE) AS first_value,
       round(list_sum(list_transform(vec, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS total
FROM ({WORD_VECTORS_SQL})""")
def embedding_scan(spark, sf):
    vectors = features.WordVectors.of(word_vector_table(spark, sf))
    path = new_path(spark, "word2vec")
    word_vectors.write_word_vectors(vectors.table, path, vectors.n_words, vectors.dim)
    total = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return word_vectors.read_word_vectors(spark, path).select(
        "term", "idx", F.size("vec").alias("dim"), F.col("vec")[0].cast("double").alias("first_value"),
        F.round(total, 4).alias("total"))


@query("stopword_scan", f"""
SELECT term, count(*) AS n, count(DISTINCT id) AS texts
FROM ({token_rows_sql(TEXTS_SQL, raw=True)}) WHERE term IN ({STOPS_SQL}) GROUP BY term""")
def stopword_scan(spark, sf):
    """What the stop list takes out of the documents."""
    raw = features.tokenize(texts(spark, sf), stop_words=())
    per_text = raw.filter(F.col("token").isin(STOP_WORDS)).groupBy("token", "id").agg(F.count("pos").alias("n"))
    return per_text.groupBy(F.col("token").alias("term")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


@query("page_scan", "SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM pages")
def page_scan(spark, sf):
    found = pages.read_pages(spark, f"{sf}/pages.parquet")
    return found.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"),
                        F.md5(F.encode("html", "UTF-8")).alias("digest"))


# ---- cleaning ----

@query("remove_empty", f"SELECT * FROM ({RAW_REVIEWS_SQL}) WHERE {FILLED}")
def remove_empty(spark, sf):
    return clean.remove_empty(raw_reviews(spark, sf), label="effectiveness")


@query("dedup_text", DEDUP_SQL)
def dedup_text(spark, sf):
    return clean.dedup_text(raw_reviews(spark, sf))


@query("clean", f"SELECT * FROM ({DEDUP_SQL}) WHERE {FILLED}")
def clean_(spark, sf):
    return clean.clean(raw_reviews(spark, sf), label="effectiveness")


@query("clean_audit", f"""
SELECT (SELECT count(*) FROM documents) AS rows_read,
       (SELECT count(*) FROM documents) - count(*) AS duplicates_removed,
       count(*) - count(*) FILTER ({FILLED}) AS empty_removed,
       count(*) FILTER ({FILLED}) AS rows_kept FROM ({DEDUP_SQL})""")
def clean_audit(spark, sf):
    return clean.clean_audit(raw_reviews(spark, sf), label="effectiveness")


# ---- ratings and labels ----

@query("explode_ratings", OLD_RATINGS_SQL)
def explode_ratings(spark, sf):
    return labelling.explode_ratings(old_ratings(spark, sf))


def _label_sql(case: str, where: str = "") -> str:
    return f"SELECT id, effectiveness, {case} AS label FROM ({RAW_REVIEWS_SQL}) {where}"


TWO_SQL = "CASE WHEN effectiveness IN (1.0, 2.0) THEN 0.0::DOUBLE WHEN effectiveness IN (4.0, 5.0) THEN 1.0::DOUBLE END"


def stars(spark, sf):
    return raw_reviews(spark, sf).select("id", "effectiveness")


@query("label_2class", _label_sql(TWO_SQL, "WHERE effectiveness IN (1.0, 2.0, 4.0, 5.0)"))
def label_2class(spark, sf):
    return labelling.label_stars(stars(spark, sf), num_classes=2)


@query("label_3class", _label_sql(
    "CASE WHEN effectiveness IN (1.0, 2.0) THEN 0.0::DOUBLE WHEN effectiveness IN (4.0, 5.0) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"))
def label_3class(spark, sf):
    return labelling.label_stars(stars(spark, sf), num_classes=3)


@query("label_5class", _label_sql(
    "CASE WHEN effectiveness = floor(effectiveness) THEN effectiveness - 1.0::DOUBLE END"))
def label_5class(spark, sf):
    return labelling.label_stars(stars(spark, sf), num_classes=5)


@query("label_threshold", _label_sql(
    "CASE WHEN effectiveness >= 3.5 THEN 1.0::DOUBLE WHEN effectiveness <= 2.5 THEN 0.0::DOUBLE END"))
def label_threshold(spark, sf):
    label = ratings.label_threshold(F.col("effectiveness"), positive=3.5, negative=2.5)
    return labelling.add_label(stars(spark, sf), label)


@query("label_if_absent", f"SELECT id, label FROM ({LABELLED_SQL})")
def label_if_absent(spark, sf):
    reviews = labelled(spark, sf).select("id", "label", (2.0 + F.col("label")).alias("effectiveness"))
    return labelling.label_stars(reviews).select("id", "label")


@query("select_label", "SELECT doc_id AS id, CAST(toxic AS DOUBLE) AS label FROM labels")
def select_label(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return labelling.select_label(labels, "toxic").select("id", "label")


# ---- statistics ----

CLEANED_SQL = f"SELECT * FROM ({DEDUP_SQL}) WHERE {FILLED}"


def cleaned(spark, sf):
    return clean.clean(raw_reviews(spark, sf), label="effectiveness")


@query("total_texts", f"SELECT count(*) AS total_texts FROM ({CLEANED_SQL})")
def total_texts(spark, sf):
    return stats.total_texts(cleaned(spark, sf))


@query("unique_labels", f"""
SELECT label, count(*) OVER () AS n_labels FROM (SELECT DISTINCT effectiveness AS label FROM ({CLEANED_SQL}))""")
def unique_labels(spark, sf):
    return stats.unique_labels(cleaned(spark, sf), "effectiveness")


@query("label_stats", f"""
SELECT label, n, round(100 * n / CAST(sum(n) OVER () AS DOUBLE), 6) AS percent
FROM (SELECT effectiveness AS label, count(*) AS n FROM ({CLEANED_SQL}) GROUP BY effectiveness)""")
def label_stats(spark, sf):
    return stats.label_stats(cleaned(spark, sf), "effectiveness")
