"""Registry, table access, and inputs derived from the given tables in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pharmatext.functions.fixed_values import SITE_PREFIXES, STOP_WORDS
from pharmatext.functions.text import CLITIC, TOKEN
from pharmatext.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as input of work on each text."""
    return read_table(spark, f"{sf}/documents.parquet", "doc_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- texts ----

def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text) of every document."""
    return documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, label) of every labelled document."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    docs = documents(spark, sf).select("doc_id", "text")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


TEXTS_SQL = "SELECT doc_id AS id, text FROM documents"
LABELLED_SQL = (
    "SELECT doc_id AS id, text, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)"
)


def raw_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, effectiveness) with gaps: very short documents count as missing or empty
    comments, documents without a label have no stars, the others half stars from 1 to 5."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(n < 60, None).when(n < 120, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("quality").isNotNull(), 1.0 + (n % 9) * 0.5).alias("effectiveness"),
    )


RAW_REVIEWS_SQL = """
SELECT doc_id AS id,
       CASE WHEN n_chars < 60 THEN NULL WHEN n_chars < 120 THEN '' ELSE text END AS text,
       CASE WHEN quality IS NOT NULL THEN 1.0 + CAST(n_chars % 9 AS DOUBLE) * 0.5 END AS effectiveness
FROM documents LEFT JOIN labels USING (doc_id)"""

DEDUP_SQL = (
    "SELECT id, text, effectiveness FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn "
    f"FROM ({RAW_REVIEWS_SQL})) WHERE rn = 1"
)
FILLED = "text IS NOT NULL AND text <> '' AND effectiveness IS NOT NULL"

# ---- tokens in SQL ----

STOPS_SQL = ", ".join(quoted(w) for w in STOP_WORDS)


def raw_tokens_sql(text: str = "text") -> str:
    return (
        f"regexp_extract_all(regexp_replace(lower({text}), {quoted(CLITIC)}, '\\1 \\2', 'g'), {quoted(TOKEN)}, 1)"
    )


def token_rows_sql(source: str, cols: str = "id", raw: bool = False) -> str:
    """SELECT of (cols, pos, term): one row per token."""
    words = raw_tokens_sql()
    if not raw:
        words = f"list_filter({words}, lambda t: t NOT IN ({STOPS_SQL}))"
    return (
        f"SELECT {cols}, CAST(generate_subscripts(_w, 1) - 1 AS INTEGER) AS pos, unnest(_w) AS term "
        f"FROM (SELECT {cols}, {words} AS _w FROM ({source}))"
    )


# ---- review pages rendered from documents: every line of a text is one review ----

SITE_BY_LANG = {"en": "webmd", "fr": "drugs", "de": "everydayhealth", "es": "drugratingz"}


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _webmd_review(line: Column, i: Column) -> Column:
    star = lambda k: _concat('<span class="current-rating">Current Rating: ', 1 + (i + k) % 5, "</span>")
    return _concat(
        '<div class="userPost"><div class="date">', 1 + i % 12, "/6/2010 10:10:35 PM</div>",
        '<p class="reviewerInfo">Reviewer: user ', i, " </p>", star(0), star(1), star(2),
        '<p id="comTrunc', i, '">...</p><p id="comFull', i, '"><strong>Comment:</strong>', escaped(line),
        "<a>Hide Full Comment</a></p></div>")


def _drugs_review(line: Column, i: Column) -> Column:
    user = F.when(i % 3 == 0, _concat('<span class="user-name user-type user-type-1_standard_member">member ', i, "</span>")) \
        .when(i % 3 == 1, _concat('<span class="user-name user-type user-type-2_non_member">guest ', i, "</span>")) \
        .otherwise("")
    score = F.when(i % 4 == 3, F.lit("")).otherwise(_concat('<div class="rating-score">', 1 + i % 10, ".0</div>"))
    return _concat(
        '<div class="ddc-comment"><p class="ddc-comment-content"><b>For pain:</b> <span>"', escaped(line),
        '"</span></p>', score, user, '<span class="comment-date text-color-muted">March ', 1 + i % 28,
        ", 2008</span></div>")


def _everydayhealth_review(line: Column, i: Column) -> Column:
    score = F.when(i % 4 == 3, F.lit("")).otherwise(_concat('<span itemprop="reviewRating">', 1 + i % 5, "</span>"))
    return _concat(
        '<div itemprop="review"><span class="time" content="5/', 1 + i % 28, '/2015 4:18:19 AM"></span>', score,
        '<p itemprop="reviewBody">', escaped(line), " Report</p></div>")


def _drugratingz_review(line: Column, i: Column) -> Column:
    star = lambda k: _concat('<td align="center" valign="top">', 1 + (i + k) % 5, "&nbsp;</td>")
    text = F.when(line == "", F.lit("<br>")).otherwise(
        _concat('<span class="description"> ', escaped(line), " </span>"))
    return _concat(
        '<tr class="ratingstable', F.when(i % 2 == 0, F.lit("odd")).otherwise("even"),
        '"><td valign="top"> 8/', 1 + i % 28, '/05&nbsp;</td><td valign="top"><a href="#">more</a></td>',
        star(0), star(1), star(2), star(3),
        '<td align="center" valign="top"><img src="x.png"></td><td>', text, "</td></tr>")


RENDER = {
    "webmd": (_webmd_review, "<div>", "</div>"),
    "drugs": (_drugs_review, "<div>", "</div>"),
    "everydayhealth": (_everydayhealth_review, "<div>", "</div>"),
    "drugratingz": (_drugratingz_review, "<table>", "</table>"),
}


def heading(site: str, name: Column) -> Column:
    return {
        "webmd": _concat("<h1>User Reviews &amp; Ratings - ", name, "</h1>"),
        "drugs": _concat("<h1>User Reviews for ", name, " (Page 1)</h1>"),
        "everydayhealth": _concat("<title>", name, " Reviews</title><span itemprop='name'>", name, "</span>"),
        "drugratingz": _concat("<title>", name, " reviews</title><h1>", name, " drug reviews</h1>"),
    }[site]


def page_html(site: str, name: Column, lines: Column) -> Column:
    review, start, end = RENDER[site]
    body = F.array_join(F.transform(lines, review), "")
    return _concat("<!DOCTYPE html><html><body>", heading(site, name), start, body, end, "</body></html>")


def review_pages(spark: SparkSession, sf: str, site: str) -> DataFrame:
    """(page_id, url, html): one page per document, one review per line, named after its source."""
    docs = documents(spark, sf)
    return docs.select(
        F.col("doc_id").alias("page_id"),
        _concat(SITE_PREFIXES[site], F.col("doc_id")).alias("url"),
        page_html(site, F.col("source"), F.split("text", "\n")).alias("html"),
    )


LINES_SQL = """
SELECT page_id, source, unnest(_l) AS line, CAST(generate_subscripts(_l, 1) - 1 AS INTEGER) AS i
FROM (SELECT doc_id AS page_id, source, string_split(text, chr(10)) AS _l FROM documents)"""

STRIP_SQL = r"'^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g'"

# ---- word vectors: all words, most frequent first ----


def word_vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """(term, idx, vec): a word's vector is picked from ``embeddings`` by the word's digest."""
    from pharmatext.operators.features import tokenize
    from pharmatext.plans.ranking import with_global_rank
    from pharmatext.plans.storage import materialize

    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = vectors.count()
    words = tokenize(texts(spark, sf)).groupBy(F.col("token").alias("term")).agg(F.count("pos").alias("n"))
    words = materialize(words, "words")
    ranked = with_global_rank(words, "n", "term", descending=True, name="idx")
    digest = F.conv(F.substring(F.md5(F.encode("term", "UTF-8")), 1, 8), 16, 10).cast("bigint")
    return ranked.withColumn("vec_id", digest % n).join(vectors, "vec_id").select("term", "idx", "vec")


WORD_VECTORS_SQL = f"""
SELECT term, idx, embedding AS vec FROM (
  SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS idx,
         ('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
  FROM (SELECT term, count(*) AS n FROM ({token_rows_sql(TEXTS_SQL)}) GROUP BY term)) JOIN embeddings USING (vec_id)"""
