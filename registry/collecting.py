"""Pages to reviews, and names to pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pharmatext.functions import sites
from pharmatext.functions.fixed_values import SITE_PREFIXES
from pharmatext.operators import collect
from pharmatext.plans.storage import materialize, new_path
from pharmatext.sources.pages import stream_pages
from pharmatext.sources.tables import TASKS_PER_CORE, read_table
from pharmatext.streaming.jobs import collect_distinct_stream, collect_first_stream, collect_stream, first_reviews
from registry.common import (
    LINES_SQL, SITE_BY_LANG, STRIP_SQL, documents, heading, page_html, query, quoted, review_pages, table,
)

SITE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SITE_BY_LANG.items()) + " END"
PREFIX_SQL = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN {quoted(SITE_PREFIXES[v])}" for k, v in SITE_BY_LANG.items()) + " END"
ALL_SITES_SQL = "(VALUES " + ", ".join(f"('{s}')" for s in SITE_PREFIXES) + ") AS s(site)"


def site_by_lang():
    return sites.by_site(F.col("lang"), {k: F.lit(v) for k, v in SITE_BY_LANG.items()})


def every_site(df):
    return df.withColumn("site", F.explode(F.array(*[F.lit(s) for s in SITE_PREFIXES])))


# ---- page tests and columns ----

@query("route_site", f"""
SELECT doc_id AS page_id, {PREFIX_SQL} || doc_id AS url, {SITE_SQL} AS site FROM documents
UNION ALL SELECT page_id, url, NULL AS site FROM pages""")
def route_site(spark, sf):
    prefix = sites.by_site(F.col("lang"), {k: F.lit(SITE_PREFIXES[v]) for k, v in SITE_BY_LANG.items()})
    known = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(prefix, F.col("doc_id").cast("string")).alias("url"))
    other = table(spark, sf, "pages").select("page_id", "url")
    return collect.route_pages(known.unionByName(other)).select("page_id", "url", "site")


def front_pages(spark, sf):
    """Front pages of the site that goes with a document's language; good ones where quality is 1."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    site = site_by_lang()
    good = sites.by_site(site, {s: heading(s, F.col("source")) for s in SITE_PREFIXES})
    bad = F.concat(F.lit("<title>Error</title><h1>"), "source", F.lit(" not found</h1>"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("page_id"), site.alias("site"), "source",
        F.when(F.col("quality") == 1, good).otherwise(bad).alias("html"))


@query("page_is_reviews", f"""
SELECT doc_id AS page_id, {SITE_SQL} AS site, coalesce(quality = 1, false) AS is_reviews
FROM documents LEFT JOIN labels USING (doc_id)""")
def page_is_reviews(spark, sf):
    fronts = front_pages(spark, sf).withColumn("url", F.lit(""))
    return collect.page_facts(fronts).select("page_id", "site", "is_reviews")


TITLE_SQL = """replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""


@query("drug_name", f"""
SELECT doc_id AS page_id, {SITE_SQL} AS site,
       CASE WHEN quality = 1 THEN source
            WHEN lang = 'en' THEN source || ' not found' WHEN lang = 'fr' THEN NULL ELSE 'Error' END AS drug
FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL
SELECT page_id, 'everydayhealth', nullif(string_split_regex(regexp_replace({TITLE_SQL}, {STRIP_SQL}), '\\s+')[1], '')
FROM pages""")
def drug_name(spark, sf):
    titled = table(spark, sf, "pages").select("page_id", F.lit("everydayhealth").alias("site"), "html")
    both = front_pages(spark, sf).select("page_id", "site", "html").unionByName(titled)
    return collect.page_facts(both.withColumn("url", F.lit(""))).select("page_id", "site", "drug")


@query("rejected_pages", f"""
SELECT doc_id AS page_id, {PREFIX_SQL} || doc_id AS url, CASE WHEN quality = 0 THEN 'AssertionError' ELSE 'no page' END AS reason
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 0
UNION ALL SELECT -page_id - 1, url, 'unknown site' FROM pages""")
def rejected_pages(spark, sf):
    """Low-quality documents as pages with a declaration that no parser reads, unlabelled ones as pages not fetched."""
    prefix = sites.by_site(F.col("lang"), {k: F.lit(SITE_PREFIXES[v]) for k, v in SITE_BY_LANG.items()})
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    known = docs.select(
        F.col("doc_id").alias("page_id"), F.concat(prefix, F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("quality") == 0, F.concat(F.lit("<![text["), "text", F.lit("]]>"))).when(F.col("quality") == 1, F.concat(F.lit("<p>"), "text")).alias("html"))
    other = table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    found = collect.rejected_pages(known.unionByName(other))
    return found.withColumn("reason", F.regexp_replace("reason", "(?s):.*", ""))


# ---- reviews on pages: every document rendered as a page of the site ----

def extracted(spark, sf, site, **columns):
    found = collect.extract_reviews(review_pages(spark, sf, site), **columns)
    return found.drop("site")


def stars(found, names):
    return found.select(
        "page_id", "pos", "comment", "date_raw", "drug",
        *[F.col("rating_map")[n].alias(n.replace(" ", "_")) for n in names])


WEBMD_COMMENT_SQL = "regexp_replace(line, 'Comment:|Hide Full Comment', '', 'g')"
WEBMD_SQL = f"""
SELECT page_id, i AS pos, {WEBMD_COMMENT_SQL} AS comment, (1 + i % 12) || '/6/2010 10:10:35 PM' AS date_raw,
       source AS drug, CAST(1 + i % 5 AS DOUBLE) AS effectiveness,
       CAST(1 + (i + 1) % 5 AS DOUBLE) AS ease_of_use, CAST(1 + (i + 2) % 5 AS DOUBLE) AS satisfaction
FROM ({LINES_SQL})"""


@query("extract_webmd", WEBMD_SQL)
def extract_webmd(spark, sf):
    return stars(extracted(spark, sf, "webmd"), ["effectiveness", "ease of use", "satisfaction"])


@query("extract_drugs", f"""
SELECT page_id, i AS pos, replace(line, '"', '') AS comment, 'March ' || (1 + i % 28) || ', 2008' AS date_raw,
       source AS drug, CASE WHEN i % 4 <> 3 THEN CAST(1 + i % 10 AS DOUBLE) END AS rating_scalar
FROM ({LINES_SQL})""")
def extract_drugs(spark, sf):
    return extracted(spark, sf, "drugs").drop("rating_map")


@query("extract_everydayhealth", f"""
SELECT page_id, i AS pos, line AS comment, '5/' || (1 + i % 28) || '/2015 4:18:19 AM' AS date_raw,
       source AS drug, CASE WHEN i % 4 <> 3 THEN CAST(1 + i % 5 AS DOUBLE) END AS rating_scalar
FROM ({LINES_SQL})""")
def extract_everydayhealth(spark, sf):
    return extracted(spark, sf, "everydayhealth").drop("rating_map")


@query("extract_drugratingz", f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i % 2, i) - 1 AS INTEGER) AS pos,
       regexp_replace(line, {STRIP_SQL}) AS comment, '8/' || (1 + i % 28) || '/05' AS date_raw, source AS drug,
       CAST(1 + i % 5 AS DOUBLE) AS effectiveness, CAST(1 + (i + 1) % 5 AS DOUBLE) AS no_side_effects,
       CAST(1 + (i + 2) % 5 AS DOUBLE) AS convenience, CAST(1 + (i + 3) % 5 AS DOUBLE) AS value
FROM ({LINES_SQL}) WHERE line <> ''""")
def extract_drugratingz(spark, sf):
    return stars(extracted(spark, sf, "drugratingz"),
                 ["effectiveness", "no side effects", "convenience", "value"])


@query("clean_comment", f"""
SELECT page_id, site, CASE site
         WHEN 'webmd' THEN {WEBMD_COMMENT_SQL.replace('line', 'text')}
         WHEN 'drugs' THEN replace(text, '"', '')
         WHEN 'everydayhealth' THEN substr(text, 1, greatest(length(text) - 7, 0))
         ELSE regexp_replace(text, {STRIP_SQL}) END AS comment
FROM (SELECT doc_id AS page_id, ' Comment:' || text || chr(10) AS text FROM documents), {ALL_SITES_SQL}""")
def clean_comment(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(" Comment:"), "text", F.lit("\n")).alias("text"))
    return every_site(raw).select("page_id", "site", sites.clean_comment(F.col("site"), F.col("text")).alias("comment"))


@query("parse_star", """
SELECT doc_id AS id, CASE WHEN quality = 1 THEN CAST(n_chars % 11 AS DOUBLE) / 2 END AS stars
FROM documents LEFT JOIN labels USING (doc_id)""")
def parse_star(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = F.when(F.col("quality") == 1, F.format_string("Current Rating: %.1f\n", (F.col("n_chars") % 11) / 2)).when(
        F.col("quality") == 0, F.lit("Current Rating: none"))
    return docs.select(F.col("doc_id").alias("id"), sites.parse_star(raw).alias("stars"))


@query("optional_columns", f"""
SELECT page_id, i AS pos, 'webmd' AS site, {quoted(SITE_PREFIXES['webmd'])} || page_id AS url,
       'user ' || i AS user_id FROM ({LINES_SQL})
UNION ALL
SELECT page_id, i, 'drugs', {quoted(SITE_PREFIXES['drugs'])} || page_id,
       CASE i % 3 WHEN 0 THEN 'member ' || i WHEN 1 THEN 'guest ' || i END FROM ({LINES_SQL})""")
def optional_columns(spark, sf):
    pages = review_pages(spark, sf, "webmd").unionByName(review_pages(spark, sf, "drugs"))
    found = collect.extract_reviews(pages, collect_urls=True, collect_user_ids=True)
    return found.select("page_id", "pos", "site", "url", "user_id")


# ---- page counts and the frontier ----

def counted_fronts(spark, sf):
    """Fetched pages as front pages of every site; the paragraphs on a page are its review count."""
    n = (F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3
    return every_site(table(spark, sf, "pages").select("page_id", "url", n.cast("bigint").alias("total")))


COUNTED_SQL = f"""
SELECT page_id, site, url, CASE site WHEN 'webmd' THEN CAST(ceil(total / 5) AS BIGINT)
  WHEN 'drugs' THEN CAST(ceil(total / 25) AS BIGINT) WHEN 'everydayhealth' THEN total ELSE 1 END AS pages
FROM (SELECT page_id, url, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS total FROM pages),
     {ALL_SITES_SQL}"""


@query("page_count", f"SELECT page_id, site, pages FROM ({COUNTED_SQL})")
def page_count(spark, sf):
    return counted_fronts(spark, sf).select(
        "page_id", "site", sites.page_count(F.col("site"), F.col("total")).alias("pages"))


@query("page_frontier", f"""
SELECT site, url, CAST(i - 1 AS INTEGER) AS page_no, CASE site
         WHEN 'webmd' THEN url || '&pageIndex=' || (i - 1) || '&sortby=3&conditionFilter=-1'
         WHEN 'drugs' THEN url || '?page=' || i
         WHEN 'everydayhealth' THEN url || '/' || i ELSE url END AS page_url
FROM (SELECT site, url, unnest(range(1, pages + 1)) AS i FROM ({COUNTED_SQL}))""")
def page_frontier(spark, sf):
    fronts = counted_fronts(spark, sf).select(
        "site", "url", sites.page_count(F.col("site"), F.col("total")).alias("pages"))
    return collect.page_frontier(fronts)


def total_html(site, total):
    """How a site states a review count (or, for everydayhealth, a page count); nothing for 0."""
    n = total.cast("string")
    some = sites.by_site(site, {
        "webmd": F.concat(F.lit('<div id="heading">Reviews</div><span class="totalreviews">'), n, F.lit(" Total Reviews</span>")),
        "drugs": F.concat(
            F.lit('<table class="data-list ddc-table-sortable"><tbody><tr><th>9</th></tr></tbody><tfoot><tr><th>All</th><th>8.1</th><th>'),
            n, F.lit(" reviews</th></tr></tfoot></table>")),
        "everydayhealth": F.concat(
            F.lit('<div class="review-details clearfix"><h5><span itemprop="reviewCount">7</span></h5></div>'
                  '<div class="review-pagination"><section class="review-pagination__section--info">Page 1/ '),
            n, F.lit(" pages</section></div>")),
        "drugratingz": F.lit(""),
    })
    none = F.lit('<div id="heading">Be the first to share your experience with this treatment.</div>')
    return F.when(total > 0, some).otherwise(none)


@query("front_page_facts", f"""
SELECT doc_id AS page_id, {SITE_SQL} AS site, coalesce(quality = 1, false) AS is_reviews,
       CASE WHEN quality = 1 THEN CASE lang WHEN 'en' THEN CAST(ceil(total / 5) AS BIGINT)
              WHEN 'fr' THEN CAST(ceil(total / 25) AS BIGINT) WHEN 'de' THEN total ELSE 1 END
            ELSE 0 END AS pages
FROM (SELECT *, len(string_split(text, chr(10))) - 1 AS total FROM documents) LEFT JOIN labels USING (doc_id)""")
def front_page_facts(spark, sf):
    """Front pages with a count in each site's markup: the line breaks of the document."""
    totals = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), (F.size(F.split("text", "\n")) - 1).alias("total"))
    site = F.col("site")
    prefix = sites.by_site(site, {s: F.lit(p) for s, p in SITE_PREFIXES.items()})
    fronts = front_pages(spark, sf).join(totals, "page_id").select(
        "page_id", F.concat(prefix, F.col("page_id").cast("string")).alias("url"),
        F.concat("html", total_html(site, F.col("total"))).alias("html"))
    return collect.front_pages(fronts).select("page_id", "site", "is_reviews", "pages")


# ---- names ----

H1_SQL = TITLE_SQL.replace("title", "h1")
ESCAPE_SQL = (
    "array_to_string(list_transform(regexp_extract_all({s}, '(?s).'), lambda c: CASE WHEN "
    "regexp_matches(c, '{keep}') THEN c ELSE '%' || format('{{:x}}', unicode(c)) END), '')"
)
WORDS_SQL = r"list_filter(string_split_regex(lower(name), '\s+'), lambda w: w <> '')"


@query("search_key", f"""
SELECT id, site, CASE site
  WHEN 'webmd' THEN {ESCAPE_SQL.format(s="lower(name)", keep=r"^[\p{L}\p{N}]$")}
  WHEN 'drugs' THEN {ESCAPE_SQL.format(s=f"array_to_string({WORDS_SQL}, '+')", keep=r"^[\p{L}\p{N}+]$")}
  WHEN 'everydayhealth' THEN regexp_replace(lower(name), '\\s+', '-', 'g')
  ELSE {WORDS_SQL}[1] END AS key
FROM (SELECT page_id AS id, {H1_SQL} AS name FROM pages
      UNION ALL SELECT -p_partkey, p_name || '  ' || p_brand || ' ' FROM part), {ALL_SITES_SQL}""")
def search_key(spark, sf):
    titles = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), sites.element_text(F.col("html"), "h1").alias("name"))
    parts = table(spark, sf, "part").select(
        (-F.col("p_partkey")).alias("id"), F.concat("p_name", F.lit("  "), "p_brand", F.lit(" ")).alias("name"))
    named = every_site(titles.unionByName(parts))
    return named.select("id", "site", sites.search_key(F.col("site"), F.col("name")).alias("key"))


def part_names(spark, sf):
    """Names asked for: the part names and their single words."""
    words = table(spark, sf, "part").select(
        F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("name"))
    return words.distinct()


PART_NAMES_SQL = (
    "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part "
    "UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)"
)


@query("name_length_filter", f"SELECT name FROM ({PART_NAMES_SQL}) WHERE length(name) >= 4")
def name_length_filter(spark, sf):
    return part_names(spark, sf).filter(sites.long_enough(F.col("name")))


def search_pages(spark, sf):
    """Search result pages of each site for the part names, one page per part.

    On drugratingz a page lists the part and a lesser hit. Elsewhere the part key decides what the
    page shows; on webmd an odd key gives a direct link and an even one a page between.
    """
    parts = read_table(spark, f"{sf}/part.parquet", "p_partkey").select("p_partkey", F.col("p_name").alias("name"), "p_size")
    key, size, odd = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_partkey") % 2 == 1
    row = lambda kind, href, n: F.concat(
        F.lit('<tr class="ratingstable'), kind, F.lit('"><td align="center">a</td><td align="center">b</td>'
              '<td align="center"> <a href="'), href, F.lit('">'), n.cast("string"), F.lit(" </a></td></tr>"))
    html = sites.by_site(F.col("site"), {
        "webmd": F.when(odd, F.concat(F.lit('<a class="drug-review" href="/drugs/drugreview-'), key, F.lit('">r</a>')))
        .otherwise(F.concat(F.lit('<ul class="exact-match"><li><a href="/drugs/drug-'), key, F.lit('">x</a></li></ul>'))),
        "drugs": F.when(odd, F.concat(F.lit('<p class="user-reviews-title mgb-1"><a href="/comments/'), key, F.lit('">r</a></p>')))
        .otherwise(F.lit("<p>none</p>")),
        "everydayhealth": F.when(odd, F.lit("<title>Drug Reviews | Site</title>")).otherwise(F.lit("<title>Reviews-less</title>")),
        "drugratingz": F.concat(
            F.lit("<table>"), row(F.lit("odd"), F.concat(F.lit("/reviews/"), key), size),
            row(F.lit("even"), F.lit("/reviews/0"), size - 1), F.lit("</table>")),
    })
    return every_site(parts).select(
        F.col("p_partkey").alias("page_id"), "site", "name",
        sites.search_url(F.col("site"), F.col("name")).alias("url"), html.alias("html"))


@query("search_page_hits", """
WITH ranked AS (
  SELECT p_name AS name, p_partkey AS key, p_partkey % 2 = 1 AS odd,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth,
         row_number() OVER (PARTITION BY p_name, p_partkey % 2 ORDER BY p_partkey) AS nth_of_kind,
         row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS nth_by_size FROM part)
SELECT 'webmd' AS site, name, 'https://www.webmd.com/drugs/drugreview-' || key AS url FROM ranked WHERE nth = 1
UNION ALL SELECT 'drugs', name, 'https://www.drugs.com/comments/' || key FROM ranked WHERE odd AND nth_of_kind = 1
UNION ALL SELECT 'everydayhealth', name, 'https://www.everydayhealth.com/drugs/' || replace(name, ' ', '-') || '/reviews'
FROM ranked WHERE odd AND nth_of_kind = 1
UNION ALL SELECT 'drugratingz', name, 'https://www.drugratingz.com/reviews/' || key FROM ranked WHERE nth_by_size = 1""")
def search_page_hits(spark, sf):
    """The best hit per site and name, read from the sites' result pages."""
    results = search_pages(spark, sf)
    number = F.col("page_id").cast("string")
    between = results.filter(F.col("html").contains("exact-match")).select(
        "page_id", F.concat(F.lit("https://www.webmd.com/drugs/drug-"), number).alias("url"),
        F.concat(F.lit('<a class="drug-review" href="/drugs/drugreview-'), number, F.lit('">r</a>')).alias("html"))
    hits = collect.follow_hops(materialize(collect.search_hits(results), "hits"), between)
    ordered = hits.withColumn("name", F.struct("site", "name")).withColumn("pos", F.col("page_id").cast("decimal(19,0)") * (1 << 31) + F.col("pos"))
    return collect.best_candidates(ordered).select("name.site", "name.name", "url")


def candidates(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("n_reviews"),
        F.concat(F.lit("/reviews/"), F.col("p_partkey").cast("string")).alias("url"))


BEST_SQL = """
SELECT name, url, n_reviews FROM (
  SELECT p_name AS name, '/reviews/' || p_partkey AS url, p_size AS n_reviews,
         row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1"""


@query("resolve_search", BEST_SQL)
def resolve_search(spark, sf):
    return collect.best_candidates(candidates(spark, sf))


@query("resolve_names", f"SELECT name, url FROM ({PART_NAMES_SQL}) LEFT JOIN ({BEST_SQL}) USING (name)")
def resolve_names(spark, sf):
    return collect.resolve_names(part_names(spark, sf), candidates(spark, sf))


@query("names_not_found", f"SELECT name FROM ({PART_NAMES_SQL}) WHERE name NOT IN (SELECT p_name FROM part)")
def names_not_found(spark, sf):
    return collect.names_not_found(part_names(spark, sf), candidates(spark, sf))


# ---- growing a dataset ----

@query("append_reviews", """
SELECT doc_id AS id, text AS comment, source AS drug, NULL AS user_id FROM documents
UNION ALL SELECT conv_id * 1000 + turn, text, NULL, role FROM conversations""")
def append_reviews(spark, sf):
    stored = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment"), F.col("source").alias("drug"))
    new = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("comment"),
        F.col("role").alias("user_id"))
    return collect.append_reviews(stored, new)


@query("incremental_collect", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https:%')")
def incremental_collect(spark, sf):
    pages = table(spark, sf, "pages")
    done = pages.select("url").filter(F.col("url").startswith("https:"))
    return collect.pages_to_do(pages, done).select("page_id", "url")


@query("overwrite_collect", f"SELECT drug, count(*) AS n FROM ({WEBMD_SQL}) GROUP BY drug")
def overwrite_collect(spark, sf):
    """Collecting twice into one place leaves the rows of one run."""
    path = new_path(spark, "collected")
    for _ in range(2):
        collect.extract_reviews(review_pages(spark, sf, "webmd")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("drug").agg(F.count(F.lit(1)).alias("n"))


@query("collect_from_names", f"""
SELECT drug, doc AS front, page_no, comment FROM (
  SELECT source AS drug, page_id AS doc, CAST(i // 5 AS INTEGER) AS page_no, {WEBMD_COMMENT_SQL} AS comment
  FROM ({LINES_SQL}))
WHERE doc IN (SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY len(string_split(text, chr(10))) DESC, doc_id) AS rn
  FROM documents WHERE length(source) >= 4) WHERE rn = 1)""")
def collect_from_names(spark, sf):
    """Each source is a drug name, each document of it a hit; its lines are its reviews, five a page."""
    docs = documents(spark, sf).select("doc_id", "source", F.split("text", "\n").alias("lines"))
    front = F.concat(F.lit(SITE_PREFIXES["webmd"]), F.col("doc_id").cast("string"))
    total = F.size("lines").cast("bigint")
    names = docs.select(F.col("source").alias("name")).distinct()
    hits = docs.select(F.col("source").alias("name"), F.col("doc_id").alias("pos"),
                       total.alias("n_reviews"), front.alias("url"))
    fronts = docs.select(front.alias("url"), F.lit("webmd").alias("site"), total.alias("total"))
    count = sites.page_count(F.lit("webmd"), total)
    five = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda n: F.struct(
        sites.page_url(F.lit("webmd"), front, n).alias("url"), F.slice("lines", n * 5 - 4, F.lit(5)).alias("lines")))
    paged = docs.select("doc_id", "source", F.posexplode(five).alias("no", "page"))
    fetched = paged.select(
        (F.col("doc_id") * 100000 + F.col("no")).alias("page_id"), "page.url",
        page_html("webmd", F.col("source"), F.col("page.lines")).alias("html"))
    found = collect.collect_from_names(names, hits, fronts, fetched)
    return found.select("drug", F.floor(F.col("page_id") / 100000).alias("front"),
                        (F.col("page_id") % 100000).cast("int").alias("page_no"), "comment")


# ---- streams ----

def _landed(spark, sf):
    """A folder with the rendered pages. Larger tables give larger files, not more: each batch of a stream costs a commit
    of every state partition, so the number of batches must not grow with the table."""
    files = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return materialize(review_pages(spark, sf, "webmd").coalesce(files), "landed").inputFiles()[0].rsplit("/", 1)[0]


@query("stream_collect", WEBMD_SQL)
def stream_collect(spark, sf):
    output, checkpoint = new_path(spark, "stream_out"), new_path(spark, "stream_state")
    pages = stream_pages(spark, _landed(spark, sf), files_per_batch=8)
    collect_stream(pages, output, checkpoint).awaitTermination()
    return stars(spark.read.parquet(output), ["effectiveness", "ease of use", "satisfaction"])


@query("stream_collect_distinct", f"SELECT DISTINCT {WEBMD_COMMENT_SQL} AS comment FROM ({LINES_SQL})")
def stream_collect_distinct(spark, sf):
    output, checkpoint = new_path(spark, "stream_out"), new_path(spark, "stream_state")
    pages = stream_pages(spark, _landed(spark, sf), files_per_batch=8)
    collect_distinct_stream(pages, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).select("comment")


@query("stream_collect_first", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY comment ORDER BY page_id, pos) AS rn FROM ({WEBMD_SQL})) WHERE rn = 1""")
def stream_collect_first(spark, sf):
    """Pages arrive in batches in no order; of each comment the first review of all stays."""
    output, checkpoint = new_path(spark, "stream_out"), new_path(spark, "stream_state")
    collect_first_stream(stream_pages(spark, _landed(spark, sf), files_per_batch=2), output, checkpoint).awaitTermination()
    return stars(first_reviews(spark, output), ["effectiveness", "ease of use", "satisfaction"])
