"""Collecting reviews from a table of fetched pages, and finding the pages to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.functions import markup, sites
from pharmatext.functions.fixed_values import DRUGRATINGZ_STARS, SITE_PREFIXES, WEBMD_STARS
from pharmatext.plans.joins import BROADCAST_BYTES, join_measured


def route_pages(pages: DataFrame, prefixes: dict[str, str] = SITE_PREFIXES) -> DataFrame:
    """Add ``site``; pages of no known site have a null there."""
    return pages.withColumn("site", sites.site_of(F.col("url"), prefixes))


def _readable(pages: DataFrame) -> DataFrame:
    """``(page_id, site, url, html)`` of pages of known sites. Pages not fetched are passed over where pages are read:
    a filter here would be evaluated below whatever makes ``html``, so every page would be made twice."""
    known = pages if "site" in pages.columns else route_pages(pages)
    return known.filter(F.col("site").isNotNull()).select("page_id", "site", "url", "html")


def page_facts(pages: DataFrame) -> DataFrame:
    """``(page_id, site, url, drug, is_reviews, total_raw, error)`` of pages of known sites, from their markup."""
    return _readable(pages).mapInArrow(markup.fact_batches, markup.FACT_SCHEMA)


def rejected_pages(pages: DataFrame, prefixes: dict[str, str] = SITE_PREFIXES) -> DataFrame:
    """``(page_id, url, reason)`` of pages that can give no reviews: their address belongs to no known site,
    nothing was fetched, or the parser cannot read them."""
    routed = route_pages(pages, prefixes)
    unrouted = routed.filter(F.col("site").isNull()).select("page_id", "url", F.lit("unknown site").alias("reason"))
    empty = routed.filter(F.col("site").isNotNull() & F.col("html").isNull()).select("page_id", "url", F.lit("no page").alias("reason"))
    broken = page_facts(routed).filter(F.col("error").isNotNull()).select("page_id", "url", F.col("error").alias("reason"))
    return unrouted.unionByName(empty).unionByName(broken)


def _star_map(names: list[str]) -> Column:
    """Map of the star names to the stars found; the shorter of the two lists wins."""
    values = F.transform(F.col("stars"), sites.parse_star)
    n = F.least(F.size("stars"), F.lit(len(names)))
    keys = F.array(*[F.lit(x) for x in names])
    return F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))


def extract_reviews(
    pages: DataFrame, collect_urls: bool = False, collect_user_ids: bool = False
) -> DataFrame:
    """Reviews on pages ``(page_id, url, html)``, one scan and no shuffle.

    Pages of no known site, without reviews, or that cannot be read (see ``rejected_pages``) give no
    rows. ``pos`` is the review's place on its page.
    """
    site = F.col("site")
    raw = _readable(pages).mapInArrow(markup.extract_batches, markup.RAW_SCHEMA).filter(F.col("error").isNull())
    user = F.col("user_raw")
    reviews = raw.select(
        "page_id", "pos", "site",
        sites.clean_comment(site, F.col("comment_raw")).alias("comment"),
        sites.by_site(site, {
            "webmd": _star_map(WEBMD_STARS), "drugratingz": _star_map(DRUGRATINGZ_STARS),
        }).alias("rating_map"),
        F.when(site.isin("drugs", "everydayhealth"), sites.parse_star(F.get("stars", 0)))
        .alias("rating_scalar"),
        F.when(site == "drugratingz", sites.strip(F.replace("date_raw", F.lit("\u00a0"), F.lit(" ")))).otherwise(F.col("date_raw")).alias("date_raw"),
        "drug", "url",
        F.when(site == "webmd", sites.strip(F.replace(user, F.lit("Reviewer: "), F.lit(""))))
        .otherwise(user).alias("user_id"),
    )
    unwanted = ([] if collect_urls else ["url"]) + ([] if collect_user_ids else ["user_id"])
    return reviews.drop(*unwanted)


FRONTIER_CHUNK = 1000


def page_frontier(fronts: DataFrame) -> DataFrame:
    """Front pages ``(site, url, pages)`` to one row per page to fetch; 0 pages give no row.

    Numbers are made in chunks, so a page that claims very many is no large array.
    """
    n = F.col("pages").cast("bigint")
    chunks = fronts.filter(n > 0).select("site", "url", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / FRONTIER_CHUNK))).alias("_c"))
    first = F.col("_c") * FRONTIER_CHUNK
    numbers = chunks.select("site", "url", F.explode(F.sequence(first, F.least(first + FRONTIER_CHUNK, F.col("_n")) - 1)).alias("_k"))
    return numbers.select("site", "url", F.col("_k").try_cast("int").alias("page_no"), sites.page_url(F.col("site"), F.col("url"), F.col("_k") + 1).alias("page_url"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Search hits ``(name, pos, n_reviews, url)`` to one url per name.

    Most reviews win, the earlier hit among equals. The maximum is combined before the shuffle, so
    a name with very many hits stays cheap.
    """
    best = F.max_by(F.struct("url", "n_reviews"), F.struct(F.col("n_reviews"), -F.col("pos")))
    return candidates.groupBy("name").agg(best.alias("_b")).select("name", "_b.url", "_b.n_reviews")


def _per_name(names: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join a name list with a table unique on ``name``: repeated names meet it once."""
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    joined = counted.join(table, "name", how)
    # copies come back in two steps, chunks and then rows, with the chunks dealt out in between
    chunks = joined.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / FRONTIER_CHUNK))))
    part = F.least(F.lit(FRONTIER_CHUNK).cast("bigint"), F.col("_n") - F.col("_c") * FRONTIER_CHUNK)
    return chunks.hint("rebalance").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), part))).drop("_n", "_c", "_i")


def resolve_names(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every name of the list ``(name)`` with its url, null for a name too short or without a hit."""
    hits = best_candidates(candidates.filter(sites.long_enough(F.col("name"))))
    return _per_name(names, hits.select("name", "url"), "left")


def names_not_found(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names of the list without a url."""
    found = candidates.filter(sites.long_enough(F.col("name")) & F.col("url").isNotNull())
    return _per_name(names, found.select("name").distinct(), "left_anti")


def append_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows, columns united by name."""
    return stored.unionByName(new, allowMissingColumns=True)


def pages_to_do(pages: DataFrame, done: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Pages whose url was not collected before; the rest of an interrupted run."""
    urls = done.select("url").distinct()
    return join_measured(pages, urls, "url", "left_anti", limit)


def pages_of(pages: DataFrame, urls: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Fetched pages whose url is in a list."""
    wanted = urls.select("url").distinct()
    return join_measured(pages, wanted, "url", "left_semi", limit)


def collect_from_names(
    names: DataFrame, candidates: DataFrame, fronts: DataFrame, pages: DataFrame, **columns: bool
) -> DataFrame:
    """Names -> front page urls -> page urls -> fetched pages -> reviews.

    ``fronts`` holds ``(url, site, total)`` of the front pages, ``pages`` the fetched pages.
    """
    found = resolve_names(names, candidates).filter(F.col("url").isNotNull()).select("url").distinct()
    site = F.col("site")
    wanted = page_frontier(
        found.join(fronts, "url").select("site", "url", sites.page_count(site, F.col("total")).alias("pages"))
    )
    return extract_reviews(pages_of(pages, wanted.select(F.col("page_url").alias("url"))), **columns)


def front_pages(pages: DataFrame) -> DataFrame:
    """What front pages ``(page_id, url, html)`` say: site, whether they show reviews, drug, pages.

    A page that fails its site's test has 0 pages.
    """
    site, told = F.col("site"), page_facts(pages)
    pages_told = F.when(F.col("is_reviews"), sites.page_count(site, sites.digits("total_raw"))).otherwise(0)
    return told.select("page_id", "site", "url", "drug", "is_reviews", pages_told.cast("bigint").alias("pages"))


def search_hits(results: DataFrame) -> DataFrame:
    """Search result pages ``(page_id, site, name, url, html)`` to hits.

    Gives ``(page_id, site, name, pos, n_reviews, url, is_hop)``: a hop leads to one more page that
    links to the reviews. ``best_candidates`` picks one hit per name.
    """
    raw = results.select("page_id", "site", "name", "url", "html").mapInArrow(
        markup.search_batches, markup.SEARCH_SCHEMA)
    return raw.select(
        "page_id", "site", "name", "pos",
        F.coalesce(sites.digits("n_raw"), F.lit(0)).alias("n_reviews"), "url", "is_hop")


def follow_hops(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Replace each hop by the first review link of the page it leads to; dead ends drop."""
    hops = hits.filter("is_hop")
    landed = pages_of(pages, hops).select(
        "page_id", F.lit("webmd").alias("site"), F.col("url").alias("name"), "url", "html")
    links = search_hits(landed).filter(~F.col("is_hop")).groupBy(F.col("name").alias("url")).agg(
        F.min_by("url", "page_id").alias("_to"))
    moved = join_measured(hops, links, "url", "inner")
    moved = moved.withColumn("url", F.col("_to")).withColumn("is_hop", F.lit(False)).select(*hits.columns)
    return hits.filter(~F.col("is_hop")).unionByName(moved)
