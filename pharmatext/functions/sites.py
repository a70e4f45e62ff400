"""Rules of the four review sites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pharmatext.functions.fixed_values import PAGE_SIZE, SEARCH_URL, SITE_PREFIXES


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def by_site(site: Column, rules: dict[str, Column], default: Column | None = None) -> Column:
    choice = F.coalesce(*[F.when(site == name, value) for name, value in rules.items()])
    return choice if default is None else F.coalesce(choice, default)


def site_of(url: Column, prefixes: dict[str, str] = SITE_PREFIXES) -> Column:
    """Site whose address prefix the url has; null for any other url."""
    return F.coalesce(*[F.when(url.startswith(p), F.lit(s)) for s, p in prefixes.items()])


def element_text(html: Column, tag: str) -> Column:
    """Inner text of the first ``tag`` element of a page, null without one."""
    inner = F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    plain = F.regexp_replace(inner, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(html.contains(f"<{tag}"), plain)


def clean_comment(site: Column, comment: Column) -> Column:
    """Remove what each site's markup adds to a comment."""
    keep = F.greatest(F.length(comment) - 7, F.lit(0))
    return by_site(site, {
        "webmd": F.regexp_replace(comment, "Comment:|Hide Full Comment", ""),
        "drugs": F.replace(comment, F.lit('"'), F.lit("")),
        "everydayhealth": F.substring(comment, F.lit(1), keep),
        "drugratingz": strip(comment),
    })


def parse_star(text: Column) -> Column:
    """Number of a star text such as ``Current Rating: 4``; null where there is none."""
    return strip(F.replace(text, F.lit("Current Rating:"), F.lit(""))).try_cast("double")


def digits(text: Column | str) -> Column:
    """The digits of a text as a number; null without any, or if no number is that long."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def page_count(site: Column, total: Column) -> Column:
    """Number of review pages from the count that a front page states.

    ``total`` is the review count (webmd, drugs) or the page count itself (everydayhealth); null
    stands for "no reviews". drugratingz has all reviews on one page.
    """
    return by_site(site, {
        **{s: F.ceil(F.coalesce(total, F.lit(0)) / n) for s, n in PAGE_SIZE.items()},
        "everydayhealth": F.coalesce(total, F.lit(0)),
        "drugratingz": F.lit(1),
    }).cast("bigint")


def page_url(site: Column, url: Column, n: Column) -> Column:
    """Address of the n-th page (from 1) below a front page."""
    return by_site(site, {
        "webmd": F.concat(url, F.lit("&pageIndex="), (n - 1).cast("string"), F.lit("&sortby=3&conditionFilter=-1")),
        "drugs": F.concat(url, F.lit("?page="), n.cast("string")),
        "everydayhealth": F.concat(url, F.lit("/"), n.cast("string")),
        "drugratingz": url,
    })


def _escape(text: Column, kept: str) -> Column:
    """Each other character as ``%`` and its code point in lower-case hex."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(chars, lambda c: F.when(
        c.rlike(kept), c).otherwise(F.concat(F.lit("%"), F.lower(F.hex(F.ascii(c)))))), "")


def search_key(site: Column, name: Column) -> Column:
    """What a drug name becomes in the address of a site's search page."""
    low = F.lower(name)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return by_site(site, {
        "webmd": _escape(low, r"^[\p{L}\p{N}]$"),
        "drugs": _escape(F.array_join(words, "+"), r"^[\p{L}\p{N}+]$"),
        "everydayhealth": F.regexp_replace(low, r"\s+", "-"),
        "drugratingz": F.get(words, 0),
    })


def search_url(site: Column, name: Column) -> Column:
    key = search_key(site, name)
    return by_site(site, {
        s: F.concat(F.lit(start), key, F.lit(end)) for s, (start, end) in SEARCH_URL.items()
    })


def long_enough(name: Column) -> Column:
    """Names below four characters are not searched; the raw name counts."""
    return F.length(name) >= 4
