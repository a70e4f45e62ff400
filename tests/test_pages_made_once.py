"""Pages are made once on their way to the parser, and tags in single quotes are plain too."""

from html.parser import HTMLParser

import pytest

from pharmatext.functions import markup
from pharmatext.operators import collect
from registry.common import review_pages, table
from test_page_speed import by_parser, tree

SINGLE = [
    "<span itemprop='name'>X</span><p class=\"a\" id='b \"c\"'>y</p>",
    "<p class='a' class=\"b\">x &amp; y</p><template>a<template>b</template>c</template>d<br>",
    "<div><template>never <i>closed<p>x</p></div>",
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("site", list(markup.SITES))
def test_pages_are_rendered_once(spark, sf, site):
    found = collect.extract_reviews(review_pages(spark, sf, site), True, True)
    assert plan(found).count("array_join(") == 1


def test_stars_are_read_once(spark, sf):
    found = collect.extract_reviews(table(spark, sf, "pages").select("page_id", "url", "html")).select("rating_map")
    assert plan(found).count("transform(") == 2  # one for each of the two sites with a map


@pytest.mark.parametrize("html", SINGLE)
def test_single_quotes_are_plain(monkeypatch, html):
    wanted = by_parser(monkeypatch, html)
    monkeypatch.setattr(HTMLParser, "feed", lambda *a: pytest.fail("parser used"))
    assert tree(markup.parse(html)) == wanted


@pytest.mark.parametrize("html", ["<p<b>x</b>", "<p>x</p >", "<p a='<'>x</p>", "<p a='>'>x</p>", "<p a='b\">x</p>", "<textarea><b></textarea>", "<p>a</p", "<p></p/>", "<>a<p>"])
def test_what_is_not_plain_goes_to_the_parser(monkeypatch, html):
    assert markup._plain_tags(html) is None
    assert tree(markup.parse(html)) == by_parser(monkeypatch, html)


def test_the_tags_kept_are_bounded(monkeypatch):
    for k in range(20_000):
        markup.parse(f'<p id="a{k}">b &amp; {k}</p>')
    assert len(markup._tag.__self__) <= 1 << 13 and len(markup._unescaped.__self__) <= 1 << 13
