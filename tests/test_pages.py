"""Hand-made pages of the four sites: the cases that the site tests look at."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pharmatext.functions.markup import Where, parse
from pharmatext.operators import collect
from pharmatext.operators.clean import dedup_text
from pharmatext.plans.dataset import ReviewDataset, number_reviews
from pharmatext.sources.pages import PAGE_SCHEMA, stream_pages
from pharmatext.streaming.jobs import collect_distinct_stream, collect_first_stream, collect_stream, first_reviews

W = "https://www.webmd.com/drugs/drugreview-8953-x"
D = "https://www.drugs.com/comments/aripiprazole/abilify.html"
E = "https://www.everydayhealth.com/drugs/actos/reviews"
R = "https://www.drugratingz.com/reviews/141/Drug-Prednisone.html"


def webmd_review(i, text="fine"):
    return f"""<div class="userPost"><div class="date">10/{i}/2010 10:10:35 PM</div>
      <p class="reviewerInfo">Reviewer: A{i}, 13-18 Female  (Patient) </p>
      <span class="current-rating">Current Rating: 5</span><span class="current-rating">Current Rating: 4 </span>
      <span class="current-rating">Current Rating: {1 + i % 5}</span>
      <p id="comTrunc{i}">cut</p><p id="comFull{i}"><strong>Comment:</strong>{text} {i} &amp; more<br>line
      <a>Hide Full Comment</a></p></div>"""


def webmd_page(n, h1="User Reviews &amp; Ratings - ABILIFY"):
    return f"<html><h1>{h1}</h1><!-- <div class='userPost'> -->{''.join(map(webmd_review, range(n)))}</html>"


def pages(spark, *found):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(found)], PAGE_SCHEMA)


def test_webmd_values(spark):
    got = collect.extract_reviews(pages(spark, (W, webmd_page(5))), True, True).orderBy("pos").collect()
    assert len(got) == 5
    first = got[0]
    assert first.comment.split() == ["fine", "0", "&", "moreline"]
    assert first.rating_map == {"effectiveness": 5.0, "ease of use": 4.0, "satisfaction": 1.0}
    assert first.date_raw == "10/0/2010 10:10:35 PM" and first.drug == "ABILIFY"
    assert first.user_id == "A0, 13-18 Female  (Patient)" and first.url == W


def test_optional_columns_are_off_by_default(spark):
    found = pages(spark, (W, webmd_page(1)))
    assert not {"url", "user_id"} & set(collect.extract_reviews(found).columns)
    assert {"url", "user_id"} <= set(collect.extract_reviews(found, True, True).columns)


def test_unknown_sites_and_empty_pages_give_no_rows(spark):
    found = pages(spark, ("https://elsewhere.org/x", webmd_page(3)), (W, webmd_page(0)), (W, None), (D, "<p>"))
    assert collect.extract_reviews(found).count() == 0
    assert rows(collect.rejected_pages(found), "page_id", "reason") == [(0, "unknown site"), (2, "no page")]


def test_odd_pages_do_not_end_the_job(spark):
    broken = (W, "<![foo[" + webmd_page(2) + "]]>")
    upper = (W, webmd_page(2, "User Reviews &amp; Ratings - St. John&#39;s Wort&reg;").replace("h1>", "H1>"))
    commented = (W, "<!-- <h1>User Reviews &amp; Ratings - Old</h1> -->" + webmd_page(1, "User Reviews &amp; Ratings - New"))
    found = pages(spark, broken, upper, commented)
    got = collect.extract_reviews(found).groupBy("page_id", "drug").count().orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "St. John's Wort\u00ae", 2), (2, "New", 1)]
    facts = {r.page_id: (r.is_reviews, r.error is None) for r in collect.page_facts(found).collect()}
    assert facts == {0: (False, False), 1: (True, True), 2: (True, True)}
    assert rows(collect.rejected_pages(found), "page_id") == [(0,)]


def test_huge_counts(spark):
    html = webmd_page(0) + f'<div id="heading">x</div><span class="totalreviews">{"9" * 24} reviews</span>'
    assert collect.front_pages(pages(spark, (W, html))).first().pages == 0
    fronts = spark.createDataFrame([("drugs", "d", 250_000_000)], "site string, url string, pages bigint")
    assert collect.page_frontier(fronts).limit(3).count() == 3
    small = spark.createDataFrame([("drugs", "d", 2500)], "site string, url string, pages bigint")
    numbers = sorted(r.page_no for r in collect.page_frontier(small).collect())
    assert numbers == list(range(2500))


def test_drugs_nullable_rating_and_user_classes(spark):
    def review(i, rating, user):
        score = f'<div class="rating-score">{rating}</div>' if rating else ""
        return (f'<div class="ddc-comment"><p class="ddc-comment-content"><b>For x:</b><span>"It \'s "ok" {i}"</span></p>'
                f'{score}{user}<span class="comment-date text-color-muted">March {i}, 2008</span></div>')

    member = '<span class="user-name user-type user-type-1_standard_member">m</span>'
    guest = '<span class="user-name user-type user-type-2_non_member">g</span>'
    html = "<h1>User Reviews for Abilify Maintena (Page 1)</h1>" + review(1, "9.0", guest + member) + review(2, None, guest) + review(3, "1.5", "")
    got = collect.extract_reviews(pages(spark, (D, html)), True, True).orderBy("pos").collect()
    assert [r.comment for r in got] == ["It 's ok 1", "It 's ok 2", "It 's ok 3"]
    assert [r.rating_scalar for r in got] == [9.0, None, 1.5]
    assert [r.user_id for r in got] == ["m", "g", None]
    assert {r.drug for r in got} == {"Abilify"} and {r.rating_map is None for r in got} == {True}


def test_everydayhealth_tail_and_scalar(spark):
    html = """<title>Actos User Reviews</title><span itemprop="name">Actos</span>
      <div itemprop="review"><span itemprop="reviewRating">4</span><span class="big time" content="5/22/2015 4:18:19 AM"></span>
      <p itemprop="reviewBody">Works well Report</p></div>
      <div itemprop="review"><span class="time" content="x"></span><p itemprop="reviewBody">abc</p></div>"""
    got = collect.extract_reviews(pages(spark, (E, html))).orderBy("pos").collect()
    assert [(r.comment, r.rating_scalar, r.date_raw, r.drug) for r in got] == [
        ("Works well", 4.0, "5/22/2015 4:18:19 AM", "Actos"), ("", None, "x", "Actos")]


def test_drugratingz_order_and_nbsp(spark):
    def row(kind, text, stars="1&nbsp;"):
        cells = "".join(f'<td align="center" valign="top">{stars}</td>' for _ in range(4))
        said = f'<span class="description"> {text} </span>' if text else ""
        return (f'<tr class="ratingstable{kind}"><td valign="top">&nbsp;8/18/05</td><td align="center" valign="top"><a>r</a></td>'
                f"{cells}<td align='center'>no valign</td><td>{said}</td></tr>")

    html = "<title>Prednisone Reviews</title><h1>Prednisone drug reviews</h1><table>" + row("even", "second") + row("odd", "first", "3") + row("odd", "") + "</table>"
    got = collect.extract_reviews(pages(spark, (R, html))).orderBy("pos").collect()
    assert [r.comment for r in got] == ["first", "second"]
    assert got[0].rating_map == {"effectiveness": 3.0, "no side effects": 3.0, "convenience": 3.0, "value": 3.0}
    assert got[1].rating_map["value"] == 1.0 and got[0].date_raw == "8/18/05" and got[0].drug == "Prednisone"


@pytest.mark.parametrize("url, html, pages_told", [
    (W, webmd_page(0) + '<div id="heading">x</div><span class="totalreviews">11 Total User Reviews</span>', 3),
    (W, webmd_page(0) + '<div id="heading">Be the first to share your experience with this treatment.</div>', 0),
    (W, webmd_page(0, "Something else") + '<div id="heading">x</div><span class="totalreviews">11</span>', 0),
    (W, "<p>no heading</p>", 0),
    (D, '<h1>User Reviews for X (Page 1)</h1><table class="data-list ddc-table-sortable"><tfoot><tr><th>a<th>b</th></th><th>1,026 reviews</th></tr></tfoot></table>', 42),
    (D, "<h1>User Reviews for X</h1>", 0),
    (D, "<h1>Page not found</h1>", 0),
    (E, '<title>X Reviews</title><span itemprop="name">X</span><div class="review-details clearfix"></div><div class="review-pagination"><section class="review-pagination__section--info">Page 1/ 4 x</section></div>', 4),
    (E, '<title>X Reviews</title><span itemprop="name">X</span>', 0),
    (E, "<title>X Reviews</title>", 0),
    (R, "<title>X</title><h1>X drug reviews</h1>", 1),
    (R, "<title>X</title><h1>Error</h1>", 0),
])
def test_front_pages(spark, url, html, pages_told):
    assert collect.front_pages(pages(spark, (url, html))).first().pages == pages_told


def test_page_frontier_forms(spark):
    fronts = spark.createDataFrame([("webmd", "w", 2), ("drugs", "d", 2), ("everydayhealth", "e", 1), ("drugratingz", "r", 1), ("drugs", "none", 0)],
                                   "site string, url string, pages bigint")
    assert rows(collect.page_frontier(fronts), "page_url") == [
        ("d?page=1",), ("d?page=2",), ("e/1",), ("r",),
        ("w&pageIndex=0&sortby=3&conditionFilter=-1",), ("w&pageIndex=1&sortby=3&conditionFilter=-1",)]


def test_best_candidate_ties_and_misses(spark):
    hits = spark.createDataFrame([("a", 3, 7, "u3"), ("a", 1, 7, "u1"), ("a", 0, 2, "u0"), ("ACE", 0, 9, "short"), ("long name", 0, 0, "zero")],
                                 "name string, pos int, n_reviews int, url string")
    names = spark.createDataFrame([("long name",), ("long name",), ("ACE",), ("garbage",)], "name string")
    assert rows(collect.best_candidates(hits), "name", "url") == [("ACE", "short"), ("a", "u1"), ("long name", "zero")]
    assert rows(collect.resolve_names(names, hits)) == [("ACE", None), ("garbage", None), ("long name", "zero"), ("long name", "zero")]
    assert rows(collect.names_not_found(names, hits)) == [("ACE",), ("garbage",)]


def test_shuffled_page_joins_equal_broadcast_ones(spark):
    urls = ["https://hot"] * 60 + [f"https://u{i}" for i in range(40)]
    found = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGE_SCHEMA)
    done = spark.createDataFrame([("https://hot",), ("https://u1",)], "url string")
    for fn in (collect.pages_to_do, collect.pages_of):
        assert rows(fn(found, done, limit=0), "page_id") == rows(fn(found, done), "page_id")
    assert collect.pages_of(found, done, limit=0).count() == 61


def test_dataset_grows_and_labels(spark):
    data = ReviewDataset.empty(spark).collect(pages(spark, (W, webmd_page(3))), collect_urls=True, star_types=["effectiveness", "ease of use", "satisfaction"])
    assert data.table.count() == 3
    more = data.collect(pages(spark, (W, webmd_page(5))), star_types=["effectiveness", "ease of use", "satisfaction"])
    assert more.table.count() == 5  # three comments are known already
    assert {r.label for r in more.table.collect()} == {1.0}


def test_dataset_takes_map_and_number_sites_and_parses_once(spark):
    drugs = ('<h1>User Reviews for Abilify (Page 1)</h1>' + "".join(
        f'<div class="ddc-comment"><p class="ddc-comment-content"><span>text {i}</span></p><div class="rating-score">{i}.0</div></div>' for i in (1, 2, 4, 5)))
    found = pages(spark, (W, webmd_page(3)), (D, drugs))
    parsed = spark.sparkContext.accumulator(0)
    data = ReviewDataset.empty(spark).collect(counted(found, parsed))
    assert sorted((r.site, r.label) for r in data.table.collect()) == [("drugs", 0.0)] * 2 + [("drugs", 1.0)] * 2 + [("webmd", 1.0)] * 3
    more = data.collect(counted(pages(spark, (D, drugs.replace("text", "other"))), parsed))
    assert more.table.count() == 11 and more.stats().count() == 2
    assert parsed.value == 3


def counted(found, parsed):
    """The pages, counting how often each is read."""
    def read(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    return found.mapInArrow(read, found.schema)


def test_review_ids_of_far_apart_pages(spark):
    far = [(1, 0), (1, 1 << 21), (1 + (1 << 44), 0), (1 + (1 << 44), 5)]
    reviews = spark.createDataFrame([(p, q, f"t{p}-{q}") for p, q in far], "page_id bigint, pos bigint, comment string")
    numbered = number_reviews(reviews, 10)
    assert rows(numbered, "review_id", "comment") == [(10 + i, f"t{p}-{q}") for i, (p, q) in enumerate(far)]


def test_from_names_to_reviews(spark):
    front = W + "?drugid=8953"
    results = spark.createDataFrame([
        (100, "webmd", "actos", "s1", f'<a class="drug-review" href="{front.removeprefix("https://www.webmd.com")}">r</a>'),
        (101, "webmd", "abilify", "s2", '<ul class="exact-match"><a href="/drugs/hop">x</a></ul>'),
        (102, "webmd", "garbage", "s3", "<p>nothing</p>"),
    ], "page_id bigint, site string, name string, url string, html string")
    total = '<div id="heading">x</div><span class="totalreviews">7 Total</span>'
    fetched = [("https://www.webmd.com/drugs/hop", '<a class="drug-review" href="/drugs/drugreview-2">r</a>'),
               (front, webmd_page(0) + total), ("https://www.webmd.com/drugs/drugreview-2", webmd_page(0, "Nothing"))]
    fetched += [(f"{front}&pageIndex={i}&sortby=3&conditionFilter=-1",
                 webmd_page(0) + "".join(webmd_review(j) for j in range(5 * i, min(7, 5 * i + 5)))) for i in range(2)]
    names = spark.createDataFrame([("actos",), ("abilify",), ("garbage",)], "name string")
    data = ReviewDataset.empty(spark).collect_from_names(names, results, pages(spark, *fetched))
    assert data.table.count() == 7
    urls = spark.createDataFrame([(fetched[-1][0],), (fetched[-2][0],)], "url string")
    rest = ReviewDataset.empty(spark).collect_from_urls(urls, pages(spark, *fetched), done=urls.limit(1))
    assert rest.table.count() == 5


def test_parser_matches_the_lenient_rules():
    root = parse("<div class='a b'>1<p>2<br>3</div>4<b>5</i></b><script>x<y</script><p/>6")
    assert root.text() == "123456"
    assert root.text(root.first(Where("div", "b"))) == "123" and root.first(Where("div", "a b")) is not None
    assert root.first(Where("div", "c")) is None


def test_streams_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    first = pages(spark, (W, webmd_page(3)), (W, webmd_page(2)))
    first.write.mode("append").parquet(folder)
    collect_stream(stream_pages(spark, folder, 1), out, state).awaitTermination()
    spark.createDataFrame([(9, W, webmd_page(4))], PAGE_SCHEMA).write.mode("append").parquet(folder)
    collect_stream(stream_pages(spark, folder, 1), out, state).awaitTermination()
    batch = collect.extract_reviews(spark.read.schema(PAGE_SCHEMA).parquet(folder))
    assert rows(spark.read.parquet(out), "page_id", "pos", "comment") == rows(batch, "page_id", "pos", "comment")

    distinct, state2 = str(tmp_path / "distinct"), str(tmp_path / "state2")
    collect_distinct_stream(stream_pages(spark, folder, 1), distinct, state2).awaitTermination()
    stored = spark.read.parquet(distinct)
    assert stored.count() == batch.select("comment").distinct().count() == 4
    # A batch that runs again (new checkpoint, same folder) replaces its own output.
    collect_distinct_stream(stream_pages(spark, folder, 1), distinct, str(tmp_path / "state3")).awaitTermination()
    assert spark.read.parquet(distinct).count() == 4


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_first_copies_equal_the_batch_however_pages_arrive(spark, tmp_path, order):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for i in order:  # pages of overlapping comments, one batch each, with a restart in between
        spark.createDataFrame([(i, W, webmd_page(1 + i)), (10 - i, W, webmd_page(2))], PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        collect_first_stream(stream_pages(spark, folder, 1), out, state).awaitTermination()
    batch = collect.extract_reviews(spark.read.schema(PAGE_SCHEMA).parquet(folder))
    place = F.struct("page_id", "pos")
    wanted = dedup_text(batch.withColumn("place", place), "comment", "place")
    assert rows(first_reviews(spark, out), "page_id", "pos", "comment") == rows(wanted, "page_id", "pos", "comment")
