"""Pages read by one pattern, output in bounded batches, and streams whose batches don't grow in number."""

from html.parser import HTMLParser

import pyarrow as pa
import pytest

from pharmatext.functions import markup
from pharmatext.sources.tables import spread_stream
from registry.collecting import _landed
from registry.common import review_pages, table
from test_pages import webmd_page

PLAIN = [
    "<!DOCTYPE html><html><body><h1>User Reviews &amp; Ratings - X</h1><div class=\"userPost\"><p id=\"comFull1\">a &lt;b&gt; &eacute;<br>c</p></div></body></html>",
    "<div><p>one<p>two</div></b></div>tail<i></i>",
    "<title>a &amp; b</title><p class=\"a\" class=\"b\" id=\"\">x</p>",
    "<template>not <b>seen</b></template><p>seen</p></br>",
    "<title></title>",
]
OTHER = [
    "", "text", "<p>open text", webmd_page(2), "<P CLASS='x'>a</P>", "<a href=\"?a&amp;b\">x</a>", "<br/>x<i></i>", "<p>a < b</p>", "<p >x</p>",
    "<script>if (a<b) \"</i>\"</script><p>x</p>", "<title><b>x</b></title>", "<title>", "<p></p id=\"x\">", "<style>p</style>", "<p></p><!-- <b> -->",
]


def tree(page):
    return page.tags, page.attrs, page.ends, [page.text(k) for k in range(len(page.tags))], page.by_tag


def by_parser(monkeypatch, html):
    with monkeypatch.context() as m:
        m.setattr(markup, "_plain_tags", lambda html: None)
        return tree(markup.parse(html))


@pytest.mark.parametrize("html", PLAIN + OTHER)
def test_both_readings_agree(monkeypatch, html):
    assert tree(markup.parse(html)) == by_parser(monkeypatch, html)


@pytest.mark.parametrize("html", PLAIN)
def test_plain_pages_do_not_meet_the_parser(monkeypatch, html):
    monkeypatch.setattr(HTMLParser, "feed", lambda *a: pytest.fail("parser used"))
    assert len(markup.parse(html).tags) > 1


@pytest.mark.parametrize("site", list(markup.SITES))
def test_rendered_pages_agree(monkeypatch, spark, sf, site):
    found = review_pages(spark, sf, site).limit(60).unionByName(table(spark, sf, "pages").select("page_id", "url", "html").limit(40))
    for r in found.collect():
        assert tree(markup.parse(r.html)) == by_parser(monkeypatch, r.html)


def test_output_batches_are_bounded():
    html = "<h1>x</h1>" + '<div class="userPost"><p id="comFull1">' + "long " * 20000 + "</p></div>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "site": ["webmd"] * 200, "url": ["u"] * 200, "html": [html] * 200})
    out = list(markup.extract_batches(iter([batch])))
    assert sum(b.num_rows for b in out) == 200
    assert max(b.nbytes for b in out) < 2 * markup.CHARS_PER_BATCH


def test_landed_files_do_not_grow_in_number(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    docs.repartition(40).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        folder = _landed(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    stored = spark.read.parquet(folder)
    assert 1 < len(stored.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert stored.count() == docs.count()


def test_stream_batches_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    seen = []
    spread_stream(arriving, "id").writeStream.foreachBatch(lambda b, n: seen.append(b.rdd.getNumPartitions())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [2 * spark.sparkContext.defaultParallelism]
