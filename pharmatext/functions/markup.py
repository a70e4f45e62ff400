"""Fetched page -> reviews, run inside ``mapInArrow`` tasks on the standard library's parser.

What each site's markup means is a table of rules (``SITES``), read by one extractor; a further site is
one more entry. Cleaning and number parsing stay column expressions (``functions.sites``). A page that
the parser cannot read gives one row with the reason in ``error`` and no review.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa

from pharmatext.functions.fixed_values import FIRST_WORDS_OF_TITLES, NO_REVIEWS_YET, REVIEW_HEADINGS

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = {"script", "style", "template"}
NBSP = " "
#: Most reviews, and about the characters of pages, in one batch of a task's output; pages looked at together.
ROWS_PER_BATCH, CHARS_PER_BATCH, PAGES = 10_000, 1 << 22, 64


# ---- pages as flat lists: an element is a number, and what is below it is a range of numbers ----

#: A plain tag without its angle brackets: lower case, attributes in quotes without references.
_PLAIN_TAG = re.compile(r"""(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)""")
_PLAIN_ATTR = re.compile(r""" ([a-z][a-z-]*)=(?:"([^"]*)"|'([^']*)')""")
_PLAIN_START = re.compile(r"<!DOCTYPE html>(?=<)|(?=<)")
#: What stands in these is no markup (in some versions of the parser).
_RAW_TEXT = {"iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "xmp"}
START, ALONE, END = range(3)


class _Short(dict):
    """What a function makes of short texts, as a site repeats its own on every page; bounded in number and length."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, text: str):
        made = self.function(text)
        if len(text) <= 100:
            if len(self) >= 1 << 13:
                self.clear()
            self[text] = made
        return made


def _plain_tag(raw: str) -> tuple[int, str, dict[str, str]]:
    """(kind, tag, attributes) of a plain tag; a ValueError for any other."""
    found = _PLAIN_TAG.fullmatch(raw)
    if found is None or found[1] and found[3] or found[2] in _RAW_TEXT:
        raise ValueError(raw[:100])
    kind = END if found[1] else ALONE if found[2] in VOID else START
    return kind, found[2], {name: one or other for name, one, other in _PLAIN_ATTR.findall(found[3])} if found[3] else {}


_tag, _unescaped = _Short(_plain_tag).__getitem__, _Short(unescape).__getitem__


def _plain_tags(html: str) -> tuple[list[tuple[int, str, dict[str, str]]], list[str]] | None:
    """Tags, and the text after each, of a page that is nothing but plain tags and text, else None."""
    start = _PLAIN_START.match(html)
    if start is None or html[-1] != ">":
        return None
    raws, closed, texts = zip(*[part.partition(">") for part in html[start.end() + 1 :].split("<")])
    if "" in closed:
        return None
    try:
        found = list(map(_tag, raws))
    except ValueError:
        return None
    if "<title" in html:
        for (kind, tag, _), after in zip(found, [*found[1:], (START, "", {})]):
            if tag == "title" and kind == START and after[:2] != (END, tag):
                return None
    return found, [_unescaped(text) if "&" in text else text for text in texts]


class Page(HTMLParser):
    """Pages of plain tags are cut at their angle brackets, all others read by the parser, with the same result."""

    def __init__(self, html: str):
        self.tags, self.attrs, self.ends = [""], [{}], [0]
        self.text_from, self.text_to, self.texts = [0], [0], []
        self.by_tag: dict[str, list[int]] = {}
        self._open, self._silent, self._fitting = [0], 0, {}
        plain = _plain_tags(html)
        if plain is None:
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        else:
            self._take(*plain)
        while self._open:
            self._end()

    def _take(self, plain: list[tuple[int, str, dict[str, str]]], texts: list[str]) -> None:
        """What the handlers below do, for plain tags; every tag has one text after it, empty in what is silent."""
        starts = [k for k, tag in enumerate(plain) if tag[0] != END]
        self.tags += [plain[k][1] for k in starts]
        self.attrs += [plain[k][2] for k in starts]
        self.ends += range(2, len(starts) + 2)
        self.text_from += starts
        self.text_to += starts
        tags, open_, ends, text_to, by_tag, node = self.tags, self._open, self.ends, self.text_to, self.by_tag, 0
        for k, (kind, tag, _) in enumerate(plain):
            if kind != END:
                node += 1
                if tag in by_tag:
                    by_tag[tag].append(node)
                else:
                    by_tag[tag] = [node]
                if kind == START:
                    open_.append(node)
            elif tags[open_[-1]] == tag or any(tags[x] == tag for x in open_):
                last = None
                while last != tag:  # what is open within it ends too
                    x = open_.pop()
                    ends[x], text_to[x], last = node + 1, k, tags[x]
        for x in open_:
            ends[x], text_to[x] = node + 1, len(texts)
        for x in by_tag.get("template", ()):
            texts[self.text_from[x] : text_to[x]] = [""] * (text_to[x] - self.text_from[x])
        self.texts = texts
        open_.clear()

    def _end(self) -> None:
        node = self._open.pop()
        self.ends[node], self.text_to[node] = len(self.tags), len(self.texts)
        self._silent -= self.tags[node] in NO_TEXT

    def handle_starttag(self, tag, attrs):
        node = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({name: value or "" for name, value in attrs})
        self.ends.append(node + 1)
        self.text_from.append(len(self.texts))
        self.text_to.append(len(self.texts))
        self.by_tag.setdefault(tag, []).append(node)
        if tag not in VOID:
            self._open.append(node)
            self._silent += tag in NO_TEXT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag):
        if any(self.tags[node] == tag for node in self._open[1:]):
            while self.tags[self._open[-1]] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if not self._silent:
            self.texts.append(data)

    def text(self, node: int = 0) -> str:
        return "".join(self.texts[self.text_from[node] : self.text_to[node]])

    def fitting(self, where: Where) -> list[int]:
        """All elements that fit, in page order; the page is looked through once for each rule."""
        found = self._fitting.get(where)
        if found is None:
            found = self._fitting[where] = where.all(self)
        return found

    def below(self, where: Where, node: int = 0) -> list[int]:
        """Elements below ``node`` that fit, in page order."""
        found = self.fitting(where)
        k = bisect_right(found, node)
        return found[k : bisect_left(found, self.ends[node], k)]

    def first(self, where: Where, node: int = 0) -> int | None:
        found = self.fitting(where)
        k = bisect_right(found, node)
        return found[k] if k < len(found) and found[k] < self.ends[node] else None


def parse(html: str) -> Page:
    return Page(html)


# ---- rules ----

ANY, ABSENT = object(), object()


@dataclass(frozen=True, eq=False)
class Where:
    """Elements of a tag: with a class (one of the list, or the whole attribute), with attribute values
    (``ANY``: whatever value, ``ABSENT``: none, a trailing ``*``: values that start so), and without
    elements of some tags below. A page keeps what fits by the rule itself, not by its values."""

    tag: str
    cls: str | None = None
    attrs: tuple[tuple[str, object], ...] = ()
    without: tuple[str, ...] = ()

    def all(self, page: Page) -> list[int]:
        fit, attrs, found = {}, page.attrs, []
        for node in page.by_tag.get(self.tag, ()):
            own = attrs[node]
            good = fit.get(id(own))  # plain tags written alike share their attributes
            if good is None:
                good = fit[id(own)] = self.fits(own)
            if good:
                found.append(node)
        for tag in self.without:
            found = [x for x in found if not _holds(page, x, tag)]
        return found

    def fits(self, own: dict[str, str]) -> bool:
        if self.cls is not None:
            value = own.get("class", "")
            if value != self.cls and (self.cls not in value or self.cls not in value.split()):
                return False
        for name, wanted in self.attrs:
            value = own.get(name)
            if wanted is ANY or wanted is ABSENT:
                if (value is None) == (wanted is ANY):
                    return False
            elif value is None or not (value.startswith(wanted[:-1]) if wanted.endswith("*") else value == wanted):
                return False
        return True


def _holds(page: Page, node: int, tag: str) -> bool:
    found = page.by_tag.get(tag, [])
    k = bisect_right(found, node)
    return k < len(found) and found[k] < page.ends[node]


@dataclass(frozen=True)
class Take:
    """The text (or an attribute) of the first element at the end of a path of ``Where``; of several
    paths the first that leads somewhere. ``many``: up to so many elements of the last step."""

    paths: tuple[tuple[Where, ...], ...]
    attr: str | None = None
    many: int = 0
    drop: str = ""

    def nodes(self, page: Page, node: int) -> list[int]:
        for path in self.paths:
            at: int | None = node
            for step in path[:-1]:
                at = None if at is None else page.first(step, at)
            if at is not None:
                got = page.below(path[-1], at)
                if got:
                    return got[: self.many or 1]
        return []

    def values(self, page: Page, node: int) -> list[str | None]:
        raw = [page.text(x) if self.attr is None else page.attrs[x].get(self.attr) for x in self.nodes(page, node)]
        return [r.replace(self.drop, "") if r and self.drop else r for r in raw]

    def value(self, page: Page, node: int = 0) -> str | None:
        values = self.values(page, node)
        return values[0] if values else None


def take(*path: Where, **more) -> Take:
    return Take((path,), **more)


H1, TITLE = take(Where("h1")), take(Where("title"))
CELL, LINK = Where("td", attrs=(("align", "center"),)), Where("a")


@dataclass(frozen=True)
class Count:
    """Where a front page states its count: not on pages that lack ``needs`` or say ``refused``."""

    at: Take
    needs: Where
    refused: str | None = None
    cell: int = 0
    word: int | None = None

    def read(self, page: Page) -> str | None:
        box = page.first(self.needs)
        if box is None or self.refused and self.refused in page.text(box):
            return None
        values = self.at.values(page, 0)
        told = values[self.cell] if len(values) > self.cell else None
        if told is None or self.word is None:
            return told
        words = told.split()
        if self.word < 0:  # the first word that is a number
            return next((w for w in words if w.isdigit()), None)
        return words[self.word] if len(words) > self.word else None


@dataclass(frozen=True)
class Hits:
    """Links of a search result page: the first of ``links`` that exists, or the link in a cell of every row."""

    base: str
    links: tuple[tuple[Take, bool], ...] = ()
    rows: tuple[Where, ...] = ()
    cell: int = 0
    own_page_word: str | None = None

    def read(self, page: Page, url: str) -> Iterator[tuple]:
        if self.own_page_word is not None and self.own_page_word in (TITLE.value(page) or "").split():
            yield 0, None, url, False
        for at, is_hop in self.links:
            node = next(iter(at.nodes(page, 0)), None)
            if node is not None:
                yield 0, None, self.base + page.attrs[node].get("href", ""), is_hop
                return
        place = 0
        for kind in self.rows:
            for row in page.below(kind):
                cells = page.below(CELL, row)
                link = page.first(LINK, cells[self.cell]) if len(cells) > self.cell else None
                if link is not None:
                    yield place, page.text(cells[self.cell]), self.base + page.attrs[link].get("href", ""), False
                place += 1


@dataclass(frozen=True)
class Site:
    """``heading``: where the text that marks a review page stands; ``name``: where the drug's name stands,
    after ``name_after`` and before ``name_before``, whole or its first word."""

    boxes: tuple[Where, ...]
    comment: Take
    stars: Take
    date: Take
    user: Take | None
    heading: Take
    name: Take
    first_word: bool
    name_before: str = ""
    skip_without_comment: bool = False
    count: Count | None = None
    hits: Hits | None = None


SITES: dict[str, Site] = {
    "webmd": Site(
        boxes=(Where("div", "userPost"),),
        comment=take(Where("p", attrs=(("id", "comFul*"),))),
        stars=take(Where("span", "current-rating"), many=3),
        date=take(Where("div", "date")),
        user=take(Where("p", "reviewerInfo")),
        heading=H1, name=H1, first_word=False,
        count=Count(take(Where("span", "totalreviews")), Where("div", attrs=(("id", "heading"),)), NO_REVIEWS_YET, word=-1),
        hits=Hits("https://www.webmd.com", ((take(Where("a", "drug-review")), False), (take(Where("ul", "exact-match"), Where("a")), True))),
    ),
    "drugs": Site(
        boxes=(Where("div", "ddc-comment"),),
        comment=take(Where("p", "ddc-comment-content"), Where("span")),
        stars=take(Where("div", "rating-score"), many=1),
        date=take(Where("span", "comment-date text-color-muted")),
        user=Take(tuple((Where("span", f"user-name user-type user-type-{kind}"),) for kind in ("1_standard_member", "2_non_member"))),
        heading=H1, name=H1, first_word=True, name_before=" (Page",
        count=Count(take(Where("table", "data-list ddc-table-sortable"), Where("tfoot"), Where("tr"), Where("th"), many=3), Where("table", "data-list ddc-table-sortable"), cell=2),
        hits=Hits("https://www.drugs.com", ((take(Where("p", "user-reviews-title mgb-1"), Where("a")), False),)),
    ),
    "everydayhealth": Site(
        boxes=(Where("div", attrs=(("itemprop", "review"),)),),
        comment=take(Where("p", attrs=(("itemprop", "reviewBody"),))),
        stars=take(Where("span", attrs=(("itemprop", "reviewRating"),)), many=1),
        date=take(Where("span", "time"), attr="content"),
        user=None,
        heading=take(Where("span", attrs=(("itemprop", "name"),))), name=TITLE, first_word=True,
        count=Count(take(Where("div", "review-pagination"), Where("section", "review-pagination__section--info")), Where("div", "review-details clearfix"), word=2),
        hits=Hits("", own_page_word="Reviews"),
    ),
    "drugratingz": Site(
        boxes=(Where("tr", "ratingstableodd"), Where("tr", "ratingstableeven")),
        comment=take(Where("span", "description")),
        stars=take(Where("td", attrs=(("align", "center"), ("valign", ANY)), without=("a", "img")), many=4, drop=NBSP),
        date=take(Where("td", attrs=(("valign", "top"), ("align", ABSENT)), without=("a",))),
        user=None,
        heading=H1, name=TITLE, first_word=True, skip_without_comment=True,
        hits=Hits("https://www.drugratingz.com", rows=(Where("tr", "ratingstableeven"), Where("tr", "ratingstableodd")), cell=2),
    ),
}


# ---- what is read from a page ----

def is_review_page(site: str, page: Page) -> bool:
    told, phrase = SITES[site].heading.value(page), REVIEW_HEADINGS.get(site, "")
    return told is not None and phrase in told


def drug_name(site: str, page: Page) -> str | None:
    rule, phrase = SITES[site], "" if site in FIRST_WORDS_OF_TITLES else REVIEW_HEADINGS.get(site, "")
    told = rule.name.value(page)
    if told is None:
        return None
    if not rule.first_word:
        return told.replace(phrase, "")
    if phrase:
        if phrase not in told:
            return None
        told = told.split(phrase, 1)[1].split(rule.name_before, 1)[0]
    return next(iter(told.split()), None)


def reviews(site: str, page: Page) -> Iterator[tuple]:
    """(comment, star texts, date, user) of the reviews on a page, box kind by box kind."""
    rule = SITES[site]
    for kind in rule.boxes:
        for box in page.below(kind):
            comment = rule.comment.value(page, box)
            if comment is None and rule.skip_without_comment:
                continue
            date = rule.date.value(page, box)
            yield comment, rule.stars.values(page, box), date, rule.user and rule.user.value(page, box)


def _read(html: str) -> tuple[Page | None, str | None]:
    """The page, or why it cannot be read."""
    try:
        return parse(html), None
    except Exception as e:  # whatever a parser says about one page must not end the job
        return None, f"{type(e).__name__}: {e}"[:200]


RAW_SCHEMA = (
    "page_id bigint, site string, url string, drug string, pos int, comment_raw string, "
    "stars array<string>, date_raw string, user_raw string, error string"
)
PAGE_COLUMNS = ["page_id", "site", "url"]
_TEXT = pa.string()
_RAW = pa.schema(list({
    "page_id": pa.int64(), "site": _TEXT, "url": _TEXT, "drug": _TEXT, "pos": pa.int32(), "comment_raw": _TEXT,
    "stars": pa.list_(_TEXT), "date_raw": _TEXT, "user_raw": _TEXT, "error": _TEXT}.items()))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _page_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of batches whose last column is the page; few pages are strings at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES):
            batch = whole.slice(start, PAGES)
            yield from zip(*[batch.column(c).to_pylist() for c in columns])


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PAGE_COLUMNS + html`` batches to raw review batches of bounded size."""
    rows, size = [], 0
    for *key, html in _page_rows(batches, *PAGE_COLUMNS, "html"):
        if html is None:
            continue
        page, error = _read(html)
        if page is None:
            rows.append((*key, *[None] * 6, error))
            continue
        drug = drug_name(key[1], page)
        size += len(html)
        for i, review in enumerate(reviews(key[1], page)):
            rows.append((*key, drug, i, *review, None))
            if len(rows) >= ROWS_PER_BATCH or size >= CHARS_PER_BATCH:
                yield _arrow(rows, _RAW)
                rows, size = [], 0
    if rows:
        yield _arrow(rows, _RAW)


FACT_SCHEMA = "page_id bigint, site string, url string, drug string, is_reviews boolean, total_raw string, error string"
_FACTS = pa.schema(list({
    "page_id": pa.int64(), "site": _TEXT, "url": _TEXT, "drug": _TEXT, "is_reviews": pa.bool_(), "total_raw": _TEXT, "error": _TEXT}.items()))


def fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page: its drug, whether it shows reviews, and the text that states its count."""
    rows = []
    for *key, html in _page_rows(batches, *PAGE_COLUMNS, "html"):
        if html is None:
            continue
        page, error = _read(html)
        if page is None:
            rows.append((*key, None, False, None, error))
        else:
            rule = SITES[key[1]]
            rows.append((*key, drug_name(key[1], page), is_review_page(key[1], page), rule.count and rule.count.read(page), None))
        if len(rows) >= ROWS_PER_BATCH:
            yield _arrow(rows, _FACTS)
            rows = []
    if rows:
        yield _arrow(rows, _FACTS)


SEARCH_SCHEMA = "page_id bigint, site string, name string, pos int, n_raw string, url string, is_hop boolean"
_HITS = pa.schema(list({
    "page_id": pa.int64(), "site": _TEXT, "name": _TEXT, "pos": pa.int32(), "n_raw": _TEXT, "url": _TEXT, "is_hop": pa.bool_()}.items()))


def search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits on each search result page; a page that cannot be read has none."""
    rows = []
    for page_id, site, name, url, html in _page_rows(batches, "page_id", "site", "name", "url", "html"):
        page, _ = _read(html)
        if page is not None and SITES[site].hits:
            rows += [(page_id, site, name, *hit) for hit in SITES[site].hits.read(page, url)]
        if len(rows) >= ROWS_PER_BATCH:
            yield _arrow(rows, _HITS)
            rows = []
    if rows:
        yield _arrow(rows, _HITS)
