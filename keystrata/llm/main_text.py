"""Main text of HTML pages, with site templates removed.

Each element has a hash of its whole subtree, and Spark counts by host where it recurs. Outside articles,
subtrees on ``MIN_PAGES`` pages and ``MIN_SHARE`` of their host's are the site's template. In the content (the
articles, or all of a page without any), a subtree must recur under that many different contents: a page's
vote for it is the text that is left without any recurring subtree, equal votes count once, and a page of
which less than ``LEFT`` is left has none. So author boxes and newsletter lines go, and exact or near copies
of an article or a page stay whole. Lines (paragraphs, headings, few words) must recur under ``LINE_SHARE`` of
the contents; cells, list items and inline elements are never templates by themselves, nor are html, body and
articles, nor what holds more than 1 - ``LEFT`` of a page's text. Elements that name themselves menus,
headers, footers, sidebars, notices, adverts, forms or comments go in any case.

Counting is a partial aggregate of (host, hash) before the shuffle, so a host with a third of the pages is
as many small counts. By the bounds a host has at most 1 / MIN_SHARE times its mean number of subtrees
as templates; they are broadcast while they number at most ``BROADCAST_ROWS``, else joined by a shuffle.

Null and empty html gives an empty text, and very long html is read whole. Pages without a host are a host of
their own. Rows that repeat a page are pages like any other; a null page_id stays null; columns other than
page_id, url and html are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.scratch import bound_batches, write

MIN_PAGES, MIN_SHARE, BROADCAST_ROWS = 10, 0.02, 200_000
LEFT, LINE_SHARE, LINE_WORDS = 1 / 3, 0.5, 5

# Names of elements, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("nav footer aside form script style noscript template iframe svg math canvas object audio video button select textarea input head title dialog menu search map".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
UNITS = BLOCKS - frozenset("html body head article main br hr li dt dd td th tr tbody thead tfoot caption option figcaption summary".split())
CLOSES_P = BLOCKS - frozenset("br option tbody td tfoot th thead tr caption body html head".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# Whole names in class, id or role by which an element names itself other than main text; alone or
# with words for its place before and for its kind behind. Other compounds (header-image, has-sidebar) say nothing.
NAMES = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|entry|article|user|cookie|social|email|google|js)[_-])*(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|dialog|disclaimer|disqus|footer|gdpr|login|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pagination|pager|popup|promos?|promotion|recommended|related|replies|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|widgets?)(?:[_-](?:ads?|area|banners?|bars?|block|box|buttons?|container|content|form|icons?|inner|links?|list|menu|nav|notice|popup|section|slot|top|unit|widgets?|wrap|wrapper|articles|posts|stories))*(?=$|\s)", re.I)
# Names of a page's header, which say so outside articles only (an article's own header has its title).
HEADERS = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top)[_-])?(?:header|masthead)(?=$|\s)", re.I)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=|/)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!(?=[a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ARTICLE, MAIN = "article", "main"


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children = tag, attributes, []

    def names_itself_other(self) -> bool:
        """Whether tag, class, id or role say that this is not main text."""
        if self.tag in GONE:
            return True
        if self.tag in ("html", "body", ARTICLE, MAIN) and not (self.tag == ARTICLE and "comment" in self.attributes.lower()):
            return False
        return bool(self.attributes) and (bool(HIDDEN.search(self.attributes)) or self.named(NAMES))

    def named(self, names: re.Pattern) -> bool:
        """Whether class, id or role hold one of ``names``; the id of a line is an anchor and says nothing."""
        return any(names.search("".join(x)) for kind, *x in NAMED.findall(self.attributes) if kind.lower() != "id" or self.tag not in LINES)


def parse(html: str) -> Element:
    """The page's elements; text is in ``children`` as strings. End tags that HTML lets authors omit are supplied."""
    root = Element("#root", "")
    stack, at = [root], 0
    for token in iter(lambda: TOKEN.search(html, at), None):
        if token.start() > at:
            stack[-1].children.append(unescape(html[at : token.start()]))
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    break
                if stack[n].tag in (ARTICLE, "td", "th", "table") and tag not in ("html", "body", ARTICLE, MAIN, "table", "tr", "tbody", "div", "section"):
                    break
            continue
        if tag in CLOSES_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    del stack[n:]
                    break
                if stack[n].tag in BLOCKS:
                    break
        if tag in CLOSED_BY:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in HOLDS[tag]:
                    break
                if stack[n].tag in CLOSED_BY[tag]:
                    del stack[n:]
                    break
        element = Element(tag, token[3] or "")
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            element.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID:
            stack.append(element)
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root


def articles(root: Element) -> list[Element]:
    """The outermost articles; without any, the outermost main elements; without these, none."""
    for wanted in (ARTICLE, MAIN):
        found, todo = [], [root]
        while todo:
            element = todo.pop()
            if element.tag == wanted and not element.names_itself_other():
                found.append(element)
            elif element is root or not element.names_itself_other():
                todo += [x for x in reversed(element.children) if isinstance(x, Element)]
        if found:
            return found
    return []


def subtree_hashes(root: Element, skipped: list[Element]) -> dict[int, int]:
    """By id() of each element outside ``skipped``: a 64-bit hash of its tag, its text and its elements, in order."""
    out: dict[int, int] = {}
    skip = {id(x) for x in skipped}
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [x for x in element.children if isinstance(x, Element) and id(x) not in skip]
    for element in reversed(order):
        if not any(isinstance(x, Element) and (id(x) in skip or id(x) in out and out[id(x)] == 0) for x in element.children):
            parts = [" ".join(x.split()) if isinstance(x, str) else str(out[id(x)]) for x in element.children]
            out[id(element)] = (xxhash.xxh64_intdigest("\x00".join([element.tag, *parts])) >> 1) + 1
        else:
            out[id(element)] = 0  # holds an article: never a template
    return out


class Page:
    """A page with the hashes of its elements; ``outside``: hashes of the subtrees outside its articles."""

    def __init__(self, html: str | None):
        self.root = parse(html or "")
        self.mains = articles(self.root)
        self.tops = self.mains or [self.root]
        self.outside = {h for h in subtree_hashes(self.root, self.mains).values() if h} if self.mains else set()
        self.hashes: dict[int, int] = {}
        for top in self.tops:
            self.hashes |= subtree_hashes(top, [])
        self.sizes: dict[int, tuple[int, int]] = {}
        order, todo = [], list(self.tops)
        while todo:
            x = todo.pop()
            order.append(x)
            todo += [y for y in x.children if isinstance(y, Element) and self.shown(y)]
        for x in reversed(order):
            self.sizes[id(x)] = self._size(x)

    def shown(self, x: Element) -> bool:
        return not (x.names_itself_other() or (not self.mains and (x.tag == "header" or bool(x.attributes) and x.named(HEADERS))))

    def _size(self, x: Element) -> tuple[int, int]:
        """Characters other than white space and words that ``x`` shows."""
        chars = words = 0
        for y in x.children:
            if isinstance(y, str):
                found = y.split()
                chars, words = chars + sum(map(len, found)), words + len(found)
            elif size := self.sizes.get(id(y)):
                chars, words = chars + size[0], words + size[1]
        return chars, words

    def units(self) -> list[tuple[int, bool]]:
        """(hash, is it a line) of the subtrees of the content which can be templates."""
        found, todo = [], list(self.tops)
        while todo:
            x = todo.pop()
            words = self.sizes[id(x)][1]
            if x.tag in UNITS and words:
                found.append((self.hashes[id(x)], x.tag in LINES or words < LINE_WORDS))
            todo += [y for y in x.children if isinstance(y, Element) and self.shown(y)]
        return found

    def text(self, tops: list[Element], templates: set[int] | frozenset[int], most: float | None = None, met: set[int] | None = None) -> str:
        """The text of ``tops`` without subtrees in ``templates``, which are put into ``met``; longer ones than ``most`` stay."""
        parts: list[str] = []
        for top in tops:
            todo: list[tuple[Element | str, bool]] = [(top, False)]
            while todo:
                x, whole = todo.pop()
                if isinstance(x, str):
                    parts.append(x)
                    continue
                if x is not top:
                    if not self.shown(x):
                        continue
                    if not whole and x.tag in UNITS and self.hashes[id(x)] in templates:
                        if most is None or self.sizes[id(x)][0] <= most:
                            if met is not None:
                                met.add(self.hashes[id(x)])
                            continue
                        whole = True
                if x.tag in BLOCKS:
                    parts.append(" ")
                    todo.append((" ", whole))
                todo += [(y, whole) for y in reversed(x.children)]
            parts.append(" ")
        return " ".join("".join(parts).split())


def digest(text: str) -> int:
    return (xxhash.xxh64_intdigest(text) >> 1) + 1


def votes(page: Page, recurring: set[int] | frozenset[int]) -> tuple[int, set[int]] | None:
    """What is left of a page's text without ``recurring`` subtrees, as a hash, and the subtrees met; None if too little is left."""
    whole, met = page.text(page.tops, frozenset()), set()
    left = page.text(page.tops, recurring, None, met) if recurring else whole
    return (digest(left), met) if whole and len(left) >= LEFT * len(whole) else None


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset(), repeated: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page without the subtrees whose hashes are ``repeated`` or, where it has no article, ``templates``."""
    if not html:
        return ""
    page = Page(html)
    gone = repeated if page.mains else repeated | templates
    return page.text(page.tops, gone, (1 - LEFT) * sum(page.sizes[id(x)][0] for x in page.tops))


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, templates and repeated (arrays of subtree hashes): what recurs outside and inside the content of a host's pages."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                content = digest(page.text(page.tops, frozenset()))
                rows.append((host, 0, None, False))  # 0 counts the pages
                rows += [(host, h, None, False) for h in page.outside]
                rows += [(host, h, content, line) for h, line in set(page.units())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "hash", "content", "line"])

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html, recurring in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if vote := votes(Page(html), frozenset(recurring or ())):
                    rows += [(host, h, vote[0]) for h in (0, *vote[1])]  # 0 counts the contents
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "hash", "left"])

    hosts = hosted(pages).select("host", "html")
    counted = hosts.mapInArrow(candidates, "host string, hash long, content long, line boolean").groupBy("host", "hash").agg(
        F.count_if(F.col("content").isNull()).alias("n"), F.count("content").alias("inside"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("line").alias("line"))
    # Copies of one page are one content, whose subtrees recur under nothing else.
    again = (F.col("inside") >= min_pages) & (F.col("lo") < F.col("hi"))
    often = write(counted.where((F.col("n") >= min_pages) | (F.col("hash") == 0) | again).select("host", "hash", "n", F.coalesce(again, F.lit(False)).alias("again"), "line"), "subtrees")
    sizes = often.where("hash = 0").select("host", F.col("n").alias("pages"))
    templates = often.where("hash <> 0").join(sizes, "host").where((F.col("n") >= min_pages) & (F.col("n") >= F.col("pages") * min_share)).groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("templates"))

    recurring = often.where("again").groupBy("host").agg(F.collect_list("hash").alias("recurring"))
    few = often.where("again").count() <= BROADCAST_ROWS
    cast = write(hosts.join(F.broadcast(recurring) if few else recurring, "host", "left").select("host", "html", "recurring").mapInArrow(ballots, "host string, hash long, left long").distinct().groupBy("host", "hash").agg(F.count("*").alias("votes")), "votes")
    contents = cast.where("hash = 0").select("host", F.col("votes").alias("contents"))
    needed = F.greatest(F.lit(min_pages), F.col("contents") * F.when(F.col("line"), F.greatest(F.lit(LINE_SHARE), F.lit(min_share))).otherwise(F.lit(min_share)))
    repeated = cast.where("hash <> 0").join(often.where("again").select("host", "hash", "line"), ["host", "hash"]).join(contents, "host").where(F.col("votes") >= needed).groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("repeated"))
    none = F.array().cast("array<long>")
    return templates.join(repeated, "host", "full").select("host", F.coalesce("templates", none).alias("templates"), F.coalesce("repeated", none).alias("repeated"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)
    found = write(site_templates(pages, min_pages, min_share), "templates")
    rows = found.agg(F.sum(F.size("templates") + F.size("repeated"))).first()[0] or 0

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(html, frozenset(t or ()), frozenset(r or ())) for html, t, r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = hosted(pages).join(F.broadcast(found) if rows <= BROADCAST_ROWS else found, "host", "left")
    return joined.select("page_id", "url", "html", "templates", "repeated").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
