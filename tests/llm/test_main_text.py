import random
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from keystrata.llm import main_text as M
from tests.llm.conftest import records

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; <i>tail</i></h1><p>One<b>two
 three<br>four<p>caf&eacute; &#8364;5 &lt;b&gt;<div class="share-buttons">Share</div><ul><li>x<li>y</ul><section id="comments"><p>First!</p></section><table><tr><td>a<td>b</table><form>Mail</form></article>
<aside>More</aside><footer>End</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, text string, host string, templates string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], SCHEMA)


def test_article_of_a_page():
    assert M.main_text(PAGE) == "Head & tail Onetwo three four café €5 <b> x y a b"


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</p><p>b</p>", "a b"), ("<main><p>in</main><p>out", "in"), ("<article>a<article>b</article></article><article>c</article>", "a b c"), ("<article><p>unclosed", "unclosed"),
    ("<p>a<!-- <p>no --> b", "a b"), ("a < b and c > d", "a < b and c > d"), ("<p title='>'>x</p>", "x"), ("<article><div hidden>h</div><p aria-hidden=true>i</p>v</article>", "v"), ("<article><p class='header-image adage'>stays</p><p class=\"advert\">goes</p></article>", "stays"),
    ("<article><textarea>t</textarea>x&nbsp;y</article>", "x y"), ("<article>a</b></i>c</article>", "ac"), ("<article><script>x", ""), ("<div>" * 5000 + "deep", "deep"), ("<p>" + "word " * 20_000, ("word " * 20_000).strip()), ("<article></article>", ""),
])
def test_small_pages(html, text):
    assert M.main_text(html) == text


def test_templates_are_deleted_where_there_is_no_article(spark):
    menu = "<div><div>Our shop since 1900</div><span>All goods</span></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<p>Text {i}</p><div>Once only {i}</div></body>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<body>{menu}<p>x</p></body>"), (101, None, None), (None, "nonsense", "<p>y</p>"), (3, "http://h.example/3", "<p>Text 3</p>")]
    found = records(M.extract(pages(spark, rows)))
    texts = {(r["page_id"], r["url"], r["text"]) for r in found}
    assert len(found) == 16
    assert (4, "http://h.example/4", "Text 4 Once only 4") in texts
    assert (100, "http://other.example/", "Our shop since 1900 All goods x") in texts
    assert (101, None, "") in texts and (None, "nonsense", "y") in texts
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_copies_of_an_article_stay_whole(spark, monkeypatch, bound):
    monkeypatch.setattr(M, "BROADCAST_ROWS", bound)
    rows = [(i, "http://h.example/", "<nav>m</nav><article><h1>T</h1><p>Same text everywhere</p></article><div>Foot</div>") for i in range(30)]
    assert {r["text"] for r in records(M.extract(pages(spark, rows)))} == {"T Same text everywhere"}
    found = records(M.site_templates(pages(spark, rows)))
    assert len(found) == 1 and len(found[0]["templates"]) == 2


def test_empty_table(spark):
    assert records(M.extract(spark.createDataFrame([], SCHEMA))) == []


BOX = "<div><div>Written by the staff of our house</div><p>They write about many things</p></div>"


def test_templates_inside_articles_are_deleted(spark):
    line = "<p>Get the weekly letter of our house</p>"
    rows = [(i, f"http://h.example/{i}", f"<article><p>Quite different words {i} in each of these {i * 7} pages</p><p>Rare line</p>{line}<table><tr><td>Yes<td>{i}</table>{BOX}</article>" if i % 3 == 1 else f"<article><p>Nothing else is like text {i} here, {i * 3}, and it goes on for a while</p>{line}{BOX}</article>") for i in range(40)]
    texts = {r["page_id"]: r["text"] for r in records(M.extract(pages(spark, rows)))}
    assert texts[1] == "Quite different words 1 in each of these 7 pages Rare line Yes 1"
    assert texts[2] == "Nothing else is like text 2 here, 6, and it goes on for a while"


@pytest.mark.parametrize("stamp", ["", "<span>Read at 10:{i}</span>"])
def test_copies_of_a_page_without_an_article_stay_whole(spark, stamp):
    body = "<body><div><p>The same long story stands on all of these pages, word for word</p><table><tr><td>Yes<td>No</table></div>"
    rows = [(i, f"http://h.example/{i}", body + stamp.format(i=i) + "</body>") for i in range(30)]
    texts = {r["page_id"]: r["text"] for r in records(M.extract(pages(spark, rows)))}
    assert all(texts[i].startswith("The same long story stands on all of these pages, word for word Yes No") for i in range(30))


def test_repeated_cells_and_rare_lines_without_an_article_stay(spark):
    menu = "<div>Our shop since 1900 <b>all goods</b></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<p>Page {i} tells of quite other things</p>{'<p>Introduction</p>' if i % 3 == 1 else ''}<table><tr><td>Yes<td>{i}</table></body>") for i in range(40)]
    texts = {r["page_id"]: r["text"] for r in records(M.extract(pages(spark, rows)))}
    assert texts[1] == "Page 1 tells of quite other things Introduction Yes 1"
    assert texts[2] == "Page 2 tells of quite other things Yes 2"


def test_what_holds_most_of_a_page_stays():
    html = "<body><div><p>Nearly all that this page has to say</p></div><p>End</p></body>"
    page = M.Page(html)
    assert M.main_text(html, set(page.hashes.values()) - {0}) == "Nearly all that this page has to say"


@pytest.mark.parametrize(("html", "text"), [
    ('<article><h2 id="search">Search</h2>a</article>', "Search a"), ('<article><section id="related-work">Work</section>a</article>', "Work a"), ('<article><h2 id="share-prices">Prices</h2>a</article>', "Prices a"),
    ('<article><p class="header-image">Image</p>a</article>', "Image a"), ('<article><div class="has-sidebar">Text</div>a</article>', "Text a"), ('<article class="post comments-open">Text</article>', "Text"),
    ('<article><div class="article-header"><h1>Title</h1></div>a</article>', "Title a"), ('<article><header><h1>Title</h1></header>a</article>', "Title a"), ('<article><div class="share-price">1.20</div><div class="search-results">x</div></article>', "1.20 x"),
    ('<body><div class="site-header">Shop</div><div class="entry-header"><h1>Title</h1></div><p>a</p></body>', "Title a"), ('<body><div id="masthead">Shop</div><p>a</p></body>', "a"),
    ('<article>a<div class="x share-buttons">b</div><div id="comments">c</div><section class="related-posts">d</section><div role="navigation">e</div></article>', "a"),
])
def test_only_whole_names_say_that_an_element_is_not_main_text(html, text):
    assert M.main_text(html) == text


class Plain(HTMLParser):
    """A tree of (tag, children) of well-formed pages without attributes."""

    def __init__(self, html):
        super().__init__()
        self.root = ("#root", [])
        self.stack = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def brute_texts(rows, min_pages, min_share):
    """Text of each page (host, html), template counts and votes taken over whole subtrees as strings, page by page."""

    def nodes(node):
        return [node, *(y for x in node[1] if not isinstance(x, str) for y in nodes(x))]

    def shown(node, gone, spare=()):
        out = []
        for x in node[1]:
            if isinstance(x, str):
                out.append(x)
            elif x[0] not in ("nav", "footer") and not (repr(x) in gone and repr(x) not in spare):
                out.append(f" {shown(x, gone, spare)} " if x[0] in ("p", "div", "h1", "ul", "li", "article") else shown(x, gone, spare))
        return " ".join("".join(out).split()) if node[0] == "#top" else "".join(out)

    pages = []
    for host, html in rows:
        top = next(x for x in nodes(Plain(html).root) if x[0] == "article")
        units = {repr(x): x[0] in ("p", "h1") or len(shown(("#top", [x]), ()).split()) < 5 for x in nodes(top)[1:] if x[0] in ("p", "div", "h1", "ul") and shown(("#top", [x]), ())}
        pages.append((host, ("#top", [top]), units))
    seen, bare = defaultdict(list), defaultdict(set)
    for host, top, units in pages:
        for u in units:
            seen[host, u].append(shown(top, ()))
    again = {k for k, v in seen.items() if len(v) >= min_pages and len(set(v)) > 1}
    met = defaultdict(set)
    for host, top, units in pages:
        recurring = {u for h, u in again if h == host}
        left = shown(top, recurring)
        if len(left) * 3 >= len(shown(top, ())):
            bare[host].add(left)
            todo = [top]
            while todo:
                for x in todo.pop()[1]:
                    if not isinstance(x, str) and x[0] not in ("nav", "footer"):
                        if repr(x) in recurring and x[0] in ("p", "div", "h1", "ul"):
                            met[host, repr(x)].add(left)
                        else:
                            todo.append(x)
    out = []
    for host, top, units in pages:
        gone = {u for u, line in units.items() if len(met[host, u]) >= max(min_pages, len(bare[host]) * (max(0.5, min_share) if line else min_share))}
        size = lambda node: len("".join(shown(node, ()).split()))
        spare = {repr(x) for x in nodes(top) if 3 * size(("#top", [x])) > 2 * size(top)}
        out.append(shown(top, gone, spare))
    return out


def test_templates_equal_a_plain_count_of_subtrees(spark, prose):
    rnd = random.Random(9)
    blocks = {h: [f"<div><p>{prose(6)}</p><p>{prose(5)}</p></div>", f"<p>{prose(4)}</p>", f"<ul><li>{prose(3)}</li><li>{prose(4)}</li></ul>", f"<div>{prose(12)}</div>"] for h in ("a", "b")}
    whole = f"<h1>{prose(3)}</h1><p>{prose(40)}</p>"
    rows = []
    for i in range(150):
        host = rnd.choice("aab")
        parts = [whole if rnd.random() < 0.2 else f"<h1>{prose(4)}</h1><p>{prose(rnd.randrange(5, 60))}</p>", *(b for b, often in zip(blocks[host], (0.7, 0.6, 0.15, 0.05), strict=True) if rnd.random() < often)]
        rows.append((host, f"<html><body><nav>{prose(3)}</nav><article>{''.join(parts)}</article><footer>f</footer></body></html>"))
    found = {r["page_id"]: r["text"] for r in records(M.extract(pages(spark, [(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)])))}
    wanted = brute_texts(rows, M.MIN_PAGES, M.MIN_SHARE)
    assert [found[i] for i in range(len(rows))] == wanted
    assert sum(len(M.main_text(x)) for _, x in rows) > sum(map(len, wanted))
