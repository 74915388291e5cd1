"""Main text of pages: structure rules, site templates, edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from rowtide.llm import pages, queries


def keep(html):
    return pages.article_text(pages.parse(html))


def made(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, text string, digest int")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_structure():
    assert keep("<p>A &amp; B</p><p>C\n  d</p>") == "A & B C d"
    assert keep("<body><nav>menu</nav><p>text</p><footer>foot</footer></body>") == "text"
    assert keep("<p>one<p>two<script>var x = '<p>no</p>';</script><style>p{}</style>") == "one two"
    assert keep("<article><header><h1>Title</h1></header><p>Body</p></article><aside>side</aside>") == "Title Body"
    assert keep("<div class='comments'><p>reader</p></div><main><p>in <b>bo</b>ld</p></main>") == "in bold"
    assert keep("<!-- <p>hidden</p> --><p>shown</p>") == "shown"
    assert keep("<p>a &lt;b&gt; &#65; &#x42; &nosuch; &copy;</p>") == "a <b> A B &nosuch; ©"
    assert keep("<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>") == "one two 1 2"
    assert keep("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>") == "yes"
    assert keep("") == keep("<") .replace("<", "") == ""
    assert keep("plain text") == "plain text"
    assert keep("<p>never closed <b>bold") == "never closed bold"


def test_deep_nesting_is_no_recursion():
    assert keep("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


LONG = "A sentence of the article that goes on for a while, so that it is most of the page."


@pytest.mark.parametrize(
    "html",
    [
        f"<body><div class='post has-sidebar'><p>{LONG}</p></div></body>",
        f"<body><article class='post comments-open'><p>{LONG}</p></article></body>",
        f"<body><div class='page-header-sticky no-sidebar'><p>{LONG}</p></div></body>",
        f"<body><div class='content-with-ads'><p>{LONG}</p></div></body>",
        f"<body><form action='/x'><p>{LONG}</p></form><p>x</p></body>",
        f"<body><div class='sidebar-right'><main><p>{LONG}</p></main></div></body>",
        f"<body><div id='app' style='display:none'><p>{LONG}</p></div></body>",
        f"<body><div class='side-by-side'><p>{LONG}</p></div></body>",
    ],
)
def test_hints_do_not_drop_the_page_itself(html):
    assert LONG in keep(html)


def test_self_closed_elements_hold_nothing():
    assert keep("<p>x<br>y</p><svg/><p>after</p>") == "x y after"
    assert keep("<p>x</p><template/><p>after</p>") == "x after"
    assert keep("<p>x</p><svg><path d='a'/><title/><g/></svg><p>after</p>") == "x after"
    assert keep("<p>x</p><script src='a.js'/><p>after</p>") == "x after"
    assert keep("<p>x</p><iframe src='b'/><p>after</p>") == "x after"
    assert keep("<p>x</p><script>var a = '</p>'</script><p>after</p>") == "x after"


def test_an_article_is_the_text_if_it_holds_most():
    teaser = "<article class='card'><p>Read more here</p></article>"
    assert keep(f"<main><h1>Title</h1><p>{LONG}</p>{teaser}</main>") == f"Title {LONG} Read more here"
    assert keep(f"<main><article><h1>Title</h1><p>{LONG}</p></article><section>{teaser}{teaser}</section></main>") == f"Title {LONG}"
    assert keep("<body><div>Some words around it that are longer</div><article><h2>T</h2><p>Short</p></article></body>") == "T Short"
    assert keep("<body><article><p>One</p></article><article><p>Two</p></article></body>") == "One Two"


def test_long_comments_go():
    comments = f"<div class='comments'>{'<article class=comment><p>' + LONG + '</p></article>'}{'<p>' + LONG + '</p>' * 5}</div>"
    assert keep(f"<body><div><h1>T</h1><p>Short article</p></div>{comments}</body>") == "T Short article"
    assert keep(f"<body><div><p>Short article</p></div><div class='comment-list'><p>{LONG}</p></div></body>") == "Short article"
    assert keep(f"<body><div class='masthead'><h1>Site</h1></div><div><p>{LONG}</p></div></body>") == LONG


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ("<div class='social-history'><p>History of it</p></div>", "History of it"),
        ("<section class='research-notice'><p>A notice on research</p></section>", "A notice on research"),
        ("<section id='related-work'><h2>Related work</h2><p>Others did it</p></section>", "Related work Others did it"),
        ("<p class='alert'>Mind this</p>", "Mind this"),
        ("<aside>A pull quote</aside>", "A pull quote"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
        ("<p>press <button>Save</button> now</p>", "press Save now"),
        ("<ul><li class='menu'>soup</li></ul>", "soup"),
        ("<header><h2>Part two</h2></header>", "Part two"),
        ("<div class='related-posts'><a href='1'>One</a> <a href='2'>Two</a></div>", ""),
        ("<aside class='related'><p>More of this</p></aside>", ""),
        ("<aside><a href='1'>One</a> <a href='2'>Two</a></aside>", ""),
        ("<div class='advert'><p>Buy</p></div>", ""),
        ("<div class='ad-box'><p>Buy</p></div>", ""),
        ("<div class='cookie-notice'><p>We use them</p></div>", ""),
        ("<div id='comments'><p>First!</p></div>", ""),
        ("<form><p>Your mail</p></form>", ""),
        ("<button>Share</button>", ""),
        ("<div role='navigation'><p>Up</p></div>", ""),
        ("<noscript><p>Turn it on</p></noscript>", ""),
    ],
)
@pytest.mark.parametrize("around", ["article", "main"])
def test_names_alone_take_nothing_from_an_article(inner, kept, around):
    if around == "main" and "<header>" in inner:
        return
    html = f"<body><nav>top</nav><{around}><h1>Title</h1><p>{LONG}</p>{inner}<p>End.</p></{around}></body>"
    assert keep(html) == " ".join(f"Title {LONG} {kept} End.".split())


def test_an_article_in_noscript():
    assert keep(f"<body><div id='root'></div><noscript><article><h1>T</h1><p>{LONG}</p></article></noscript></body>") == f"T {LONG}"


#: What the second extractor leaves out by name and role: it shares nothing with the operator.
JUNK = set("nav menu sidebar footer header ad ads advert advertisement sponsored promo banner cookie cookies consent notice notices alert popup modal share social related recommended comment comments breadcrumb breadcrumbs pagination newsletter subscribe search widget copyright".split())
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}


class Plain(HTMLParser):
    """A second extractor for well-formed pages, on the standard library's parser: a stack of flags and nothing else."""

    GONE = frozenset("head script style noscript nav footer aside button select form template svg iframe".split())
    FLOWS = frozenset("a b i em strong span code small sub sup u mark abbr cite q time label".split())

    def __init__(self, root):
        super().__init__(convert_charrefs=True)
        self.root, self.stack, self.out = root, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = {w for k in ("class", "id") for n in (a.get(k) or "").lower().split() for w in (re.split("[-_]", n)[0], re.split("[-_]", n)[-1])}
        inside = any(t == self.root for t, _ in self.stack)
        gone = tag in self.GONE or tag == "header" and not inside or "hidden" in a or (a.get("role") or "") in JUNK_ROLES or bool(names & JUNK) and tag not in ("html", "body", "main")
        if tag not in self.FLOWS:
            self.out.append(" ")
        if tag not in ("br", "img", "hr", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "param", "track"):
            self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        if tag not in self.FLOWS:
            self.out.append(" ")

    def handle_data(self, data):
        if not any(g for _, g in self.stack) and (not self.root or any(t == self.root for t, _ in self.stack)):
            self.out.append(data)


def plain_text(html):
    root = "article" if "<article" in html else "main" if "<main" in html else ""
    reader = Plain(root)
    reader.feed(html)
    reader.close()
    return " ".join("".join(reader.out).split())


def test_the_tables_pages_read_the_same_with_a_second_extractor(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op8_main_text(spark, d).collect()}
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert set(got) == set(html)
    other = [i for i, h in html.items() if plain_text(h or "") != got[i]]
    assert other == []
    assert all(got.values())


def test_templates_of_a_host(spark):
    box = "<div class='box'><p>Subscribe to our daily letter today</p></div>"
    rows = [(i, f"https://a.example/p{i}", f"<body>{box}<p>Story number {i}</p><p>Shared line</p></body>") for i in range(8)]
    rows += [(100, "https://b.example/x", f"<body>{box}<p>Elsewhere</p></body>"), (101, None, f"<body>{box}<p>No host</p></body>"), (102, "https://a.example/q", None)]
    got = texts(pages.main_text(made(spark, rows)))
    assert all(got[i] == f"Story number {i} Shared line" for i in range(8))
    assert got[100] == "Subscribe to our daily letter today Elsewhere"
    assert got[101] == "Subscribe to our daily letter today No host"
    assert got[102] == ""


def test_templates_are_those_of_a_count(spark):
    """Subtree counts per host against a plain dictionary; equal pages count once; large hosts need a lower share."""
    rows = [(i, f"https://h{i % 3}.example/{i}", f"<div><p>{'same' if i % 2 else i}</p></div><section>{i % 4}</section>") for i in range(60)]
    rows += [(i, f"https://big.example/{i}", f"<div><p>page {i}</p></div><section>{'box' if i < 60 else i}</section><ul><li>{i % 6}</li></ul>") for i in range(300)]
    rows += [(i, "https://copies.example/", "<div><p>a copy</p></div>") for i in range(20)]
    df = made(spark, rows).selectExpr("regexp_extract(url, '//([^/]*)', 1) as host", "html")
    got = {(r.host, r.digest) for r in pages.templates(df).collect()}
    on: dict = Counter()
    of_host = defaultdict(set)
    for _, url, html in rows:
        of_host[re.search("//([^/]*)", url)[1]].add(html)
    for host, htmls in of_host.items():
        for html in htmls:
            on.update((host, digest) for digest in pages.digests(pages.parse(html)))
    n = {host: len(htmls) for host, htmls in of_host.items()}
    assert got == {(h, d) for (h, d), c in on.items() if n[h] >= 5 and c >= 5 and c >= min(0.4 * n[h], max(50, 0.01 * n[h]))}
    assert any(h == "big.example" for h, _ in got)
    assert not any(h == "copies.example" for h, _ in got)


def test_a_template_that_holds_the_page_stays(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div><h1>Same</h1><p>{LONG}</p></div><p>{i}</p></body>") for i in range(8)]
    assert all(r.text == f"Same {LONG} {r.page_id}" for r in pages.main_text(made(spark, rows)).collect())


def test_many_template_hashes_are_joined_by_shuffle(spark, monkeypatch):
    box = "<div class='box'><p>Subscribe to our daily letter today</p></div>"
    rows = [(i, f"https://a.example/p{i}", f"<body>{box}<p>Story number {i}</p></body>") for i in range(8)]
    want = texts(pages.main_text(made(spark, rows)))
    monkeypatch.setattr(pages, "MOST_BROADCAST", 0)
    assert texts(pages.main_text(made(spark, rows))) == want == {i: f"Story number {i}" for i in range(8)}


def test_query_over_the_small_table(spark, small):
    rows = queries.op8_main_text(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    for r in rows:
        assert r.text == " ".join(r.text.split())
        assert r.n_chars == len(r.text)


def test_clashing_columns_and_empty_table(spark):
    out = pages.main_text(made(spark, [(1, "https://a.b/", "<p>x</p>"), (1, "https://a.b/", "<p>x</p>")]))
    assert [r.text for r in out.collect()] == ["x", "x"]
    assert pages.main_text(made(spark, [])).collect() == []
