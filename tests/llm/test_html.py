"""Main text of pages: hand-made pages, an independent extractor, time on broken markup."""

import pathlib
import time
from html.parser import HTMLParser

import pytest

from tallyloom.llm.html_text import extract, main_text

LONG = "A sentence of the article, with commas, and enough characters to count as a paragraph of text."
PAGES = {
    "article": (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short &amp; last.</article><footer>{LONG}</footer>", f"Title\n\n{LONG}\n\nShort & last."),
    "soup": (f"<body class='has-sidebar'><div id=cookie-banner>{LONG}</div><div class=menu><a href=1>a</a> <a href=2>b</a></div><div class=content><h2>Head</h2><div>{LONG}</div><p>{LONG}</p><ul><li>One<li>Two</ul><pre>a   b</pre></div><div class='sidebar'><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG}</p></form></body>", f"Head\n\n{LONG}\n\n{LONG}\n\nOne\n\nTwo\n\na b"),
    "states": (f"<div class='content-sidebar-wrap'><div class='post comments-open'><p>{LONG}</p></div><ul class=commentlist><li class=comment><div class=comment-content><p>{LONG}</p></div></ul></div>", LONG),
    "scripts": (f"<body><script>var x='</p><p>{LONG}';</script><style>p{{}}</style><!-- <p>{LONG}</p> --><main><p>{LONG}</p><noscript>{LONG}</noscript></main></body>", LONG),
    "inline": (f"<article><p>{LONG} <b>bo</b>ld<br>next&nbsp;line</p></article>", f"{LONG} bold next line"),
    "short": ("<body><div class=ad>Buy</div><article><p>Tiny.</p></article></body>", "Tiny."),
    "empty": ("", ""),
    "plain": ("no markup at all", "no markup at all"),
    "broken": (f"<article><p>{LONG}<p class=\"x>{LONG}", None),
    "layout": (f"<div class='page has-sidebar overflow-hidden'><div class='page-footer'><p>{LONG}</p></div><div class='sidebar container'><p>{LONG}</p></div><div class='entry-content' data-state='hidden' data-id='ad'><div class='post-header'><h1>Head</h1></div><p title='hidden'>{LONG}</p><div class='elementor-widget'><p>{LONG}</p></div><div class=readerComments><p>{LONG}</p></div></div></div>", f"Head\n\n{LONG}\n\n{LONG}"),
    "links": (f"<article><p><a href=1>Front page</a> | <a href=2>Weather</a> | <a href=3>Sports</a></p><p>{LONG} <a href=4>Four</a></p></article>", f"{LONG} Four"),
    "unmatched": ("<div>" * 20000 + "</section>" * 20000 + f"<p>{LONG}</p>" + "<li>x" * 20000, None),
    "deep": ("<div>" * 3000 + f"<p>{LONG}</p>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    source, want = PAGES[name]
    got = main_text(source)
    assert want is None or got == want


def test_pages_column(spark):
    rows = [(i, f"u{i}", s, "clash", 1) for i, (s, _) in enumerate(PAGES.values())] + [(99, None, None, "clash", 1)] * 2
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    assert [x.text for x in got if x.page_id == 99] == ["", ""]


EMBEDDED = {
    "self-closed": (f'<article><p>A <svg class="i"/> b</p><p>{LONG}</p></article>', f"A b\n\n{LONG}"),
    "closed": (f"<article><p>A <svg><title/><text>no</text><svg><g/></svg></svg> b</p><select><option>no</select><p>{LONG}</p></article>", f"A b\n\n{LONG}"),
    "unclosed": (f"<article><video src=1><p>{LONG}</p><object data=2><p>Last.</p><video src=3>no</video></article>", f"{LONG}\n\nLast."),
    "closed elsewhere": (f"<article><video src=1><p>{LONG}</p></article><div></video></div>", LONG),
    "custom": (f"<article><video-player><p>{LONG}</p></video-player><title-bar>Name</title-bar><p>{LONG}</p></article>", f"{LONG}\n\nName\n\n{LONG}"),
    "math": (f"<article><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=tex>x=2</annotation></semantics></math> hold. {LONG}</p></article>", f"Let x=2 hold. {LONG}"),
    "only looks so": (f"<article><video><script>'</video>'</script>no<!-- </video> --> no</video><p>{LONG}</p></article>", LONG),
    "many": (f"<article><p>{LONG}</p>" + "<svg><video>" * 20000 + "</article>", LONG),
}


@pytest.mark.parametrize("name", EMBEDDED)
def test_embedded_elements_swallow_nothing_else(name):
    source, want = EMBEDDED[name]
    assert main_text(source) == want


SIX = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
SIX_TEXT = "\n\n".join(f"{LONG} {i}" for i in range(6))
NAMED = {
    "page-wide form": (f'<body><form id="aspnetForm"><div>{SIX}</div></form></body>', SIX_TEXT),
    "form beside": (f"<body><div class=content>{SIX}</div><form><p>{LONG}</p></form></body>", SIX_TEXT),
    "form in form": (f"<body><form><div class=sidebar><p>{LONG}</p></div><div class=content>{SIX}</div></form></body>", SIX_TEXT),
    "search": (f'<body><div class="search-results-article">{SIX}</div></body>', SIX_TEXT),
    "share": (f'<main><div class="share-price-report">{SIX}</div></main>', SIX_TEXT),
    "header": (f'<body><div class="header-main content">{SIX}</div></body>', SIX_TEXT),
    "footer": (f'<body><div id="page-footer-fix">{SIX}</div></body>', SIX_TEXT),
    "heading's id": (f'<article><h2 id="related-work">Related work</h2>{SIX}<h2 id="search-algorithms">Search</h2></article>', f"Related work\n\n{SIX_TEXT}\n\nSearch"),
    "paragraph's id": (f'<article>{SIX}<p id="notice-of-appeal">{LONG}</p><p class=advert>{LONG}</p></article>', f"{SIX_TEXT}\n\n{LONG}"),
    "subject": (f"<article>{SIX}<div class='social-history'><p>{LONG}</p></div><div class='social-share-buttons'><p>{LONG}</p></div></article>", f"{SIX_TEXT}\n\n{LONG}"),
    "subjects": (f"<article>{SIX}" + "".join(f"<section id='{n}'><h2>About</h2><p>{LONG}</p></section>" for n in ("related-work", "discussion", "recommendations", "comments-on-method", "replies", "navigation", "menu", "cookies")) + "</article>", SIX_TEXT + f"\n\nAbout\n\n{LONG}" * 8),
    "subjects of divs": (f"<article>{SIX}" + "".join(f"<div class='{n}'><h3>About</h3><p>{LONG}</p></div>" for n in ("related-work", "discussion", "menu")) + "</article>", SIX_TEXT + f"\n\nAbout\n\n{LONG}" * 3),
    "boilerplate in an article": (f"<article>{SIX}" + "".join(f"<{t} class='{n}'><h2>About</h2><p>{x}</p></{t}>" for t in ("div", "section") for n in ("comments", "ad", "cookie-banner", "newsletter", "user-comments", "related-posts promo", "nav-menu", "subscribe-popup", "reader-comments") for x in (LONG, f"<a href=1>{LONG}</a>")) + f"<div class=related><p>{LONG}</p></div><section class=related><h2>More</h2><p><a href=1>{LONG}</a></p></section><div class=comment-author><p>{LONG}</p></div></article>", SIX_TEXT),
    "boilerplate beside it": (f"<body><div class=content>{SIX}</div>" + "".join(f"<section class='{n}'><h2>About</h2><p>{LONG}</p></section>" for n in ("related", "discussion", "popup", "menu-recipe", "comments", "cookies", "subscribe")) + "</body>", SIX_TEXT),
    "comments outweigh": (f"<body><div class=content>{SIX}</div><div id=comments>{SIX * 4}</div></body>", SIX_TEXT),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_alone_exclude_no_article(name):
    source, want = NAMED[name]
    assert main_text(source) == want


@pytest.mark.parametrize("attribute", [
    *(f"class='{n}'" for n in ("comment-piece", "menu-recipe", "navigation-guide", "subscription-models", "promotion-history", "popup-book", "ad-hoc-committee", "cookie-recipe", "advertising-industry", "article overlay", "pager-history content")),
    "id=discussion",
])
def test_words_in_a_name_exclude_no_container(attribute):
    assert main_text(f"<body><nav class=menu><a href=1>Home</a></nav><div {attribute}>{SIX}</div><div class=promo><p>{LONG}</p></div></body>") == SIX_TEXT


@pytest.mark.parametrize("parts", ["<span><div></div>", "<span>x", "<p><span>", "<li><span><div>", "<p><foo>", "<td><span>x</td>"])
def test_open_elements_take_time_in_proportion(parts):
    began = time.process_time()
    assert main_text(f"<p>{LONG}</p>" + parts * ((1 << 20) // len(parts)))  # a megabyte of x outweighs it
    half = (1 << 19) // len(parts)
    assert main_text(f"<p>{LONG}</p>" + parts * half + "<div></div>" * half + "<dt>" * half)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("part", ["<a ", "<script", '<a "', "<svg ", "<!", "<!--", "<script>", "<a '", '<a b="', "<td", "</", "<p ", "&"])
def test_a_megabyte_of_broken_markup_takes_time_in_proportion(part):
    began = time.process_time()
    assert LONG in main_text(f"<p>{LONG}</p>" + part * ((1 << 20) // len(part)))
    assert time.process_time() - began < 10


class Article(HTMLParser):
    """Independent of the operator: the blocks of <article>, as the generated pages mark it."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        self.blocks += [""] * (tag in ("article", "h1", "p"))
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        self.blocks += [""] * (tag in ("article", "h1", "p"))

    def handle_data(self, data):
        self.blocks[-1] += data if self.on else ""


TABLES = pathlib.Path("/root/testdata/sf0.001/pages.parquet")


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
def test_equals_an_independent_extractor(spark):
    pages = spark.read.parquet(str(TABLES))
    got = {x.page_id: x.text for x in extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) > 0
    for page_id, source in rows:
        a = Article()
        a.feed(source or "")
        a.close()
        assert got[page_id] == "\n\n".join(t for b in a.blocks if (t := " ".join(b.split())))
