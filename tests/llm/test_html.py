"""Main text of pages: the given pages in several dresses, and wrappers, names and headings that mislead."""

import re

import pyarrow.parquet as pq
import pytest

from lurewatch.llm import html_extract as H

LONG = "A long text, it is, and it goes on. " * 12
TEXT = LONG.strip()


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()["html"]


def article_of(html):
    return [b.text for b in H.read_blocks(re.search("<article>(.*?)</article>", html, re.S)[1])[0]]


@pytest.mark.parametrize("dress", [
    lambda h: h,
    lambda h: re.sub("(</?)article", r"\1div", h),
    lambda h: re.sub("</?article>", "", h),
    lambda h: h.replace("<body>", '<body><div class="site has-sidebar">').replace("</body>", "</div></body>"),
    lambda h: h.replace("<body>", '<body><form id="aspnetForm">').replace("</body>", "</form></body>"),
    lambda h: h.replace("<article>", '<div class="header-content"><article>').replace("</article>", "</article></div>"),
])
def test_given_pages_in_any_dress(pages, dress):
    for html in pages:
        assert H.main_text(dress(html)) == "\n\n".join(article_of(html))


def test_ratios_alone_find_most(pages):
    """Without tags and names to go by, all of the article is kept and three quarters of the rest is left out."""
    held = wanted = let_in = rest = 0
    for html in pages:
        article, bare = article_of(html), re.sub(r"(</?)(article|nav|footer)\b", r"\1div", html).replace(' class="ad"', "")
        got = H.main_text(bare).split("\n\n")
        wanted += sum(map(len, article))
        held += sum(len(t) for t in article if t in got)
        rest += sum(len(b.text) for b in H.read_blocks(html)[0] if b.text not in article)
        let_in += sum(len(t) for t in got if t not in article)
    assert held >= 0.99 * wanted and let_in <= 0.3 * rest


@pytest.mark.parametrize(("html", "want"), [
    (f"<body><div class='site has-sidebar'><h1>T</h1><p>{LONG}</p></div>", ["T", TEXT]),
    (f"<body><article><div class='post-header'><h1>Title</h1></div><p>{LONG}</p></article>", ["Title", TEXT]),
    (f"<body><article><p>{LONG}</p><section class='legal-history'><p>Old law, new law.</p></section></article>", [TEXT, "Old law, new law."]),
    (f"<body><article><p>{LONG}</p><ul><li><a href='x'>linked</a></li><li>plain</li></ul></article>", [TEXT, "linked", "plain"]),
    (f"<body><article><h1><a href='x'>Linked title</a></h1><p>{LONG}</p></article>", ["Linked title", TEXT]),
    (f"<body><article><p>{LONG}</p><aside>See also this, and that.</aside><div class='ad-slot'>Buy now, pay later.</div></article>", [TEXT]),
    (f"<body><article><p>{LONG}</p></article><h3>12 Comments</h3><div><p>I like it, I do, really.</p><p>{LONG[:100]}</p></div>", [TEXT]),
    (f"<body><div><h1>T</h1><p>{LONG}</p><h3>Related</h3><p>One more, two more.</p></div>", ["T", TEXT]),
    (f"<body><div role='navigation'><p>{LONG[:80]}</p></div><main><p>{LONG}</p></main>", [TEXT]),
    (f"<body><div class='cookie-consent-banner'><p>{LONG[:90]}</p></div><div><p>{LONG}</p><p>Short end.</p></div><footer>&copy; me, 2020.</footer>", [TEXT, "Short end."]),
    ("<body><nav><a href='x'>x</a></nav><footer>&copy; me.</footer>", []),
    ("<p hidden>no, no.</p>", []),
])
def test_what_belongs_to_the_article(html, want):
    assert H.main_text(html).split("\n\n") == (want or [""])


@pytest.mark.parametrize(("name", "other"), [
    ("sidebar", True), ("left-sidebar", True), ("has-sidebar", False), ("siteFooter", True), ("share-buttons", True), ("share-price", False), ("comment-list", True),
    ("legal-history", False), ("ad", True), ("ad-slot-3", True), ("address", False), ("main content", False), ("no-comments", False), ("td-header-wrap", True),
])
def test_names(name, other):
    assert H.names_other(name, within_article=False) == other


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    assert H.main_text(deep) == "deep, text."
    many = "".join(f"<p class='c{i % 50}'>Paragraph {i}, of many, {LONG[:60]}</p>" for i in range(5000))
    assert H.main_text(f"<body><article>{many}</article>").count("\n\n") == 4999
