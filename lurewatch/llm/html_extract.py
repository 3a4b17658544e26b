"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks of text with their root-to-leaf paths of block elements. Per path, the mean length of text
outside links and the mean number of punctuation marks of its blocks are taken; both series are smoothed along the page and
fused by their geometric mean, which is then averaged with that of the path alone. What a tag, role, class or id says is
evidence that scales a block's ratio: down below menus, forms, adverts, comments and the like, up below ``article`` and
``main``. It says nothing where it names an element that holds most of the page's text or the article itself. Blocks above a
share of the ratios' mean are the content nodes; the element that holds nearly all of their text is the article, and its other
blocks (headings, list items, captions) belong to it unless evidence is against them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video map datalist select textarea button".split())
#: Elements that by their tag are not the article; of these, ``form`` may be a wrapper of the page.
ASIDE = frozenset("nav aside footer menu dialog form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first name ends where one of the others starts.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "tr": frozenset("tr tbody tfoot".split()),
}
#: Parts of a text, which are not the article alone.
PARTS = HEADINGS | frozenset("p ul ol dl li dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption".split())
#: Words of class and id that name something other than the article where they end a name, and words that may follow them.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertorial adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar side rail widget widgets footer foot header masthead topbar toolbar comment comments respond replies disqus discussion
share sharing social follow related recommended recirc trending newsletter subscribe signup login search copyright legal disclaimer skip hidden""".split())
_AFTER = frozenset("wrapper wrap container box bar block section area list item items links link buttons button inner outer content text body slot unit module panel row col column group form top bottom left right main primary secondary".split())
_STATES = frozenset("has with without no is not".split())
#: Headings that open something other than the article.
_OTHER_HEADING = re.compile(r"(?:\d+ )?(?:reader |user |all |latest |leave a |add a |post a )?(?:comments?|replies|responses|reply|discussion)(?: \(\d+\))?[:.]?|related(?: \w+)?[:.]?|you (?:may|might) also like[:.]?|more (?:from|on) .{1,40}|read (?:more|next)[:.]?|share this.{0,20}|advertisement|sponsored.{0,20}|recommended(?: for you)?[:.]?", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،]")
#: Ratios above this share of their mean, weighted by text, mark content, and none below ``LEAST`` does.
CUT, LEAST = 0.5, 1.0
#: What evidence against and for a block multiplies its ratio by.
AGAINST, FOR = 0.02, 2.0
#: Characters that make an element with half of the page's text a wrapper.
WRAPPER_CHARS = 200


@dataclass(eq=False)
class Element:
    tag: str
    skipped: bool
    path: int
    parent: Element | None
    article: Element | None
    named: bool = False  # by class or id
    aside: bool = False  # by tag or role
    depth: int = 0
    weight: int = 0
    holds_article: bool = False
    against: bool = False
    inside: bool = False


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    other: bool = False  # below a heading of something else


def names_other(value: str, within_article: bool) -> bool:
    """Whether a class or id value names something other than the article."""
    for name in _CAMEL.sub("-", value).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] in _STATES:
            continue
        while len(words) > 1 and words[-1] in _AFTER:
            words.pop()
        if words and words[-1] in BOILERPLATE and not (within_article and words[-1] in ("header", "masthead")):
            return True
    return False


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", False, 0, None, None)
        self.top, self.blocks, self.links = self.root, [], 0
        self.elements, self.paths = [self.root], {}
        self.fresh = True

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at, given = self.top, dict(attrs)
        classes, role = f"{given.get('class') or ''} {given.get('id') or ''}", (given.get("role") or "").lower()
        path = self.paths.setdefault((at.path, tag, " ".join(sorted(set(classes.lower().split())))), len(self.paths) + 1)
        article = at.article is not None
        self.top = Element(
            tag, at.skipped or tag in SKIPPED or "hidden" in given, path, at, at.article, tag not in ("html", "body") and names_other(classes, article),
            tag in ASIDE or role in ROLES or (tag == "header" and not article), at.depth + 1)
        if not article and (tag in ARTICLE or role in ARTICLE):
            self.top.article = self.top
        self.elements.append(self.top)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "span" and not self.top.skipped and names_other(dict(attrs).get("class") or "", self.top.article is not None):
                self.fresh = True
                self._open(tag, attrs)
            elif tag == "a":
                self.links += 1
            elif tag == "br":
                self._add(" ")
            return
        self.fresh = True
        while self.top.parent and tag in CLOSES.get(self.top.tag, ()):
            self._close()
        if tag not in VOID:
            self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self) -> None:
        self.top = self.top.parent
        self.links = 0

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        at = self.top
        while at.parent and at.tag != tag:
            at = at.parent
        if not at.parent:
            self.fresh = self.fresh or tag not in INLINE
            return
        self.fresh = True
        while self.top is not at:
            self._close()
        self._close()

    def _add(self, data: str) -> None:
        if self.top.skipped:
            return
        if self.fresh or self.blocks[-1].element is not self.top:
            self.blocks.append(Block(self.top))
            self.fresh = False
        self.blocks[-1].parts.append(data)
        if self.links:
            self.blocks[-1].linked += len(data.strip())

    def handle_data(self, data: str) -> None:
        if not self.fresh or data.strip():
            self._add(data)


def read_blocks(html: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, white space as single spaces, and all elements, parents first."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    for block in reader.blocks:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in reader.blocks if b.text], reader.elements


def weigh_evidence(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """What tags, roles, names and headings say about each block, as a factor of its ratio."""
    for b in blocks:
        b.element.weight += max(0, len(b.text) - b.linked)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.weight += e.weight
            e.parent.holds_article = e.parent.holds_article or e.holds_article or e.article is e
    total = elements[0].weight
    for e in elements:
        wrapper = 2 * e.weight >= total and e.weight >= WRAPPER_CHARS
        against = (e.named and not (wrapper or e.holds_article)) or (e.aside and not (e.holds_article or (e.tag == "form" and wrapper)))
        e.against = against or (e.parent is not None and e.parent.against)
    opened: tuple[int, Element] | None = None
    for b in blocks:
        level = int(b.element.tag[1]) if b.element.tag in HEADINGS else None
        if opened and (b.element.depth < opened[1].depth + 1 or (level and level <= opened[0])):
            opened = None
        if level and b.element.parent is not None and _OTHER_HEADING.fullmatch(b.text):
            opened = (level, b.element.parent)
        b.other = opened is not None
    return np.array([AGAINST if b.element.against or b.other else FOR if b.element.article is not None else 1.0 for b in blocks])


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Tag-path ratio of each block: fused, of its own path and of the page around it, which lifts no path by its neighbours alone."""
    paths: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        paths.setdefault(b.element.path, []).append(i)
    length, marks = np.zeros(len(blocks)), np.zeros(len(blocks))
    for members in paths.values():
        length[members] = sum(len(blocks[i].text) - blocks[i].linked for i in members) / len(members)
        marks[members] = sum(len(_PUNCTUATION.findall(blocks[i].text)) for i in members) / len(members)
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(blocks)), kernel, mode="full")[2:-2]
    smooth = lambda v: np.convolve(v, kernel, mode="full")[2:-2] / weight
    fuse = lambda v, m: np.sqrt(np.maximum(v, 0) * (m + 0.1))
    return np.sqrt(fuse(length, marks) * fuse(smooth(length), smooth(marks)))


def _holder(blocks: list[Block], chosen: np.ndarray, elements: list[Element]) -> None:
    """Marks what lies inside the deepest element that holds nine tenths of the chosen text and is no mere part of a text."""
    for e in elements:
        e.weight = 0
    for i in chosen:
        blocks[i].element.weight += len(blocks[i].text)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.weight += e.weight
    top = max((e for e in elements if e.weight >= 0.9 * elements[0].weight), key=lambda e: e.depth)
    while top.parent is not None and top.tag in PARTS:
        top = top.parent
    for e in elements:
        e.inside = e is top or (e.parent is not None and e.parent.inside)


def main_text(html: str | None) -> str:
    """The article's blocks joined by two line ends; empty if there are none."""
    blocks, elements = read_blocks(html or "")
    if not blocks:
        return ""
    evidence = weigh_evidence(blocks, elements)
    ratio = path_ratios(blocks) * evidence
    mean = np.average(ratio, weights=[len(b.text) for b in blocks])
    above = ratio > max(LEAST, CUT * mean)
    if not above.any():
        return ""
    _holder(blocks, np.flatnonzero(above), elements)
    above &= np.array([b.element.inside for b in blocks]) | (ratio >= mean)  # elsewhere only what stands out as much as the article
    kept = [i for i, b in enumerate(blocks) if above[i] or (b.element.inside and evidence[i] >= 1)]
    within = [i for i in kept if above[i] or blocks[i].element.article is not None]
    if within:  # without an article tag, links before the first content node and after the last are menus that nothing names
        first, last = within[0], within[-1]
        kept = [i for i in kept if first <= i <= last or 2 * blocks[i].linked <= len(blocks[i].text)]
    return "\n\n".join(blocks[i].text for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text, as does a page without an article; repeated rows are each
    read; broken markup is read as far as it goes. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
