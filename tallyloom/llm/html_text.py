"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to the elements above them,
less with each level; an element's points are discounted by the share of its
text that stands in links. The best element, raised to the article that holds
it, and siblings that score well or read like paragraphs are kept.

Names of classes and ids only speak against an element. One that is called
nothing but comments, advert or cookie banner is excluded; one with other names
of that kind (menu, header, share), or with such a word in a name of its own
(menu-recipe), and a form are excluded unless they hold most of the page's
paragraphs, as a form around a whole page does. A section of an article that
reads like one may be called what it likes (discussion, related-work).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|textarea|title)(?![\w:-])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|/)?)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
#: Start and end tags of elements that hold no text of the page, ends of what they never hold, and what may only look like them.
_EMBEDS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|textarea|title)(?![\w:-])(?P<attrs>[^>]*+)>(?:.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<(?P<end>/?)(?P<tag>svg|object|canvas|audio|video|template|select|annotation-xml|annotation)(?![\w:-])(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</(?P<bar>article|main|body)(?![\w:-])",
    re.S | re.I,
)
_EMBED = set("svg object canvas audio video template select annotation annotation-xml".split())
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Names of elements and words of their attributes.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small strike strong sub sup time tt u var "
              "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_DROPPED = set("head nav footer aside menu dialog button".split())
_DOUBTFUL = set("form fieldset header".split())
_READ = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_NEVER = set("html body article main".split())
_UNWANTED = set(
    "ad ads adbox adunit adsense adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login paywall menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus discussion "
    "related recommended recommendations pagination pager skip hidden".split()
)
#: Those that exclude an element if its name says nothing else; the others do so in pairs.
_ALWAYS = set(
    "ad ads adbox adunit adsense adslot advert adverts advertisement sponsored promo promoted gdpr consent newsletter signup login paywall navbar "
    "breadcrumb breadcrumbs comment comments commentlist disqus pagination pager skip".split()
)
_SUSPECT = set("banner notice alert share sharing social sidebar sidebars aside footer foot widget widgets masthead toolbar search topbar header".split())
#: Words that say where or how large an element is, or whose service it links to: they don't make a name mean something else.
_NEUTRAL = set("page site main top bottom left right primary secondary global box block bar area section wrapper wrap container inner outer content list item items button buttons link links icon icons "
               "post posts entry entries article articles story stories text title row col column facebook twitter linkedin whatsapp pinterest reddit email print "
               "reader readers user users visitor visitors thread threads feed form author body meta count latest recent".split())
_STATES = set("open opened closed enabled disabled fixed loaded accepted".split())
_ABSENT = set("has with without no not is".split())
_TITLED = set("article post entry story content title".split())
_WRAPS = set("wrap wrapper container layout grid row".split())
_APART = set("ad ads comment comments commentlist promo related replies reply".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_BOUNDS = set("table ul ol dl body html".split())
_FIRST = {"div": 5, "article": 10, "section": 3, "main": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "th": -5}
_GOOD = set("article body content entry main page post text blog story".split())
LEVELS, SCORED_CHARS = 5, 25
#: An element under suspicion is a plain wrapper if it holds more than this share of the page's paragraph points.
MOST = 0.7
#: A section of an article has less than this share of its text in links.
SECTION_LINKS = 0.25


@lru_cache(maxsize=10_000)
def _class_words(value: str) -> tuple[tuple[str, ...], ...]:
    """The words of each name in a class or id."""
    names = (re.split(r"[^a-z0-9]+", _HUMP.sub("-", name).lower()) for name in value.split())
    return tuple(w for words in names if (w := tuple(filter(None, words))))


@lru_cache(maxsize=10_000)
def _unwanted(value: str, inside: bool) -> tuple[frozenset[str], bool, bool]:
    """(what excludes an element of this class or id, whether it is under
    suspicion, whether it is cleared of that if it reads like a section of an
    article). Names of a page's state or layout (has-sidebar, comments-open,
    content-sidebar-wrap) say nothing of the element, and a header within an
    article belongs to it."""
    found: set[str] = set()
    suspect = cleared = False
    for words in _class_words(value):
        if "hidden" in words:
            if words in (("hidden",), ("is", "hidden"), ("visually", "hidden")):
                found.add("hidden")
            continue
        bad = _UNWANTED.intersection(words)
        doubt = _SUSPECT.intersection(words)
        if not (bad or doubt) or words[0] in _ABSENT or "with" in words or words[-1] in _STATES:
            continue
        if bad | doubt <= {"widget", "widgets"} and words[0] not in doubt:  # what page builders call every block
            continue
        if bad | doubt == {"header"} and (inside or words[0] in _TITLED):
            continue
        if bad | doubt <= {"sidebar", "sidebars"} and words[-1] in _WRAPS and not {*words} <= doubt | _WRAPS:
            continue
        named = all(w in _UNWANTED or w in _SUSPECT or w in _NEUTRAL or w.isdigit() for w in words)
        if bad and named and (bad & _ALWAYS or len(bad | doubt) > 1):
            found |= bad
        elif bad:
            suspect = cleared = True
        else:
            suspect |= named or not inside
    return frozenset(found), suspect, cleared


@lru_cache(maxsize=10_000)
def _says_only(value: str) -> bool:
    """Whether a class of a heading or paragraph is nothing but unwanted words."""
    return any(all(w in _UNWANTED or w in _SUSPECT for w in words) for words in _class_words(value))


def _embedded(source: str) -> dict[int, int]:
    """Where elements without text of the page begin and where their own end tag
    ends. One that closes itself or is never closed holds nothing."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at = 0
    while m := _EMBEDS.search(source, at):
        at = m.end()
        if m["raw"]:
            if m["attrs"].endswith("/") and opened.get("svg"):  # closes itself there
                at = m.end("attrs") + 1
        elif m["bar"]:
            opened.clear()
        elif tag := m["tag"]:
            starts = opened.setdefault(tag.lower(), [])
            if not m["end"]:
                if not m["rest"].endswith("/"):
                    starts.append(m.start())
            elif starts:
                found[starts.pop()] = at
    return found


class _Page:
    """The elements of a page (parallel lists; 0 is the root) and its text blocks in order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.drop, self.bonus, self.inside, self.suspect, self.cleared = [0], ["#root"], [False], [0], [False], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self.stack, self.parts, self.linked, self.links, self.in_link = [0], [], 0, 0, False
        self.at: dict[str, list[int]] = {}  # by tag: where on the stack its open elements are
        self.solid = [0]  # for each element of the stack: where the last one is that isn't a span
        # A tag that the page's end cuts off is closed there, so no search for a tag's end is in vain.
        whole, source = len(source), source + ">"
        embedded = _embedded(source)
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = embedded.get(m.start()) or m.end()
            name = m["tag"] or m["tag2"]
            if name and name.lower() not in _EMBED:
                self._tag(name.lower(), bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or "")
        self._text(source[at:whole])
        self._flush()

    def _text(self, text: str) -> None:
        if self.drop[self.stack[-1]]:
            return
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def _flush(self) -> None:
        if self.parts and (text := " ".join("".join(self.parts).split())):
            self.blocks.append((self.stack[-1], text, min(self.linked, len(text)), max(self.links, int(self.linked > 0))))
        self.parts, self.linked, self.links = [], 0, 0

    def _pop_to(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.at[self.tag[e]].pop()
        del self.stack[depth:], self.solid[depth:]

    def _last(self, tags) -> int:
        """Where on the stack the innermost open element of one of these tags is; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _tag(self, tag: str, end: bool, attrs: str) -> None:
        if tag == "a":
            self.in_link = not end and "href" in attrs.lower()
            self.links += self.in_link and not self.drop[self.stack[-1]]
            return
        if tag in _INLINE:
            return
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag != "span":
            self._flush()
        if end:
            depth = self._last((tag,))
            if depth and (tag != "span" or depth == len(self.stack) - 1):  # a span's end closes nothing but the innermost element
                self._pop_to(depth)
            if tag != "span":
                self.in_link = False
            return
        # Each step closes an element, so all of them together take time in proportion to the page.
        if tag in _CLOSES:
            while (depth := self._last(("p", *_CLOSES[tag]))) > self._last(_BOUNDS | _STOPS.get(tag, set())):
                self._pop_to(depth)
        elif tag != "span":
            while self.tag[self.stack[self.solid[-1]]] == "p":
                self._pop_to(self.solid[-1])
        self._open(tag, attrs)

    def _open(self, tag: str, attrs: str) -> None:
        above = self.stack[-1]
        drop, bonus, cleared = self.drop[above], 0, False
        inside = self.inside[above]
        suspect = tag in _DOUBTFUL and not (tag == "header" and inside)
        if tag in _DROPPED:
            drop = True
        if not drop and attrs:
            for key, *values in _ATTR.findall(attrs):
                key, value = key.lower(), html.unescape("".join(values))
                if key in ("class", "id"):
                    unwanted, doubted, clears = _unwanted(value, inside)
                    if tag in _READ:  # an id is often a slug of its words
                        drop |= "hidden" in unwanted or key == "class" and _says_only(value)
                    elif tag not in _NEVER or tag == "article" and unwanted & _APART:
                        drop |= bool(unwanted)
                        if doubted and tag not in _NEVER:
                            suspect, cleared = True, clears and (cleared or not suspect)
                    bonus += 25 * any(_GOOD.intersection(w) for w in _class_words(value))
                elif tag not in _NEVER:
                    value = value.lower()
                    drop |= key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        self.parent.append(above)
        self.tag.append(tag)
        self.drop.append(bool(drop))
        self.bonus.append(bonus - 25 * suspect)
        self.suspect.append(suspect)
        self.cleared.append(cleared)
        self.inside.append(inside or tag in ("article", "main"))
        self.stack.append(len(self.tag) - 1)
        self.at.setdefault(tag, []).append(len(self.stack) - 1)
        self.solid.append(self.solid[-1] if tag == "span" else len(self.stack) - 1)

    def path(self, element: int) -> Iterator[int]:
        while element:
            yield element
            element = self.parent[element]


def main_text(source: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not source:
        return ""
    page = _Page(source)
    if not page.blocks:
        return ""
    n = len(page.tag)
    chars, linked, points, links, read = [0] * n, [0] * n, [0.0] * n, [0] * n, [0.0] * n
    worth = [1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= SCORED_CHARS else 0.0 for _, text, *_ in page.blocks]
    held, in_link, headings = [0] * n, [0] * n, [0] * n
    for (element, text, in_links, _), w in zip(page.blocks, worth, strict=True):
        read[element] += w * (2 * in_links < len(text))
        held[element] += len(text)
        in_link[element] += in_links
        headings[element] += page.tag[element] in _HEADINGS
    for e in range(n - 1, 0, -1):  # an element stands after its parent
        for sums in (read, held, in_link, headings):
            sums[page.parent[e]] += sums[e]
    out, article = page.drop[:], [False] * n
    for e in range(1, n):
        above = page.parent[e]
        article[e] = article[above] or page.tag[e] == "article"
        section = page.cleared[e] and article[e] and read[e] and (page.tag[e] == "section" or headings[e]) and in_link[e] < SECTION_LINKS * held[e]
        out[e] |= out[above] or page.suspect[e] and not section and read[e] <= MOST * read[0]
    for (element, text, in_links, anchors), w in zip(page.blocks, worth, strict=True):
        if out[element]:
            continue
        chars[element] += len(text)
        linked[element] += in_links
        links[element] += anchors
        if w:
            above = page.parent[element] if re.fullmatch(r"p|h[1-6]|li|dd|dt|span|pre|blockquote", page.tag[element]) and page.parent[element] else element
            for level, e in zip(range(LEVELS), page.path(above), strict=False):
                points[e] += w / (1, 2, 6, 9, 12)[level]
    for e in range(n - 1, 0, -1):
        for sums in (chars, linked, links):
            sums[page.parent[e]] += sums[e]
    density = [x / max(c, 1) for x, c in zip(linked, chars, strict=True)]
    score = [(p + _FIRST.get(t, 0) + b) * (1 - d) if p else 0.0 for p, t, b, d in zip(points, page.tag, page.bonus, density, strict=True)]
    best = max(range(n), key=score.__getitem__)
    if score[best] <= 0:
        found = [e for e in range(n) if page.tag[e] in ("article", "main") and chars[e]]
        best = max(found, key=chars.__getitem__) if found else 0
    else:
        while (up := page.parent[best]) and page.tag[best] not in ("article", "main", "body") and page.tag[up] != "body" and points[up] >= 0.75 * points[best]:
            best = up
        best = next((e for e in page.path(best) if page.tag[e] == "article"), next((e for e in page.path(best) if page.tag[e] == "main"), best))
    kept = {best}
    if best:
        enough = max(10.0, 0.2 * score[best])
        # Blocks that stand in the container itself stay with the best element only if they read like paragraphs.
        for e in range(1, n):
            if e != best and page.parent[e] == page.parent[best] and not out[e] and chars[e] and page.tag[best] not in ("body", "html"):
                plain = page.tag[e] == "p" and (chars[e] > 80 and density[e] < 0.25 or chars[e] <= 80 and not linked[e])
                if plain or score[e] >= enough and density[e] < 0.5:
                    kept.add(e)
    holds = [e in kept for e in range(n)]
    for e in range(1, n):
        menu = page.tag[e] in ("ul", "ol", "div", "table", "section", "p") and links[e] > 1 + (page.tag[e] == "p") and density[e] > 0.7
        holds[e] = (holds[e] or holds[page.parent[e]]) and not menu and not out[e]
    return "\n\n".join(text for element, text, *_ in page.blocks if holds[element])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html;
    other columns are left out). Blocks are in page order, joined by two line
    feeds, white space within one turned into one space. A null, empty or
    textless page has an empty text; repeated rows come back as often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
