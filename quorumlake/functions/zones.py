"""Zones of HTML pages: elements as spans of the source, found by selectors; contents, menus and anchored sections."""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.functions.html import CLOSES_P, VOID

#: Selectors of content, the likeliest first.
CONTENTS = (
    "[data-cprole='mainContentContainer']",
    "#moduleContent",
    "#moduleContent #page",
    "#page.moduleContentNew",
    "#ContentPlaceHolder1_UpdatePanel1",
    "#ContentArea",
    "#TopContentArea",
    "main",
    "[role='main']",
    "article",
    "#primary",
    ".site-main",
    ".entry-content",
    ".hentry",
    ".region-content",
    "#content-area",
    ".block-system-main-block",
    "#content",
    "#main-content",
    "#page-content",
    "#main",
    "#maincontent",
    ".content",
    ".main-content",
    ".page-content",
    ".normal_content_area",
    ".inner-content",
    ".content-area",
)
#: Selectors that tell content without another page, and the characters it needs.
QUICK, QUICK_CHARS = ("main", "[role='main']", "#primary", ".site-main", ".region-content"), 300
#: Up to how many characters a block may be a mere heading, and from how many the block behind it counts;
#: what the texts of headings have.
HEADING, BEHIND = 160, 180
_TRAIL = re.compile(r"(?i)(you are here|breadcrumb|home\s*[>/]|\s>\s|\s\|\s)")
_SERVICES = re.compile(r"(?i)(government|departments?|services|residents|business|how do i)")
#: Fixed value: names of main menus.
_PRIMARY = re.compile(r"(?i)\b(main|primary|site|global|top|header|masthead)\b")
#: Elements whose text is not read.
_UNREAD = frozenset("script style noscript template".split())
_COMPOUND = re.compile(r"#((?:\\.|[\w-])+)|\.((?:\\.|[\w-])+)|\[([\w-]+)='((?:\\.|[^'\\])*)'\]|:nth-of-type\((\d+)\)|^([\w-]+)")
_SPACE = re.compile(r"\s+")


def _flat(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


@dataclass(eq=False)
class Element:
    """An element: where its source, its pieces of text and the elements in it begin and end."""

    tag: str
    attrs: dict[str, str]
    up: Element | None
    begin: int
    first: int
    at: int = -1
    end: int = -1
    last: int = -1
    stop: int = -1
    kids: list[Element] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)
    rank: int = 0
    nth: int = 1

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def above(self) -> Iterator[Element]:
        x = self.up
        while x is not None:
            yield x
            x = x.up

    def behind(self) -> Element | None:
        return next(iter(self.up.kids[self.rank + 1 : self.rank + 2]), None) if self.up else None


class Page(HTMLParser):
    """The elements of a page in document order."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.html = html or ""
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        self.root = Element("", {}, None, 0, 0)
        self.now, self.all, self.open = self.root, [], Counter()
        self.pieces: list[tuple[str, bool]] = []
        self.unread = 0
        self.feed(self.html)
        self.close()
        while self.now is not self.root:
            self._shut(len(self.html))
        self.root.end, self.root.last, self.root.stop = len(self.html), len(self.pieces), len(self.all)
        if not any(x.tag == "body" for x in self.all):
            self.root.tag = "body"  # a page without one is all body

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, end: int) -> None:
        self.now.end, self.now.last, self.now.stop = end, len(self.pieces), len(self.all)
        self.unread -= self.now.tag in _UNREAD
        self.open[self.now.tag] -= 1
        self.now = self.now.up

    def _shut_to(self, tag: str, end: int, inner_end: int) -> None:
        if self.open[tag]:
            while self.now.tag != tag:
                self._shut(inner_end)
            self._shut(end)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._place()
        if tag in CLOSES_P:
            self._shut_to("p", at, at)
        if self.now.tag == tag and tag in ("li", "td", "th", "tr"):
            self._shut(at)
        self.now.tags[tag] += 1
        own = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now, at, len(self.pieces), len(self.all), rank=len(self.now.kids), nth=self.now.tags[tag])
        self.now.kids.append(own)
        self.all.append(own)
        if tag in VOID:
            own.end, own.last, own.stop = at + len(self.get_starttag_text() or ""), len(self.pieces), len(self.all)
        else:
            self.now = own
            self.open[tag] += 1
            self.unread += tag in _UNREAD

    def handle_endtag(self, tag: str) -> None:
        at = self._place()
        closes = self.html.find(">", at)
        self._shut_to(tag, closes + 1 if closes >= 0 else len(self.html), at)

    def handle_data(self, data: str) -> None:
        if self.now.tag != "title":
            self.pieces.append((data, self.unread > 0))

    def whole(self, x: Element) -> str:
        """All text of an element."""
        return _flat("".join(p for p, _ in self.pieces[x.first : x.last]))

    def raw(self, x: Element) -> str:
        """Its text without scripts and styles, as it stands."""
        return "".join(p for p, unread in self.pieces[x.first : x.last] if not unread)

    def told(self, x: Element) -> str:
        """What an element is judged by: its text, of a mere heading with that of the block behind it."""
        own = _flat(self.raw(x))
        after = self.whole(x.behind()) if is_heading(own) and x.behind() else ""
        return _flat(f"{own}\n{after}") if len(after) >= BEHIND else own

    def source(self, x: Element) -> str:
        return self.html[x.begin : x.end]

    def inside(self, x: Element) -> list[Element]:
        return self.all[x.at + 1 : x.stop]

    def find_all(self, selector: str) -> Iterator[Element]:
        """Elements of a selector: tags, ids, classes, attributes, places, inside (blank) or right inside (>) another."""
        steps = _steps(selector)
        return (x for x in ([self.root, *self.all] if self.root.tag else self.all) if _matches(x, steps))

    def find(self, selector: str | None) -> Element | None:
        return next(self.find_all(selector), None) if selector else None

    def selector_of(self, x: Element) -> str | None:
        """A selector that finds the element: by its id, its role, or its way down from an id or the body."""
        if own := x.attrs.get("id", "").strip():
            return "#" + _escaped(own)
        if role := x.attrs.get("data-cprole", "").strip():
            return "[data-cprole='" + role.replace("'", "\\'") + "']"
        way: list[str] = []
        for y in (x, *x.above()):
            if len(way) == 8 or (way and y.tag in ("body", "html", "")):
                break
            if own := y.attrs.get("id", "").strip():
                way.insert(0, "#" + _escaped(own))
                break
            way.insert(0, f"{y.tag}.{_escaped(y.classes[0])}" if y.classes else f"{y.tag}:nth-of-type({y.nth})")
        selector = " > ".join(way)
        return selector if self.find(selector) is x else None


def _escaped(name: str) -> str:
    return re.sub(r"([^\w-])", r"\\\1", name)


@lru_cache(maxsize=10_000)
def _steps(selector: str) -> tuple:
    """Parts of a selector: > or (id, class, attribute, value, place, tag) of what one element must have."""
    parts = [s for s in re.split(r"\s*(>)\s*|(?<!\\)\s+(?![^\[]*\])", selector.strip()) if s]
    plain = lambda m: tuple(re.sub(r"\\(.)", r"\1", g) if g else None for g in m.groups())
    return tuple(p if p == ">" else tuple(map(plain, _COMPOUND.finditer(p))) for p in parts)


def _is(x: Element, compound: tuple) -> bool:
    for own, cls, attr, value, nth, tag in compound:
        if (own and x.attrs.get("id", "").strip() != own) or (cls and cls not in x.classes) or (tag and x.tag != tag.lower()) or (attr and x.attrs.get(attr) != value) or (nth and x.nth != int(nth)):
            return False
    return True


def _matches(x: Element, steps: tuple) -> bool:
    if not steps or not _is(x, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        return x.up is not None and _matches(x.up, rest[:-1])
    return any(_matches(y, rest) for y in x.above())


def is_heading(text: str) -> bool:
    """Whether a block looks like a mere heading: empty, or short and like a menu or breadcrumbs."""
    return not text or (len(text) < HEADING and bool(_TRAIL.search(text) or _SERVICES.search(text)))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_SPOT = {"selector": T.StringType(), "chars": T.IntegerType(), "place": T.IntegerType()}


@F.pandas_udf(T.ArrayType(_struct(**_SPOT, up=_struct(**_SPOT), aside=_struct(**_SPOT))))
def titled_blocks(html: pd.Series, needle: pd.Series) -> pd.Series:
    """Blocks that may be a page's content: selector, length and place of the needle, of the block, of what it is
    in and of what stands beside that; null without a needle."""

    def spot(selector: str | None, text: str, word: str) -> dict | None:
        return {"selector": selector, "chars": len(text), "place": text.lower().find(word)} if selector else None

    def of(h: str | None, word: str | None) -> list | None:
        if not word:
            return None
        page, out = Page(h), []
        for x in page.all:
            if not ("id" in x.attrs or "data-cprole" in x.attrs or x.tag in ("main", "article", "section")):
                continue
            own = spot(page.selector_of(x), page.told(x), word)
            if own is None or own["place"] < 0:
                continue
            up = x.up if x.up.tag else None
            aside = up.behind() if up else None
            out.append({**own, "up": spot(page.selector_of(up), page.whole(up), word) if up else None, "aside": spot(page.selector_of(aside), page.whole(aside), word) if aside else None})
        return out

    return pd.Series([of(h, w) for h, w in zip(html, needle, strict=True)], dtype=object)


def _words(text: str) -> set[str]:
    return {w for w in text.lower().split() if len(w) > 3}


_PAIR = _struct(selector=T.StringType(), home=T.IntegerType(), page=T.IntegerType(), alike=T.DoubleType(), home_place=T.IntegerType(), place=T.IntegerType())


@F.pandas_udf(_struct(first=T.StringType(), blocks=T.ArrayType(_PAIR)))
def compared_blocks(home: pd.Series, html: pd.Series, first: pd.Series, needle: pd.Series) -> pd.DataFrame:
    """A selector as it is given; and of it and those of CONTENTS, if both pages have it, lengths, likeness (Jaccard,
    of words of four characters or more) and places of the needle, null without a selector or a main page."""

    def of(a: str | None, b: str | None, selector: str | None, word: str | None) -> list | None:
        if not selector or a is None:
            return None
        there, here, out = Page(a), Page(b), []
        for s in (selector, *CONTENTS):
            x, y = there.find(s), here.find(s)
            if x and y:
                t, u = there.told(x), here.told(y)
                one, two = _words(t), _words(u)
                alike = len(one & two) / len(one | two) if one and two else 0.0
                out.append({"selector": s, "home": len(t), "page": len(u), "alike": alike, "home_place": t.lower().find(word or ""), "place": u.lower().find(word or "")})
        return out

    return pd.DataFrame({"first": first, "blocks": pd.Series([of(*row) for row in zip(home, html, first, needle, strict=True)], dtype=object)})


@F.pandas_udf(T.StringType())
def quick_selector(html: pd.Series) -> pd.Series:
    """The first telling selector with enough text, else article if there is just one."""

    def of(h: str | None) -> str | None:
        page = Page(h)
        for s in QUICK:
            x = page.find(s)
            if x and len(page.whole(x)) >= QUICK_CHARS:
                return s
        articles = list(page.find_all("article"))
        return "article" if len(articles) == 1 and len(page.whole(articles[0])) >= QUICK_CHARS else None

    return html.map(of)


@F.pandas_udf(T.StringType())
def block_source(html: pd.Series, selector: pd.Series) -> pd.Series:
    """Source of a selector's first element, of a mere heading with the block behind it; null if there is none."""

    def of(h: str | None, s: str | None) -> str | None:
        page = Page(h)
        x = page.find(s)
        if x is None:
            return None
        after = x.behind() if is_heading(page.whole(x)) else None
        return page.source(x) + ("\n" + page.source(after) if after and len(page.whole(after)) >= BEHIND else "")

    return pd.Series([of(h, s) for h, s in zip(html, selector, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def without_zones(html: pd.Series, header: pd.Series, footer: pd.Series) -> pd.Series:
    """Source without the first element of either selector."""

    def of(h: str | None, *selectors: str | None) -> str | None:
        for s in selectors:
            x = Page(h).find(s) if h and s else None
            h = h[: x.begin] + h[x.end :] if x else h
        return h

    return pd.Series([of(*row) for row in zip(html, header, footer, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def side_menus(html: pd.Series) -> pd.Series:
    """Sources of the menus that are not in a header or footer and not named as a main one."""

    def of(h: str | None) -> str:
        page = Page(h)
        own = (x for x in page.find_all("nav") if not any(y.tag in ("header", "footer") for y in x.above()) and not _PRIMARY.search(f"{x.attrs.get('id', '')} {x.attrs.get('class', '')}"))
        return "\n".join(map(page.source, own))

    return html.map(of)


#: Blocks of a section's text.
_PARTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "header")
#: How a section's own content is named, the classes of items and titles, and the sign of a section's number.
CONTENT_ID, ITEM, TITLE = "_content", "litem", "contentTitle"
_SECTION = re.compile(r"§\s*(\d+-\d+)")
#: Content stands for its section if it has so many characters and lines, each of so many characters; if it has
#: an item by letter; and if a line begins as a section or item does, or it holds the words that one site begins with.
CHARS, LINES, LINE = 200, 5, 10
_LETTERED = re.compile(r"[A-Z]\.\s+")
_BEGINS = re.compile(r"(?m)^(§\s*\d+-\d+|[A-Z]\.)")
OPENING = "Surface and subsurface water"


def _stands_alone(text: str) -> bool:
    """Whether a content element has enough in it to be all of its section."""
    lines = [line for line in map(str.strip, text.split("\n")) if len(line) > LINE]
    return len(text) > CHARS and len(lines) >= LINES and bool(_LETTERED.search(text)) and (OPENING in text or bool(_BEGINS.search(text)))


def _number(page: Page, x: Element) -> str | None:
    found = _SECTION.search(page.raw(x))
    return found[1] if found else None


def _items(page: Page, head: Element, number: str | None) -> Iterator[Element]:
    """Items behind a heading up to the title of another section; an item whose link names another section isn't its own."""
    for x in itertools.islice(page.all, head.at + 1, None):
        names = x.attrs.get("class", "")
        if TITLE in names and _number(page, x) not in (None, number):
            return
        if ITEM in names:
            link = next((y for y in page.inside(x) if y.tag == "a"), None)
            told = link.attrs.get("alt") if link is not None else None
            if not told or not number or told.startswith(number):
                yield x


def _section(page: Page, anchor: str) -> list[Element] | None:
    """Elements that a section is made of: its heading with its content, or with the items that follow; null if it can't be
    told from the page: there is no such heading, or it has a content element on a page without any items."""
    by_id = {}
    for x in page.all:
        by_id.setdefault(x.attrs.get("id"), x)
    head, content = by_id.get(anchor), by_id.get(anchor + CONTENT_ID)
    if head is None or (content is not None and all(ITEM not in x.classes for x in page.all)):
        return None
    if content is not None and _stands_alone(page.raw(content).strip()):
        return [head, content]
    return [head, *_items(page, head, _number(page, head))]


def _parts(page: Page, roots: list[Element]) -> Iterator[str]:
    def within(x: Element, tag: str, cls: str) -> str:
        return _flat(next((page.raw(y) for y in page.inside(x) if cls in y.classes and tag in ("", y.tag)), ""))

    for root in roots:
        for x in page.all if root is page.root else [root, *page.inside(root)]:
            para, definition = x.tag == "div" and "para" in x.classes, x.tag == "section" and "definition" in x.classes
            if not (x.tag in _PARTS or para or definition) or not (text := _flat(page.raw(x))):
                continue
            if x.tag[0] == "h" and x.tag != "header":
                text = f"\n{text}\n"
            elif x.tag == "li":
                text = f"- {text}"
            elif definition and (term := within(x, "dfn", "term")) and (told := within(x, "", "deftext")):
                text = f"{term}: {told}"
            elif para and (item := next((y for y in (x, *x.above()) if "litem" in y.classes), None)) and (letter := within(item, "a", "litem_number")):
                text = f"{letter} {text}"
            yield text


@F.pandas_udf(_struct(text=T.StringType(), found=T.BooleanType()))
def section_text(html: pd.Series, anchor: pd.Series) -> pd.DataFrame:
    """Text of a page's section by blocks, else of all the page, and whether the section was found."""
    rows = []
    for h, a in zip(html, anchor, strict=True):
        page = Page(h)
        roots = _section(page, a) if a else None
        own = roots or [page.root]
        text = "\n\n".join(_parts(page, own)).strip() or "".join(map(page.raw, own))
        rows.append((text, roots is not None))
    return pd.DataFrame(rows, columns=["text", "found"])
