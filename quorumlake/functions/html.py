"""Readable text, titles and headings of HTML, in Arrow batches on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions.pieces import by_pieces

#: Elements that are a paragraph of their own, those that end an open paragraph, and those whose text is no content.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th".split())
CLOSES_P = BLOCKS | frozenset("div ul ol dl table section article nav header footer main aside form figure hr address".split())
DROPPED = frozenset("script style noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Collects blocks in order of their opening; a block inside another gives its text to both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.every: list[str] = []
        self.title: list[str] | None = None
        self.dropped = 0

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += 1
            return
        if tag in CLOSES_P and any(t == "p" for t, _ in self.open):
            self._close("p")
        if tag in ("li", "td", "th") and self.open and self.open[-1][0] == tag:
            self._close(tag)
        if tag in VOID:
            return
        own = None
        if tag in BLOCKS:
            own = []
            self.blocks.append((tag, own))
        elif tag == "title" and self.title is None:
            own = self.title = []
        self.open.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        else:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        inside_title = any(t == "title" for t, _ in self.open)
        if not inside_title:
            self.every.append(data)
        for _, own in self.open:
            if own is not None:
                own.append(data)


def read(html: str | None) -> tuple[str, list[tuple[str, str]], str]:
    """Title, blocks as (element, text), and all text, white space collapsed."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    flat = lambda parts: _SPACE.sub(" ", "".join(parts)).strip()
    return flat(reader.title or []), [(t, x) for t, parts in reader.blocks if (x := flat(parts))], flat(reader.every)


def text_of(html: str | None) -> str:
    """Blocks in document order with a blank line between them, list items behind a dash."""
    _, blocks, every = read(html)
    return "\n\n".join(f"- {x}" if t == "li" else x for t, x in blocks) or every


def _parts(html: str | None) -> dict[str, object]:
    title, blocks, every = read(html)
    heads = [x for t, x in blocks if t[0] == "h" and len(x) >= 3][:30]
    return {"title": title or (heads[0] if heads else ""), "headers": heads, "text": "\n\n".join(f"- {x}" if t == "li" else x for t, x in blocks) or every}


def _clean(html: str | None) -> dict[str, object]:
    title, blocks, every = read(html)
    heads = {t: x for t, x in reversed(blocks)}
    return {"title": (title or heads.get("h1") or heads.get("h2") or "")[:100], "text": "\n\n".join(f"- {x}" if t == "li" else x for t, x in blocks) or every}


html_text = by_pieces("string", pa.string(), lambda pages: [text_of(h) for h in pages])
#: Title, up to 30 headings of three characters or more, and the text.
html_parts = by_pieces("struct<title:string,headers:array<string>,text:string>", pa.struct([("title", pa.string()), ("headers", pa.list_(pa.string())), ("text", pa.string())]), lambda pages: [_parts(h) for h in pages])
#: The text, and of the title, else of the first heading of level 1, else of level 2, a hundred characters.
clean_html = by_pieces("struct<title:string,text:string>", pa.struct([("title", pa.string()), ("text", pa.string())]), lambda pages: [_clean(h) for h in pages])


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """A function of x, which is computed once however often the function names it."""
    return F.get(F.transform(F.array(x), of), 0)


def normal_text(text: Column) -> Column:
    """Paragraphs kept, blanks collapsed, merged words split, lines of pure navigation dropped.

    If little is left of a page of substance, its lines all stay.
    """
    for pattern, by in ((r"\n\s*\n", "\n\n"), (r"\t+", "\t"), (r"[ ]+", " "), (r"\n ", "\n"), (r"\n{3,}", "\n\n"), (r"([a-z])([A-Z])", "$1 $2")):
        text = F.regexp_replace(text, pattern, by)
    navigation = r"(?i)^(?:(?:back|next|home|menu|search|login|logout|print|email|share|download|pdf)|[\d\s\-\.]{1,10}|(?:©|®|™|\(c\)).*)$"
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def kept(all_: Column) -> Column:
        lines = F.filter(F.split(all_, "\n"), lambda x: (F.trim(x) == "") | ~F.trim(x).rlike(navigation))
        return once(trimmed(F.array_join(lines, "\n")), lambda some: F.when((F.length(some) < 50) & (F.length(trimmed(all_)) > F.length(some)), trimmed(all_)).otherwise(some))

    return once(text, kept)
