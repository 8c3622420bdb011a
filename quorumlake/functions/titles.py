"""Titles of documents from their pages, records and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions import urls
from quorumlake.functions.html import once

#: Fixed value: characters of a title at most.
LONGEST = 300
#: Entities that are read in titles by their names.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;", "–"), ("&mdash;", "—"), ("&sect;", "§"), ("&copy;", "©"))


def plain(text: Column) -> Column:
    """Without tags; entities are read, white space is one blank."""
    return F.trim(F.regexp_replace(entities(F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", "")), r"[\s\u00a0]+", " "))


def entities(text: Column) -> Column:
    """Entities by number, and by the names of ENTITIES, as their characters."""
    parts = F.split(text, r"(?=&#)")
    number = lambda p: F.when(p.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,6});", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(p, r"^&#(\d{1,7});", 1).try_cast("int"))
    sign = lambda p: F.when(number(p).between(1, 0x10FFFF), F.concat(_character(number(p)), F.regexp_replace(p, r"^&#[xX]?[0-9A-Fa-f]+;", ""))).otherwise(p)
    text = F.array_join(F.transform(parts, sign), "")
    for entity, by in (*ENTITIES, ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def _character(code: Column) -> Column:
    """The character of a code point, through its UTF-8 bytes."""
    two = lambda *x: F.concat(*(F.lpad(F.hex(v.cast("int")), 2, "0") for v in x))
    low = lambda shift: F.shiftright(code, shift).bitwiseAND(63).bitwiseOR(128) if shift else code.bitwiseAND(63).bitwiseOR(128)
    shape = F.when(code < 0x80, two(code)).when(code < 0x800, two(F.shiftright(code, 6).bitwiseOR(0xC0), low(0))).when(code < 0x10000, two(F.shiftright(code, 12).bitwiseOR(0xE0), low(6), low(0)))
    return F.decode(F.unhex(shape.otherwise(two(F.shiftright(code, 18).bitwiseOR(0xF0), low(12), low(6), low(0)))), "UTF-8")


def _meta(html: Column, key: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)(<meta\b[^>]*\b{key}\s*=\s*[\"']{name}[\"'][^>]*>)", 1)
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")), F.lit(""))


def html_title(html: Column) -> Column:
    """Of title, og:title, twitter:title, the first h1 and the first h2 the first that isn't blank, cut; else null."""
    read = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")

    def first(page: Column) -> Column:
        element = lambda tag: F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
        found = [element("title"), _meta(page, "property", "og:title"), _meta(page, "name", "twitter:title"), element("h1"), element("h2")]
        return F.substring(F.coalesce(*(F.nullif(plain(x), F.lit("")) for x in found)), 1, LONGEST)

    return once(read, first)


def slug_title(url: Column) -> Column:
    """The last part of an address' path, else its host, dashes as blanks and words with capitals; empty if it is none."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    bare = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), urls.hostname(url)), "[-_]+", " ")
    # a word begins where a letter or digit follows what is neither
    words = F.regexp_extract_all(bare, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.when(urls.hostname(url) == "", "").otherwise(F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, 2, 1_000_000))).otherwise(w)), ""))


def document_title(cached: Column, given: Column, existing: Column, url: Column) -> Column:
    """The title of a record: of its cached page, of the page that is given, its own if that isn't its address, or of its slug."""
    own = F.nullif(F.trim(existing), F.lit(""))
    return F.coalesce(html_title(cached), html_title(given), F.when(own != url, own), slug_title(url))
