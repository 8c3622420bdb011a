"""Numbers, titles and title needles of statutes, as columns."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions.html import once
from quorumlake.functions.titles import entities

#: Forms of a description, and of a full title, that begin with a number and go on with a title.
DESCRIPTIONS = (
    r"^(§\s*[\d-]+[A-Z]*)\s*(?:\[[^\]]+\])?\s*([^;.]+)(?:[;.]|$)",
    r"^(§\s*[\d-]+[A-Z]*)\s+([A-Z][a-z\s]+?)(?:[;.]|$)",
    r"^(§\s*[\d-]+[A-Z]*)\s*[-–—]\s*([^.;]+)(?:[;.]|$)",
    r"^(Ch\s*[\d-]+[A-Z]*)\s*(?:\[[^\]]+\])?\s*([A-Z][^;.]*?)(?:[;.]|$)",
    r"^(Ch\s*[\d-]+[A-Z]*)\s+([A-Z][a-z\s]+?)(?:[;.]|$)",
    r"^(Chapter\s*[\d-]+[A-Z]*)\s*(?:\[[^\]]+\])?\s*([A-Z][^;.]*?)(?:[;.]|$)",
)
FULL_TITLES = (r"^(§\s*[\d-]+[A-Z]*):?\s*(.+)", r"^([\d-]+[A-Z]*)\s*[-–—]\s*(.+)", r"(?i)^Section\s+([\d-]+[A-Z]*)\s*[-–—]?\s*(.+)")
#: Characters of the shortest and the longest title taken from a description, and of the longest at all.
SHORTEST, LONG, LONGEST = 3, 50, 100
#: Fixed value: characters of the shortest needle.
NEEDLE = 4


def _plain(x: Column) -> Column:
    """Entities as their characters, no-break spaces as blanks, none of these at the ends."""
    return F.regexp_replace(F.replace(entities(x), F.lit("\u00a0"), F.lit(" ")), r"^\s+|\s+$", "")


def _attribute(tag: Column, name: str) -> Column:
    return _plain(F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")), F.lit("")))


def _inner(html: Column, cls: str) -> Column:
    """Text of the first element of a class, up to its own closing tag: elements of its kind may stand in it."""
    begin = rf"(?is)<(\w+)\b[^>]*\bclass=[\"'](?:[^\"']*\s)?{cls}(?:\s[^\"']*)?[\"'][^>]*>"
    # pieces begin with a tag of the kind, but the first may not; the element ends where as many have closed as opened
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))

    def inside(found: Column) -> Column:
        begins = lambda p, how: F.rlike(p, F.concat(F.lit(f"(?i)^{how}"), found["tag"], F.lit(r"[\s/>]")))
        pieces = F.split(found["rest"], F.concat(F.lit("(?i)(?=</?"), found["tag"], F.lit(r"[\s/>])")))
        turns = F.transform(pieces, lambda p: F.when(begins(p, "</"), -1).when(begins(p, "<"), 1).otherwise(0))
        step = lambda s, t: F.when(s["open"] == 0, s).otherwise(F.struct((s["open"] + t).alias("open"), (s["n"] + 1).alias("n")))
        return once(F.struct(pieces.alias("pieces"), F.aggregate(turns, start, step).alias("end")), lambda x: F.array_join(F.slice(x["pieces"], F.lit(1), F.when(x["end"]["open"] == 0, x["end"]["n"] - 1).otherwise(x["end"]["n"])), ""))

    found = F.struct(F.regexp_extract(html, begin, 1).alias("tag"), F.regexp_extract(html, begin + "(.*)$", 2).alias("rest"))
    return _plain(F.regexp_replace(once(found, lambda x: F.when(x["tag"] == "", "").otherwise(inside(x))), "<[^>]*>", ""))


def _first(x: Column, patterns: Collection[str], group: int) -> Column:
    return F.coalesce(*(F.when(x.rlike(p), F.regexp_replace(F.regexp_extract(x, p, group), r"^\s+|\s+$", "")) for p in patterns), F.lit(""))


def number_and_title(html: Column) -> Column:
    """Struct of a statute's number and title, null where there is none.

    They come from the page's description; then, if one of them is missing or the title has an odd length, from elements
    of class titleNumber and titleTitle; then, if one is missing still, from a data-full-title.
    """
    html = F.coalesce(html, F.lit(""))
    parts = F.struct(
        _attribute(F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bproperty=[\"']og:description[\"'][^>]*>)", 1), "content").alias("told"), _inner(html, "titleNumber").alias("shown"), _inner(html, "titleTitle").alias("name"),
        _attribute(F.regexp_extract(html, r"(?is)(<[^>]*\sdata-full-title=[^>]*>)", 1), "data-full-title").alias("full"),
    )
    return once(parts, _number_and_title)


def _number_and_title(x: Column) -> Column:
    told, shown = x["told"], x["shown"]
    number, title = _first(told, DESCRIPTIONS, 1), _first(told, DESCRIPTIONS, 2)

    odd = (number == "") | ~F.length(title).between(SHORTEST, LONG) | (title == "N/A")
    name = F.regexp_replace(F.regexp_replace(x["name"], r"\s+", " "), r"\.$", "")
    for kind in ("Article", "Chapter", "Section"):
        name = F.regexp_replace(name, rf"(?i)^{kind}\s+\d+\s*[-–—]?\s*", "")
    number, title = F.when(odd & shown.rlike("§|Ch"), shown).otherwise(number), F.when(odd & (x["name"] != ""), F.trim(name)).otherwise(title)

    other = _first(x["full"], FULL_TITLES, 1)
    other = F.when((other == "") | F.contains(other, F.lit("§")), other).otherwise(F.concat(F.lit("§ "), other))
    number, title = F.coalesce(F.nullif(number, F.lit("")), other), F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(_first(x["full"], FULL_TITLES, 2), "[.;]$", ""))

    number = F.trim(F.regexp_replace(number, r"^([^§]*)§\s*", "$1§ "))
    title = F.when(F.length(title) <= LONGEST, F.trim(F.regexp_replace(title, r"[\n\t\r]+", " "))).otherwise("")
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.nullif(title, F.lit("")).alias("title"))


def any_of(conditions: Collection[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def _is_state(x: Column, codes: Collection[str], names: Collection[str]) -> Column:
    return F.upper(F.replace(x, F.lit("."), F.lit(""))).isin(*codes) | F.lower(_spaced(x)).isin(*names)


#: How parts of a title are parted, and how a place, and a place at the end, name their state.
_BARS = r"\s\|\s|\s-\s|,\s"
_PLACE = r"^[A-Za-z .'-]+,\s*([A-Za-z .'-]{2,})$"
_AT_END = r",\s*([A-Za-z. ]{2,})$"


def _locality(part: Column, name: Column, kind: Column, state: Column, codes: Collection[str], names: Collection[str]) -> Column:
    """Whether a part of a title says where and not what."""
    low, name, kind, state = F.lower(part), F.lower(_spaced(name)), F.lower(_spaced(kind)), F.lower(_spaced(state))
    has = lambda x: (x != "") & F.contains(low, x)
    in_state = [F.contains(low, F.concat(F.lit(", "), state)), *(F.endswith(low, F.concat(F.lit(" "), x)) for x in (state, F.replace(state, F.lit("."), F.lit(""))))]
    conditions = (
        (name != "") & (low == name),  # the entity itself
        has(name) & has(kind),  # with its kind
        has(name) & (state != "") & any_of(in_state),  # with its state
        _is_state(part, codes, names),  # a state
        _is_state(F.regexp_extract(part, _PLACE, 1), codes, names),  # any place of a state
    )
    return any_of(conditions)


def title_needle(title: Column, name: Column, kind: Column, state: Column, states: dict[str, str]) -> Column:
    """What of a title to look for in a text: its first part that isn't a locality, without a state at its end.

    Parts stand between bars, dashes or commas and have four letters or more; without any the whole title counts.
    states: codes by lower-case names.
    """
    codes, names = [c.upper() for c in states.values()], list(states)
    whole = _spaced(title)
    parts = F.filter(F.transform(F.split(whole, _BARS), lambda p: F.trim(p)), lambda p: F.length(p) >= NEEDLE)
    telling = F.get(F.filter(parts, lambda p: ~_locality(p, name, kind, state, codes, names)), 0)
    best = F.coalesce(telling, F.get(parts, 0), whole)
    at_end = F.regexp_extract(best, _AT_END, 1)
    pruned = F.when(_is_state(at_end, codes, names), F.trim(F.regexp_replace(best, _AT_END, ""))).otherwise(best)
    return F.when(F.length(pruned) >= NEEDLE, F.lower(pruned))
