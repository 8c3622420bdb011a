"""Texts as columns: tokens, fingerprints, keywords, snippets, references and facts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of a gap and the category that they stand for.
GAPS = {
    "Higher penalties needed": ("penalty", "fine"),
    "Professional consultation required": ("arborist", "professional"),
    "Mandatory replacement standards": ("replacement", "replant"),
    "Permit process improvements": ("permit", "application"),
    "Neighbor notification requirements": ("notification", "neighbor"),
    "Enforcement mechanisms": ("enforcement", "mechanism"),
}
#: Signs of navigation, and of pages about people.
NAVIGATION = ("quick links", "site links", "categories", "government", "departments", "resident resources", "how do i", "home", "site map", "sign in")
PERSONNEL = ("board members", "staff directory", "commission members", "town board", "planning board", "committee members", "contact")


def estimated_tokens(text: Column) -> Column:
    """A third of the characters, and a part for each punctuation mark and number."""
    marks = F.regexp_count(text, F.lit(r"[§()\[\].,:;]"))
    numbers = F.regexp_count(text, F.lit(r"\d+"))
    return F.ceil(F.ceil(F.length(text) / 3) + marks * 0.1 + numbers * 0.2).cast("long")


def fingerprint(text: Column) -> Column:
    """Without the header line of an artifact, white space as one blank, lower case."""
    body = F.regexp_replace(text, r"^# [^\n]* downloaded at [^\n]*\n+", "")
    return F.lower(F.trim(F.regexp_replace(body, r"[ \t\n\x0B\f\r]+", " ")))


def token(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def identifier(text: Column) -> Column:
    """Words in lower case, joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def long_words(text: Column) -> Column:
    """The set of words of more than three letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """Common members over all members of two sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def keyword_pattern(words: Sequence[str], whole: bool = False) -> str:
    """Words at a word boundary on the left, with whole on both sides."""
    edge = lambda c, at: rf"(?{at}!\w)" if re.match(r"\w", c, re.ASCII) else rf"(?{at}=\w)"  # noqa: E731  \b that counts ASCII letters only
    return "(?i)(?:" + "|".join(edge(w[0], "<") + re.escape(w) + (edge(w[-1], "") if whole else "") for w in words) + ")"


def highlighted(text: Column, words: Sequence[str], whole: bool = False) -> Column:
    """Matches between double asterisks."""
    return F.regexp_replace(text, keyword_pattern(words, whole), "**$0**")


def snippet(text: Column, words: Sequence[str], whole: bool = False) -> Column:
    """150 characters before the first match and 250 after it, or the first 400."""
    found = F.regexp_extract(text, keyword_pattern(words, whole), 0)
    at = F.regexp_instr(text, F.lit(keyword_pattern(words, whole)))
    start = F.greatest(F.lit(0), at - 1 - 150)
    end = F.least(F.length(text), at - 1 + F.length(found) + 250)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= 400, text).when(at == 0, F.concat(F.substring(text, 1, 400), F.lit("..."))).otherwise(cut)


def section_references(text: Column) -> Column:
    """Of the first three references to sections the distinct ones."""
    return F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(r"((?:Section|§)\s*\d+(?:[.-]\d+)*)"), F.lit(1)), 1, 3))


def capital_share(text: Column) -> tuple[Column, Column]:
    """Words of three letters or more, and how many of them begin with a capital or are short all-capitals."""
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1)), lambda w: F.length(w) >= 3)
    capital = F.filter(words, lambda w: w.rlike("^[A-Z][a-z]") | w.rlike("^[A-Z]{2,5}$"))
    return F.size(words), F.size(capital)


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def dense_index(text: Column) -> Column:
    """Many capitals, three signs of navigation, and not mostly about people."""
    low, (words, capital) = F.lower(text), capital_share(text)
    nav, people = hits(low, NAVIGATION), hits(low, PERSONNEL)
    return (words >= 45) & (capital / F.nullif(words, F.lit(0)) >= 0.42) & (nav >= 3) & ~((people >= 3) & (nav < 5))


def gap_categories(text: Column) -> Column:
    """Each category that a keyword of the text stands for, once."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(hits(low, words) > 0, F.lit(name)) for name, words in GAPS.items())))


def least_inches(text: Column) -> Column:
    """Smallest diameter named."""
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(\d+)\s*inch(?:es)?\s*DBH"), F.lit(1)), lambda x: x.cast("int")))


def most_dollars(text: Column) -> Column:
    """Largest amount named."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\$([\d,]+)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("long")))


def replacement_ratio(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+:\d+)", 1), F.lit(""))


def name_part(text: Column) -> Column:
    """What stands before the type in brackets, as one word."""
    bare = F.trim(F.regexp_extract(text, r"^([^(]*)", 1))
    kind = F.regexp_replace(F.regexp_extract(text, r"\(([^)]*)\)", 1), "/.*$", "")
    joined = F.regexp_replace(bare, r"\s+", "")
    return F.when(F.trim(text) == "", F.lit(None)).when(kind == "", joined).otherwise(F.concat(joined, F.lit("-"), kind))


def has_control(text: Column, first: int | None = None) -> Column:
    """Control characters or zero-width ones, in the first characters or anywhere."""
    return F.coalesce((F.substring(text, 1, first) if first else text).rlike("[\\x00-\\x08\\x0E-\\x1F\\u200B-\\u200D\\uFEFF]"), F.lit(False))


def artifact(url: Column, downloaded: Column, converted: Column, body: Column) -> Column:
    """A header line, a blank line, the trimmed body."""
    return F.concat(F.lit("# "), url, F.lit(" downloaded at "), downloaded, F.lit(", converted at "), converted, F.lit("\n\n"), F.trim(body))


def artifact_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^# (\S+) downloaded at ", 1), F.lit(""))


def artifact_body(text: Column) -> Column:
    return F.regexp_replace(text, r"^# [^\n]*\n\n", "")


def csv_field(text: Column) -> Column:
    """Quoted if it holds a quote, a comma or a line feed."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def table_cell(text: Column) -> Column:
    """Fit for a cell of a markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
