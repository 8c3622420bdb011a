"""Addresses as columns: forms to store and to match, hosts, and which to skip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: parts of addresses that are never followed.
SKIP = r"(calendar|account|login|directory|mailto|instagra|search|profile|contact|png|jpg|jpeg|gif|bmp|svg|webp)"


def normalized(url: Column) -> Column:
    """Trimmed, with https:// where there is no scheme; blank is null."""
    trimmed = F.trim(url)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(None)).when(trimmed.rlike("(?i)^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def hostname(url: Column) -> Column:
    """Lower-case host without port, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.lit(1), F.size(F.split(host, r"\.")) - 1), 2), ".")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_folder(url: Column) -> Column:
    """The first part of the path that isn't empty."""
    return F.regexp_extract(path(url), r"^/*([^/]*)", 1)


def match_form(url: Column) -> Column:
    """Without query and fragment, host in lower case, no slash at the end of a longer path."""
    full = normalized(url)
    place = F.regexp_replace(path(full), "/+$", "")
    scheme = F.lower(F.regexp_extract(full, "^([^:/?#]+)://", 1))
    return F.when(full.isNotNull(), F.concat(scheme, F.lit("://"), hostname(full), F.when(place == "", F.lit("/")).otherwise(place)))


def source_form(url: Column) -> Column:
    """Without fragment and without slashes at the end; the query stays."""
    return F.regexp_replace(F.regexp_replace(normalized(url), "#.*$", ""), "/+$", "")


def skipped(url: Column) -> Column:
    """B14."""
    return F.coalesce(url.rlike("(?i)" + SKIP), F.lit(False))


def language_folder(url: Column) -> Column:
    """Two letters (a region may follow) as the first folder of the path."""
    return F.lower(F.regexp_extract(first_folder(url), r"(?i)^([a-z]{2})(?:-[a-z]{2})?$", 1))


def slug(text: Column, default: str = "source") -> Column:
    """Marks off letters, anything else than letters and digits is one dash, 80 characters at most."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(dashed, 1, 80), "-+$", ""), F.lit("")), F.lit(default))


def title_of_slug(text: Column) -> Column:
    """Dashes and underscores become blanks, words begin with a capital."""
    words = F.split(F.trim(F.regexp_replace(text, "[-_]+", " ")), " +")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, 2, 1_000_000))), " ")
