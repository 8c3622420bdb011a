"""Sources of rulesets: arrays of structs (source_url, title, type)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.urls import source_form

#: Types that stand for a statute.
ALIASES = {"statute": ("statute", "ordinance", "code"), "policy": ("policy",)}


def _of_type(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["type"] == kind


def primary_source(sources: Column, kind: str) -> Column:
    """The first source of the kind, or of a name that stands for it, in that order."""
    found = [F.try_element_at(F.filter(sources, _of_type(k)), F.lit(1)) for k in ALIASES.get(kind, (kind,))]
    return F.coalesce(*found)


def link(links: Column, kind: str, flat: Column) -> Column:
    """Url of the first link of a type, else the flat field."""
    return F.coalesce(F.nullif(F.try_element_at(F.filter(links, lambda x: x["type"] == kind), F.lit(1))["url"], F.lit("")), flat)


def upserted(sources: Column, new: Column) -> Column:
    """A source of the same address is replaced in its place, a new one is put before the others."""
    same = lambda s: source_form(s["source_url"]) == source_form(new["source_url"])
    return F.when(F.exists(sources, same), F.transform(sources, lambda s: F.when(same(s), new).otherwise(s))).otherwise(F.concat(F.array(new), sources))


def without_types(rulesets: DataFrame, types: Sequence[str]) -> DataFrame:
    """Sources of these types go; how many is told."""
    kept = F.filter("sources", lambda s: ~s["type"].isin(*types))
    return rulesets.withColumn("n_removed", F.size("sources") - F.size(kept)).withColumn("sources", kept)


def inferred_type(url: Column, title: Column) -> Column:
    """B30."""
    text = F.lower(F.concat_ws(" ", url, title))
    return F.when(F.lower(url).endswith(".pdf") | text.rlike("form|permit|application"), "form").otherwise("general")
