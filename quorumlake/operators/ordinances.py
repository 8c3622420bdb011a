"""Search and counts over ordinances: state, county, city, source_jurisdiction_type, header, content, is_substantive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import keyword_pattern
from quorumlake.operators.keyword_hits import keyword_hits

#: Names of states and their abbreviations.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL",
    "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC",
}


@dataclass(frozen=True)
class Search:
    """What to look for; words may match at their beginning (default) or whole, any of them or all."""

    state: str | None = None
    county: str | None = None
    city: str | None = None
    kind: str | None = None
    words: Sequence[str] = ()
    match_all: bool = False
    whole: bool = False
    substantive: bool = True

    def condition(self) -> Column:
        """One predicate; the comparisons with literals reach the scan."""
        out = F.col("is_substantive") if self.substantive else F.lit(True)
        if self.state:
            low = self.state.strip().lower()
            variants = {low, STATES.get(low, low).lower(), *(n for n, a in STATES.items() if a.lower() == low)}
            out &= F.upper("state").isin(*sorted(v.upper() for v in variants))
        for column, value in (("county", self.county), ("city", self.city), ("source_jurisdiction_type", self.kind)):
            if value:
                out &= F.contains(F.lower(column), F.lit(value.lower()))
        tests = [F.col("header").rlike(p := keyword_pattern([w], self.whole)) | F.col("content").rlike(p) for w in self.words]
        if tests:
            every = tests[0]
            for x in tests[1:]:
                every = every & x if self.match_all else every | x
            out &= every
        return out


def search(ordinances: DataFrame, what: Search, limit: int | None = None, key: str = "doc_id") -> DataFrame:
    """Matching rows, the first of them by key if limited, so a limit gives the same rows each time."""
    found = ordinances.where(what.condition())
    return found.orderBy(key).limit(limit) if limit else found


def count(ordinances: DataFrame, what: Search) -> DataFrame:
    """D14."""
    return ordinances.where(what.condition()).agg(F.count("*").alias("n"))


def variants(state: Column) -> Column:
    """A state's name and its abbreviation, in capitals."""
    other = {n.upper(): a for n, a in STATES.items()} | {a: n.upper() for n, a in STATES.items()}
    up = F.upper(F.trim(state))
    return F.array_compact(F.array(up, F.try_element_at(F.create_map(*(F.lit(x) for pair in other.items() for x in pair)), up)))


def places_of(entities: DataFrame, places: DataFrame) -> DataFrame:
    """entity_id, s, c: the places (s, c: state in capitals, city in lower case) of each entity, as a search finds them (B07):
    a state by any of its names, a city that the entity's is a part of.  Cities meet by one automaton, then on equality."""
    wanted = entities.where(F.length("city") > 0).select("entity_id", F.explode(variants(F.col("state"))).alias("s"), F.lower("city").alias("part"))
    cities = places.where("c IS NOT NULL").select("c").distinct()
    parts = keyword_hits(cities.withColumn("text", F.col("c")), "c", ["text"], wanted.select(F.col("part").alias("keyword"))).select("c", F.col("keyword").alias("part"))
    return wanted.join(parts, "part").select("entity_id", "s", "c").distinct()


def counts_for_entities(entities: DataFrame, ordinances: DataFrame, what: Search) -> DataFrame:
    """Matches of each entity's place, 0 where there are none; entity_id is unique.

    One query counts for all entities: ordinances are counted by state and city first, and those few rows are joined to
    the entities whose place they are, by the same tests that a search for one of them has.
    """
    per_place = ordinances.where(what.condition()).groupBy(F.upper("state").alias("s"), F.lower("city").alias("c")).agg(F.count("*").alias("n"))
    counts = places_of(entities, per_place).join(per_place, ["s", "c"]).groupBy("entity_id").agg(F.sum("n").alias("n"))
    return entities.join(counts, "entity_id", "left").select(*entities.columns, F.coalesce("n", F.lit(0)).alias("n"))


def synthetic_url(state: Column, county: Column, city: Column, header: Column, content: Column) -> Column:
    """An address made of the place and a digest of the text."""
    part = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("na"))
    return F.concat(F.lit("locus://"), part(state), F.lit("/"), part(county), F.lit("/"), part(city), F.lit("/"), F.substring(F.sha2(F.concat(header, content), 256), 1, 16))
