"""Sheets of grades: a row an entity, a column a domain; how cells are read is the caller's to say."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text, urls
from quorumlake.operators.rules import grade_of


class SheetParser(Protocol):
    """What a realm's sheets need to be read.  Methods make columns of columns, so any parser is planned by Spark."""

    prefix: str
    state: str
    #: Place of each domain's column among the cells, from 0.
    columns: Mapping[str, int]

    def name(self, cell: Column) -> Column:
        """Name of the entity of a cell, null if there is none."""
        ...

    def grade(self, cell: Column) -> Column:
        """Grade that a cell begins with, null if it begins with none."""
        ...


@dataclass(frozen=True)
class GradeSheet:
    """Names with their kind in brackets (H08), grades by their codes."""

    columns: Mapping[str, int]
    codes: Mapping[str, str]
    prefix: str = "NY-"
    state: str = "NY"

    def name(self, cell: Column) -> Column:
        return text.name_part(cell)

    def grade(self, cell: Column) -> Column:
        return grade_of(F.trim(cell), dict(self.codes))


@dataclass(frozen=True)
class PlainSheet:
    """Names as slugs, and yes or no for a grade."""

    columns: Mapping[str, int]
    prefix: str = ""
    state: str = ""
    words: Mapping[str, str] = field(default_factory=lambda: {"yes": "Good", "no": "Red"})

    def name(self, cell: Column) -> Column:
        return F.when(F.trim(cell) != "", urls.slug(cell))

    def grade(self, cell: Column) -> Column:
        low, out = F.lower(F.trim(cell)), F.lit(None).cast("string")
        for word, grade in self.words.items():
            out = F.when(low == word, grade).otherwise(out)
        return out


def grades(rows: DataFrame, parser: SheetParser, name_column: int = 0) -> DataFrame:
    """entity_id, state, domain_id, grade of each row and domain of a sheet whose cell has a grade.

    rows: row_id, cells (an array of texts).  A row without a name is left out; a cell that the row doesn't have is blank.
    Of rows of one entity the last by row_id counts for each domain, as later lines of a sheet amend earlier ones.
    """
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    told = F.array(*(F.struct(F.lit(d).alias("domain_id"), parser.grade(cell(i)).alias("grade")) for d, i in sorted(parser.columns.items())))
    named = rows.select("row_id", parser.name(cell(name_column)).alias("name"), F.explode(told).alias("x")).where("name IS NOT NULL AND x.grade IS NOT NULL")
    keyed = named.select("row_id", F.concat(F.lit(parser.prefix), "name").alias("entity_id"), "x.domain_id", "x.grade")
    last = keyed.groupBy("entity_id", "domain_id").agg(F.max_by("grade", "row_id").alias("grade"))
    return last.select("entity_id", F.lit(parser.state).alias("state"), "domain_id", "grade")
