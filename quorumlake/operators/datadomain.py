"""Data domains: cells of a sheet, the types of its columns, and the entities of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import token

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_TRUTH = ("true", "false", "yes", "no", "y", "n")


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, null if it doesn't."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double")


def column_types(cells: DataFrame) -> DataFrame:
    """Boolean if all cells are truth words, number if four fifths begin with one, else string; blanks don't count.

    cells: column, value.
    """
    filled = cells.where(F.trim("value") != "")
    out = filled.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim("value")).isin(*_TRUTH)).alias("t"), F.count(number_prefix(F.col("value"))).alias("k"))
    return out.select("column", "n", F.when(F.col("t") == F.col("n"), "boolean").when(F.col("k") >= 0.8 * F.col("n"), "number").otherwise("string").alias("type"))


def typed_cells(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells as text, number or truth by their column's type.  types is one row a column."""
    joined = cells.join(types.select("column", "type"), "column")
    value = F.nullif(F.trim("value"), F.lit(""))
    return joined.select(
        *cells.columns, "type", F.when(F.col("type") == "number", number_prefix(value)).alias("num"), F.when(F.col("type") == "boolean", F.lower(value).isin("true", "yes", "y")).alias("bool"), F.when(F.col("type") == "string", value).alias("str")
    )


def matched_rows(rows: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    """Entity of each row by name and, where both have one, type; else an id made of the name.

    rows: row_id, name, type; entities: entity_id, name, type.
    """
    known = entities.select(token(F.col("name")).alias("key"), F.col("entity_id").cast("string").alias("found"), F.col("type").alias("known_type"))
    joined = rows.withColumn("key", token(F.col("name"))).join(known, "key", "left")
    agrees = (F.coalesce("type", F.lit("")) == "") | (F.coalesce("known_type", F.lit("")) == "") | (F.lower("type") == F.lower("known_type"))
    best = joined.groupBy("row_id", "key").agg(F.min(F.when(agrees, F.col("found"))).alias("found"))
    return best.select("row_id", F.coalesce("found", F.concat(F.lit(prefix), F.col("key"))).alias("entity_id"))
