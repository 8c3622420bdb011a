"""Durations and ages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400


def seconds_of(text: Column) -> Column:
    """Seconds of "15m", "2h" or "1d"; null for anything else."""
    n = F.nullif(F.regexp_extract(text, r"^(\d+)[mhd]$", 1), F.lit("")).try_cast("long")
    return n * F.when(text.endswith("m"), MINUTE).when(text.endswith("h"), HOUR).otherwise(DAY)


def age_text(seconds: Column) -> Column:
    """Whole days, else hours, else minutes."""
    part = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(name))
    return F.when(seconds >= DAY, part(DAY, "d ago")).when(seconds >= HOUR, part(HOUR, "h ago")).otherwise(part(MINUTE, "m ago"))


def fresh(ts: Column, as_of: Column, seconds: Column) -> Column:
    """Younger than so many seconds; a duration that can't be read makes nothing fresh."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(age < seconds * 1_000_000, F.lit(False))
