"""Rounding, score ranges, colours and formats as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of colours and the hex codes they stand for.
COLOURS = {"green": "#22c55e", "yellow": "#eab308", "orange": "#f97316", "red": "#d21404", "blue": "#3b82f6", "purple": "#8b5cf6", "gray": "#94a3b8"}
#: The ends of the green gradient.
DARK, LIGHT = (34, 197, 94), (187, 247, 208)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    factor = float(10**digits)
    return F.floor(x * factor + 0.5) / F.lit(factor)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normal_confidence(x: Column) -> Column:
    """A confidence above 1 is a percentage."""
    return F.when(x > 1, x / 100).otherwise(x)


def threshold(text: Column) -> Column:
    """H33: "20%", "20" and "0.2" are all 0.2; what isn't a number is null."""
    number = F.regexp_replace(F.trim(text), "%$", "").try_cast("double")
    return F.when(text.contains("%") | (number > 1), number / 100).otherwise(number)


def _bound(token: str) -> float:
    """Tokens with a leading zero are decimals: 05 is 0.5."""
    token = token.strip()
    return float("0." + token[1:]) if token.isdigit() and len(token) > 1 and token[0] == "0" else float(token)


def in_range(value: Column, label: str) -> Column:
    """Whether a value lies in a range written as >=a, >a, <=a, <a or a-b (both ends inside)."""
    label = label.strip()
    for sign, test in ((">=", value.__ge__), (">", value.__gt__), ("<=", value.__le__), ("<", value.__lt__)):
        if label.startswith(sign):
            return test(_bound(label[len(sign) :]))
    low, dash, high = label.partition("-")
    if not dash or not low:
        return F.lit(False)
    return (value >= _bound(low)) & (value <= _bound(high))


def colour_of(value: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """Colour of the first range that holds the value, null if none does."""
    out = F.lit(None).cast("string")
    for label, colour in reversed(mapping):
        out = F.when(in_range(value, label), F.lit(COLOURS.get(colour.lower(), colour))).otherwise(out)
    return out


def _shade(score: Column, i: int) -> Column:
    return F.floor(F.lit(float(LIGHT[i])) + clamp(score) * float(DARK[i] - LIGHT[i]) + 0.5).cast("int")


def green_hex(score: Column) -> Column:
    """Green that darkens with the score, as #rrggbb."""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(_shade(score, i))), 2, "0") for i in range(3)))


def green_rgb(score: Column) -> Column:
    return F.format_string("rgb(%d, %d, %d)", *(_shade(score, i) for i in range(3)))


def band(score: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """Low, medium or high by two thresholds."""
    return F.when(score < low, "low").when(score < high, "medium").otherwise("high")


def percent_text(x: Column) -> Column:
    """A share as a whole percentage."""
    return F.concat(half_up(x * 100).cast("long").cast("string"), F.lit("%"))
