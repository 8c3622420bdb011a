"""Token usage over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def micros_of(ts: str) -> Column:
    """Microseconds since 1970, with or without a time zone in the type."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding(events: DataFrame, micros: int = MINUTE, limit: float = 100.0) -> DataFrame:
    """Tokens of each model in the minute up to each request, and the wait until the oldest of them leaves.

    events: model, ts, tokens.  The wait is 0 below the limit and five minutes at most.  A model is one sorted run; its
    frames slide, so memory is that of a minute.
    """
    order = Window.partitionBy("model").orderBy(micros_of("ts")).rangeBetween(-micros, 0)
    rows = events.withColumn("used", F.sum("tokens").over(order)).withColumn("oldest", F.min(micros_of("ts")).over(order))
    wait = F.least(F.col("oldest") + micros - micros_of("ts"), F.lit(5 * micros))
    return rows.withColumn("wait_us", F.when(F.col("used") > limit, wait).otherwise(F.lit(0))).drop("oldest")


def totals(events: DataFrame, limit: float) -> DataFrame:
    """Requests and tokens of each model, and the busiest minute's share of the limit."""
    minute = F.floor(micros_of("ts") / MINUTE)
    per_minute = events.groupBy("model", minute.alias("minute")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return per_minute.groupBy("model").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), (F.max("tokens") / limit).alias("peak"))
