"""Structured Streaming forms of the incremental operators.

Each function takes a streaming DataFrame (and works on a batch one alike).  run_available() drives a stream over what
is there now and gives the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quorumlake.operators import pages as page_ops


def token_windows(events: DataFrame, late: str = "10 minutes", length: str = "60 seconds") -> DataFrame:
    """Requests and tokens of each model in each minute; records later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "model", "n", "tokens")


def host_vote_counts(pages: DataFrame) -> DataFrame:
    """Running votes of each host for its footer and header selectors."""
    zones = pages.select(page_ops.urls.hostname(F.col("url")).alias("host"), page_ops.zone_selector(F.col("html"), page_ops.FOOTERS).alias("footer"), page_ops.zone_selector(F.col("html"), page_ops.HEADERS).alias("header"))
    votes = zones.select("host", F.explode(F.array(F.struct(F.lit("footer").alias("zone"), F.col("footer").alias("selector")), F.struct(F.lit("header").alias("zone"), F.col("header").alias("selector")))).alias("z")).select("host", "z.*")
    return votes.where("selector is not null").groupBy("host", "zone", "selector").agg(F.count("*").alias("votes"))


def first_visits(pages: DataFrame, late: str = "3 days") -> DataFrame:
    """The first visit of each (entity_id, url) within the time that state is kept."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity_id", "url"])


def latest_records(records: DataFrame) -> DataFrame:
    """The newest record of each (entity_id, url) by its own time, so an older one that comes late changes nothing."""
    return records.groupBy("entity_id", "url").agg(F.max_by("status", F.struct("ts", "position")).alias("status"), F.max("ts").alias("ts"))


def due_recrawls(records: DataFrame, days: float = 3) -> DataFrame:
    """Urls whose last visit is older than so many days of event time, told once when their time is up."""
    millis = int(days * 86_400_000)

    def visit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"entity_id": [key[0]], "url": [key[1]], "last_ms": [last]})
            return
        last = max(state.get[0] if state.exists else 0, *(int(b["ms"].max()) for b in batches))
        state.update((last,))
        if last + millis > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + millis)
        else:
            state.remove()
            yield pd.DataFrame({"entity_id": [key[0]], "url": [key[1]], "last_ms": [last]})

    timed = records.withWatermark("ts", "1 hour").select("entity_id", "url", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("entity_id", "url").applyInPandasWithState(visit, "entity_id long, url string, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class _Visits(StatefulProcessor):
    """State of one (entity_id, url): the time of its last visit, forgotten when it is due again."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = sorted(int(x) for b in rows for x in b["ms"])
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for ms in found:
            if last is None or ms >= last + self.millis:
                out.append((*key, ms, "first" if last is None else "again"))
                last = ms
        if out:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer(last + self.millis)
        yield pd.DataFrame(out, columns=["entity_id", "url", "ms", "kind"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"entity_id": [key[0]], "url": [key[1]], "ms": [expiredTimerInfo.getExpiryTimeInMs()], "kind": ["due"]})

    def close(self) -> None:
        pass


def kept_visits(pages: DataFrame, days: float = 3, late: str = "1 hour") -> DataFrame:
    """entity_id, url, ms, kind: first visits, visits again once the time is up, and when an address is due.

    pages: entity_id, url, ts.  Records of an address within ``days`` of its last visit are no visits.  An address's state
    is one number and goes when event time has passed its last visit by ``days``, so state is bounded by the addresses
    of that time.  Needs the RocksDB state store.
    """
    rows = pages.withWatermark("ts", late).select("entity_id", "url", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("entity_id", "url").transformWithStateInPandas(_Visits(int(days * 86_400_000)), "entity_id long, url string, ms long, kind string", "append", "EventTime")


def upsert_chunks(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a version of its own keys, written beside the earlier ones.

    Batches are idempotent, as a batch's folder is overwritten when it is tried again; read_upserted() takes the newest.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def read_upserted(spark: SparkSession, target: str, key: str) -> DataFrame:
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def run_available(stream: DataFrame, mode: str, target: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result, kept in target.

    In append mode rows are added; in complete mode the last result counts.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", target)
    else:
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(target))
    query.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
