"""Crawl history: records of urls, their status, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import urls
from quorumlake.operators.versions import last_wins

#: Statuses, and what earlier names of them are now.
STATUSES = ("404", "blocked", "no-content", "robots-disallow", "timeout", "unrelated", "related", "index")
LEGACY = {"irrelevant": "unrelated", "good": "related", "good-index": "index"}


def normal_status(status: Column) -> Column:
    """today's name of a status; what isn't one is no-content."""
    out = F.when(status.isin(*STATUSES), status).otherwise("no-content")
    for old, new in LEGACY.items():
        out = F.when(status == old, F.lit(new)).otherwise(out)
    return out


def error_status(message: Column) -> Column:
    """Status for the message of a failed request."""
    return F.when(message.rlike("404|(?i)not found"), "404").when(message.rlike("403|429|(?i)blocked|forbidden|denied"), "blocked").when(message.rlike("(?i)time(d )?out|ETIMEDOUT"), "timeout").otherwise("no-content")


def skippable(status: Column) -> Column:
    """B12."""
    return ~status.isin("related", "index")


def attempted_recently(ts: Column, as_of: Column, days: float) -> Column:
    """Attempted within so many days before as_of; records of the future don't count."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.coalesce((age >= 0) & (age < int(days * 86_400_000_000)), F.lit(False)) if days > 0 else F.lit(False)


def latest(history: DataFrame) -> DataFrame:
    """Of the records of an entity's url, in match form, the last one by its position."""
    rows = history.withColumn("url", urls.match_form(F.col("url"))).withColumn("status", normal_status(F.col("status")))
    return last_wins(rows, ["entity_id", "url"], ["position"])


def fixed(history: DataFrame) -> DataFrame:
    """A record with domains is related."""
    return history.withColumn("status", F.when((F.size("domain_ids") > 0) & (F.col("status") != "related"), "related").otherwise(F.col("status")))


def related_without_domains(history: DataFrame) -> DataFrame:
    """B24."""
    return history.where((F.col("status") == "related") & (F.size("domain_ids") == 0))


def status_counts(history: DataFrame) -> DataFrame:
    """Records of each status of an entity; the columns are given, so no pass looks for them."""
    return history.groupBy("entity_id").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0)


def review_summary(history: DataFrame, hub: str) -> DataFrame:
    """Related, index and other records by host (of the hub by host and first folder), and TOTAL."""
    host = urls.hostname(F.col("url"))
    group = F.when(host == hub, F.concat(host, F.lit("/"), urls.first_folder(F.col("url")))).otherwise(host)
    rows = history.select(group.alias("grp"), "status").rollup("grp").agg(
        F.count_if(F.col("status") == "related").alias("n_related"), F.count_if(F.col("status") == "index").alias("n_index"), F.count_if(~F.col("status").isin("related", "index")).alias("n_other"), F.grouping("grp").alias("total")
    )
    return rows.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("grp")).alias("grp"), "n_related", "n_index", "n_other")


def source_map(history: DataFrame) -> DataFrame:
    """Links of each entity and domain, sorted by url."""
    rows = history.where(F.col("status") == "related").select("entity_id", F.explode("domain_ids").alias("domain_id"), "url")
    return rows.groupBy("entity_id", "domain_id").agg(F.sort_array(F.collect_set("url")).alias("links"))


def reclassified(history: DataFrame, old: str, new: str) -> DataFrame:
    """Domain old becomes new, or goes where new is there already."""
    moved = F.when(F.array_contains("domain_ids", new), F.array_remove("domain_ids", old)).otherwise(F.transform("domain_ids", lambda x: F.when(x == old, F.lit(new)).otherwise(x)))
    return history.where(F.array_contains("domain_ids", old)).withColumn("domain_ids", moved)


def host_owner(rows: DataFrame) -> DataFrame:
    """C11: the entity of each host, the last one by position.  rows: url, entity_id, position."""
    return last_wins(rows.select(urls.hostname(F.col("url")).alias("host"), "entity_id", "position").where("host <> ''"), ["host"], ["position", "entity_id"]).select("host", "entity_id")


def ancestors(url: Column) -> Column:
    """An address and all folders above it, so that a prefix join is a join on equality."""
    root = F.regexp_extract(url, "^([^:]+://[^/]*)", 1)
    parts = F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(root, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def under(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows with each folder (column folder) that is a prefix of their url by whole path parts."""
    return rows.withColumn("folder", F.explode(ancestors(F.col("url")))).join(folders, "folder")


def streaks(attempts: DataFrame, rejected: Column, most: int) -> DataFrame:
    """Rejections in a row before and with each attempt of an entity, and whether they reach most.

    attempts: entity_id, position.  An entity's attempts are one sorted run.
    """
    order = Window.partitionBy("entity_id").orderBy("position")
    runs = attempts.withColumn("rejected", rejected).withColumn("run", F.sum((~F.col("rejected")).cast("int")).over(order))
    streak = F.sum(F.col("rejected").cast("int")).over(Window.partitionBy("entity_id", "run").orderBy("position"))
    return runs.withColumn("streak", streak).withColumn("give_up", F.col("streak") >= most).drop("run")


def merged_sources(existing: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """C17: the existing rows and those found whose key isn't there."""
    return existing.unionByName(found.join(existing.select(*key), list(key), "left_anti"))


def page_caps(pages: DataFrame, per_source: int) -> DataFrame:
    """The first pages of each source, in order of position."""
    order = Window.partitionBy("source").orderBy("position")
    return pages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_source)
