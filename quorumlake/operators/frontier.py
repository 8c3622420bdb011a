"""The crawl's queue as a frontier that grows level by level over a link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.sources import folders

_STATE = "entity_id, source, url, depth, nth, priority, parent"


def crawl(
    links: DataFrame, seeds: DataFrame, depth: int, priority: Column | None = None, per_source: int = 30, per_entity: int | None = None, skipped: DataFrame | None = None, deeper: dict[str, int] | None = None
) -> DataFrame:
    """The pages that a crawl of each entity visits, in order.

    links: url (of a page), pos, target; seeds: entity_id, source, url, place.  priority: a condition over ``target``.
    skipped: entity_id, url that are not visited unless they are seeds (history that is recent or failed for good).
    deeper: levels more that sources may go.  Returns entity_id, source, url, depth, nth (from 1, an entity's pages in
    order), priority and parent (null of seeds).

    A level is visited in this order: links with priority first, then by the place of the page that has the link, then by
    their place in it; seeds go by place.  An address is visited once an entity, where it comes first.  Caps count the
    pages of each source and of each entity in that order, and links of pages beyond a cap are not followed (E08).

    Each level joins the links of the last one, leaves out what was visited and is written to the shared folder, so a
    lost executor costs no level; the driver sees one number a level.  Null urls and targets are no pages.  Repeated rows
    change nothing.  Without seeds nothing is visited.
    """
    spark = seeds.sparkSession
    place = folders.shared(spark)
    links = links.where("url IS NOT NULL AND target IS NOT NULL").groupBy("url", "target").agg(F.min("pos").alias("pos"))
    first = Window.partitionBy("entity_id", "url")
    order = Window.partitionBy("entity_id")
    flag = F.coalesce(priority, F.lit(False)) if priority is not None else F.lit(False)
    key = ["entity_id", "url"]
    start = seeds.where("url IS NOT NULL").select("entity_id", "source", "url", F.lit(False).alias("priority"), F.lit(0).cast("long").alias("from_nth"), F.col("place").cast("long").alias("pos"), F.lit(None).cast(links.schema["url"].dataType).alias("parent"))
    found, seen, level = start, None, 0
    while True:
        by = [F.desc("priority"), F.asc("from_nth"), F.asc("pos"), F.asc("source"), F.asc("url")]
        once = found.withColumn("k", F.row_number().over(first.orderBy(*by))).where("k = 1")
        had = seen.groupBy("entity_id", "source").agg(F.count("*").alias("had")) if seen is not None else None
        every = seen.groupBy("entity_id").agg(F.max("nth").alias("last")) if seen is not None else None
        once = once.join(had, ["entity_id", "source"], "left").join(every, "entity_id", "left") if seen is not None else once.withColumns({"had": F.lit(0).cast("long"), "last": F.lit(0).cast("long")})
        once = once.withColumn("in_source", F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("entity_id", "source").orderBy(*by))).where(F.col("in_source") <= per_source)
        once = once.withColumn("nth", (F.coalesce("last", F.lit(0)) + F.row_number().over(order.orderBy(*by))).cast("long"))
        if per_entity is not None:
            once = once.where(F.col("nth") <= per_entity)
        once.select("entity_id", "source", "url", F.lit(level).alias("depth"), "nth", "priority", "parent").write.parquet(f"{place}/level={level}")
        new = spark.read.parquet(f"{place}/level={level}").selectExpr(*_STATE.split(", "))
        seen = new if seen is None else seen.unionByName(new)
        level += 1
        go_on = F.lit(level) <= depth + F.coalesce(F.create_map(*(F.lit(x) for p in (deeper or {"": 0}).items() for x in p))[F.coalesce("source", F.lit(""))], F.lit(0))
        open_ = new.where(go_on)
        if open_.isEmpty():
            return seen
        found = open_.select("entity_id", "source", F.col("url").alias("parent"), F.col("nth").alias("from_nth")).join(links.withColumnRenamed("url", "parent"), "parent")
        found = found.select("entity_id", "source", F.col("target").alias("url"), flag.alias("priority"), "from_nth", "pos", "parent").join(seen.select(*key), key, "left_anti")
        if skipped is not None:
            found = found.join(skipped.select(*key), key, "left_anti")


def waiting(links: DataFrame, visited: DataFrame) -> DataFrame:
    """entity_id, url, n_links: addresses that visited pages link to and that the crawl hasn't visited."""
    known = visited.select("entity_id", "url")
    found = visited.select("entity_id", F.col("url").alias("parent")).join(links.select(F.col("url").alias("parent"), F.col("target").alias("url")).where("url IS NOT NULL").distinct(), "parent")
    return found.join(known, ["entity_id", "url"], "left_anti").groupBy("entity_id", "url").agg(F.count("*").alias("n_links"))
