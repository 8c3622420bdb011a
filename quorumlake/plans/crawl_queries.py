"""Queries of the crawl: its frontier, its memory as a stream, and the templates that hosts' pages are cut by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import frontier
from quorumlake.plans.registry import Registry
from quorumlake.sources import tables as t

R = Registry()

DEPTH, PER_SOURCE = 3, 30


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as links: a part's page links to its suppliers' pages and back.  Each nation is an entity whose seeds are
    the suppliers of its smallest and largest number."""
    lines = t.table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), F.col("l_orderkey").cast("long").alias("pos"))
    links = lines.select(F.col("p").alias("url"), "pos", F.col("s").alias("target")).union(lines.select("s", "pos", "p"))
    ends = t.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("entity_id")).agg(F.min("s_suppkey").alias("main"), F.max("s_suppkey").alias("hub"))
    seeds = ends.unpivot("entity_id", ["main", "hub"], "source", "n").select("entity_id", "source", F.concat(F.lit("s"), "n").alias("url"), F.when(F.col("source") == "main", 0).otherwise(1).alias("place"))
    return links, seeds


def _frontier_sql() -> str:
    by = "priority DESC, from_nth, pos, source, url"
    steps = ["""links AS (SELECT url, target, min(pos) AS pos FROM (SELECT 'p' || l_partkey AS url, l_orderkey AS pos, 's' || l_suppkey AS target FROM lineitem UNION ALL SELECT 's' || l_suppkey, l_orderkey, 'p' || l_partkey FROM lineitem) GROUP BY 1, 2),
ends AS (SELECT s_nationkey AS entity_id, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1),
f0 AS (SELECT entity_id, 'main' AS source, 's' || a AS url, false AS priority, 0 AS from_nth, 0 AS pos, NULL AS parent FROM ends UNION ALL SELECT entity_id, 'hub', 's' || b, false, 0, 1, NULL FROM ends),
v_ AS (SELECT NULL::INT AS entity_id, NULL AS source, NULL AS url, 0 AS depth, 0::BIGINT AS nth, false AS priority, NULL AS parent WHERE false)"""]  # fmt: skip
    seen = "v_"
    for i in range(DEPTH + 2):
        steps.append(f"""o{i} AS (SELECT * FROM f{i} QUALIFY row_number() OVER (PARTITION BY entity_id, url ORDER BY {by}) = 1),
c{i} AS (SELECT o.* FROM o{i} o LEFT JOIN (SELECT entity_id, source, count(*) AS had FROM {seen} GROUP BY 1, 2) h ON h.entity_id = o.entity_id AND h.source = o.source
  QUALIFY coalesce(h.had, 0) + row_number() OVER (PARTITION BY o.entity_id, o.source ORDER BY o.priority DESC, o.from_nth, o.pos, o.source, o.url) <= {PER_SOURCE}),
n{i} AS (SELECT c.entity_id, c.source, c.url, {i} AS depth, coalesce(l.last, 0) + row_number() OVER (PARTITION BY c.entity_id ORDER BY c.priority DESC, c.from_nth, c.pos, c.source, c.url) AS nth, c.priority, c.parent
  FROM c{i} c LEFT JOIN (SELECT entity_id, max(nth) AS last FROM {seen} GROUP BY 1) l ON l.entity_id = c.entity_id),
v{i} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM n{i}),
f{i + 1} AS (SELECT n.entity_id, n.source, k.target AS url, k.target LIKE '%7' AS priority, n.nth AS from_nth, k.pos, n.url AS parent FROM n{i} n JOIN links k ON k.url = n.url
  WHERE {i + 1} <= {DEPTH} + CASE WHEN n.source = 'hub' THEN 1 ELSE 0 END AND NOT EXISTS (SELECT 1 FROM v{i} v WHERE v.entity_id = n.entity_id AND v.url = k.target))""")  # fmt: skip
        seen = f"v{i}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT entity_id, source, url, depth::INTEGER AS depth, nth::BIGINT AS nth, priority, parent FROM {seen}"


@R.add(_frontier_sql(), common=False)
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Three levels, hubs one more, thirty pages a source; numbers that end in 7 go first."""
    links, seeds = _graph(spark, d)
    return frontier.crawl(links, seeds, DEPTH, F.endswith("target", F.lit("7")), PER_SOURCE, deeper={"hub": 1})


@R.add(f"{_frontier_sql().replace('SELECT entity_id, source, url, depth::INTEGER AS depth, nth::BIGINT AS nth, priority, parent FROM', ', seen AS (SELECT entity_id, url FROM')}) SELECT s.entity_id, k.target AS url, count(*)::BIGINT AS n_links FROM seen s JOIN links k ON k.url = s.url WHERE NOT EXISTS (SELECT 1 FROM seen v WHERE v.entity_id = s.entity_id AND v.url = k.target) GROUP BY 1, 2", common=False)
def crawl_waiting(spark: SparkSession, d: str) -> DataFrame:
    """what the crawl found and left."""
    links, seeds = _graph(spark, d)
    visited = frontier.crawl(links, seeds, DEPTH, F.endswith("target", F.lit("7")), PER_SOURCE, deeper={"hub": 1})
    return frontier.waiting(links, visited)
