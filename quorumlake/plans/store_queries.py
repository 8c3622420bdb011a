"""Queries on the document store: each writes documents of the tables with Spark and reads them with the store's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.plans.registry import Registry
from quorumlake.sources import folders, store
from quorumlake.sources import tables as t

R = Registry()


def _lines(rows: DataFrame, path: str) -> str:
    """The rows' first column as the lines of text files below a folder."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.text(path)
    return path



@R.add("SELECT r_regionkey::VARCHAR AS id, r_name AS name, 'datapath-' || r_regionkey AS datapath, r_regionkey = 1 AS looked_up FROM region")
def stored_realms(spark: SparkSession, d: str) -> DataFrame:
    """Realms of a list, and one of them by its id."""
    root = folders.shared(spark)
    rows = t.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("datapath-"), "r_regionkey").alias("datapath"))
    _lines(rows.agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("realms"))).alias("value")), f"{root}/realms.json")
    one = store.realm(spark, root, "1")
    return store.realms(spark, root).select("id", "name", "datapath", (F.col("id") == one.id).alias("looked_up"))


@R.add("SELECT n_nationkey::VARCHAR AS entity_id, n_regionkey::VARCHAR AS domain_id, n_name || chr(10) AS text FROM nation")
def stored_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each entity and domain."""
    root = folders.shared(spark)
    t.table(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    rows = store.text_files(spark, f"{root}/*/*/*.txt")
    return rows.select(F.regexp_replace("entity_id", "^.*=", "").alias("entity_id"), F.regexp_replace("domain_id", "^.*=", "").alias("domain_id"), "text")


@R.add("SELECT n_regionkey AS folder, count(*) > 0 AS has_files, sum(strlen(n_name) + 1)::BIGINT AS n_bytes FROM nation GROUP BY 1")
def stored_files(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder, their sizes, whether there are any."""
    root = folders.shared(spark)
    t.table(spark, d, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(root)
    stats = store.file_stats(spark, f"{root}/*/*.txt")
    return stats.groupBy(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("long").alias("folder")).agg((F.count("*") > 0).alias("has_files"), F.sum("length").alias("n_bytes"))


@R.add("""SELECT c_name AS name, 'said "' || c_mktsegment || '", twice' AS note FROM customer""")
def stored_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with quotes and commas in its cells."""
    root = folders.shared(spark)
    rows = t.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit('said "'), "c_mktsegment", F.lit('", twice')).alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(root)
    return store.sheet(spark, root, ["name", "note"])


@R.add("SELECT DISTINCT url FROM pages")
def stored_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of a list with notes and blank lines."""
    p = t.table(spark, d, "pages").select("url").distinct()
    notes = spark.createDataFrame([("# a note",), ("",), ("   ",)], "url string")
    return store.url_list(spark, _lines(p.select(F.concat(F.lit(" "), "url", F.lit(" "))).union(notes), folders.shared(spark)))


@R.add("SELECT n_name AS name, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',1]}' AS geometry FROM nation")
def stored_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Features of a map."""
    n = t.table(spark, d, "nation")
    feature = F.struct(F.struct(F.col("n_name").alias("NAME")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey"), F.lit(1)).alias("coordinates")).alias("geometry"))
    path = _lines(n.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")))), folders.shared(spark))
    return store.boundaries(spark, path).select(F.col("properties")["NAME"].alias("name"), "geometry")


@R.add("SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS body FROM customer")
def saved_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two saves of analyses, entities or histories, of which the second holds a half."""
    folder = folders.shared(spark)
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    store.save_version(rows.withColumn("body", F.lit("old")), folder, F.lit("2024-01-01 00:00:00"))
    store.save_version(rows.where("entity_id % 2 = 0").withColumn("body", F.lit("new")), folder, F.lit("2024-01-02 00:00:00"))
    return store.current(spark, folder, ["entity_id"]).select("entity_id", "body")


@R.add("SELECT c_custkey AS entity_id, '2024-01-0' || day AS day, CASE WHEN day = 1 THEN 'b' ELSE 'c' END AS body FROM customer, (SELECT unnest([1, 2]) AS day)")
def pruned_versions(spark: SparkSession, d: str) -> DataFrame:
    """Of three saves on two days the last of each day stays."""
    folder, target = folders.shared(spark), folders.shared(spark)
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    for body, at in (("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00"), ("c", "2024-01-02 01:00:00")):
        store.save_version(rows.withColumn("body", F.lit(body)), folder, F.lit(at))
    store.prune(spark, folder, target, ["entity_id"])
    return spark.read.parquet(target).select("entity_id", F.date_format("saved_at", "yyyy-MM-dd").alias("day"), "body")


@R.add("SELECT '| ' || n_name || ' | ' || n_nationkey || ' |' AS line FROM nation UNION ALL SELECT '| name | key |' UNION ALL SELECT '| --- | --- |'")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A report as a table of text lines."""
    folder = folders.shared(spark)
    store.write_report(t.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), folder, "markdown", "key")
    return spark.read.text(folder).select(F.trim("value").alias("line")).where("line <> ''")
