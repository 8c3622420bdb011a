"""Readers of the engine's tables, and the civic tables that the star schema of the test data stands for.

The civic tables: entities (customers), domains (order priorities), analyses (one version an order), questions (seven a
domain), answers (order lines).  All are declared lazily, so a query scans only the columns that it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIDDEN_DOMAIN = "4-NOT SPECIFIED"
QUESTIONS = 7
#: In this domain the last question isn't defined, so its answers weigh as the default says.
SHORT_DOMAIN = "1-URGENT"
NOT_IN_STATUTE = "Not specified in the statute."

#: The same tables for DuckDB, as a list of common table expressions.
CIVIC_SQL = f"""
entities AS (
  SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS type, n_name AS county, r_name AS state, c_acctbal < -900 AS test
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
domains AS (SELECT DISTINCT o_orderpriority AS domain_id, o_orderpriority <> '{HIDDEN_DOMAIN}' AS show FROM orders),
analyses AS (
  SELECT o_orderkey AS analysis_id, o_custkey AS entity_id, o_orderpriority AS domain_id, o_orderdate AS ts, o_orderstatus = 'P' AS state_code,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS version
  FROM orders),
questions AS (
  SELECT domain_id, q AS question_id, q % 3 + 1 AS weight
  FROM (SELECT DISTINCT o_orderpriority AS domain_id FROM orders), (SELECT unnest(range(1, {QUESTIONS + 1})) AS q)
  WHERE NOT (domain_id = '{SHORT_DOMAIN}' AND q = {QUESTIONS})),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem),
answers AS (
  SELECT a.analysis_id, a.entity_id, a.domain_id, a.version, l_linenumber::INTEGER AS question_id, l_discount * 10 AS score, l_quantity * 2 AS confidence,
         CASE WHEN l_returnflag = 'R' THEN '{NOT_IN_STATUTE}' ELSE 'Part ' || l_partkey || ' applies under ' || l_linestatus || '.' END AS answer
  FROM lines JOIN analyses a ON l_orderkey = a.analysis_id WHERE rn = 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as a shuffle has: a table of short rows is one file and one task, whatever work
    each row makes behind the scan."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, type, county, state, test."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("n_name").alias("county"), F.col("r_name").alias("state"), (F.col("c_acctbal") < -900).alias("test")
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain_id, show."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("domain_id")).distinct()
    return ids.withColumn("show", F.col("domain_id") != HIDDEN_DOMAIN)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions (E01): analysis_id, entity_id, domain_id, ts, state_code, version (1 is the current one)."""
    newest = Window.partitionBy("entity_id", "domain_id").orderBy(F.desc("ts"), F.desc("analysis_id"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("domain_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("state_code")
    )
    return rows.withColumn("version", F.row_number().over(newest))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain_id, question_id, weight."""
    ids = domains(spark, sf_dir).select("domain_id", F.explode(F.sequence(F.lit(1), F.lit(QUESTIONS))).alias("question_id"))
    defined = ids.where(~((F.col("domain_id") == SHORT_DOMAIN) & (F.col("question_id") == QUESTIONS)))
    return defined.withColumn("weight", F.col("question_id") % 3 + 1)


def answers(spark: SparkSession, sf_dir: str, current: bool = False) -> DataFrame:
    """A07, exploded: analysis_id, entity_id, domain_id, version, question_id, score (0 to 1), confidence, answer."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem")
    versions = analyses(spark, sf_dir)
    if current:
        versions = versions.where("version = 1")
    text = F.when(F.col("l_returnflag") == "R", NOT_IN_STATUTE).otherwise(F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" applies under "), F.col("l_linestatus"), F.lit(".")))
    # lines meet their order before repeated ones go, so one shuffle by the order serves both, and those of older versions aren't sorted
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest)
    joined = lines.join(versions, lines.l_orderkey == versions.analysis_id).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return joined.select("analysis_id", "entity_id", "domain_id", "version", F.col("l_linenumber").cast("int").alias("question_id"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") * 2).alias("confidence"), text.alias("answer"))
