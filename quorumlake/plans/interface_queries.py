"""Queries through the library's interfaces: the document tree, a caller's own function, scoring and sheets, kept visits."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import callbacks, sheets
from quorumlake.plans.registry import Registry
from quorumlake.sources import document_tree, folders
from quorumlake.sources import tables as t
from quorumlake.streaming import incremental

R = Registry()


def _tree(spark: SparkSession, d: str) -> str:
    """Order lines' parts as documents of their brands and types, in two writes: the second adds versions of even sizes."""
    document_tree.register(spark)
    root = folders.shared(spark)
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t.table(spark, d, "part").select(
        F.lit("us").alias("realm_id"), F.replace("p_brand", F.lit("#"), F.lit("/")).alias("domain_id"), F.concat(F.lit("e "), F.floor(k / 20)).alias("entity_id"),
        F.concat(F.lit("part@"), k, F.lit(".json")).alias("name"), F.to_json(F.struct(k.alias("id"), size.alias("size"))).alias("content"), size,
    )
    save = lambda some: document_tree.save(some.drop("p_size"), root)
    save(rows)
    save(rows.where(size % 2 == 0).withColumn("content", F.concat(F.lit("new "), "content")))
    return root


@R.add("""SELECT 'us' AS realm_id, replace(p_brand, '#', '/') AS domain_id, 'e ' || (p_partkey // 20) AS entity_id, 'part@' || p_partkey || '.json' AS name,
  CASE WHEN p_size % 2 = 0 THEN 'new ' ELSE '' END || '{"id":' || p_partkey || ',"size":' || p_size || '}' AS content FROM part""", common=False)
def tree_documents(spark: SparkSession, d: str) -> DataFrame:
    """Written by the data source and read back in the last version of each document."""
    return spark.read.format("document_tree").option("path", _tree(spark, d)).load()


@R.add("""SELECT replace(p_brand, '#', '/') AS domain_id, 'e ' || (p_partkey // 20) AS entity_id, count(*)::BIGINT AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#3', 'Brand#11', 'Brand#23') GROUP BY 1, 2""", common=False)
def tree_folders(spark: SparkSession, d: str) -> DataFrame:
    """With a filter that the source is given, so other domains' folders aren't listed."""
    rows = spark.read.format("document_tree").option("path", _tree(spark, d)).load()
    return rows.where(F.col("domain_id").isin("Brand/1", "Brand/3", "Brand/11", "Brand/23")).groupBy("domain_id", "entity_id").agg(F.count("*").alias("n"))


def _links_of(row: dict) -> list[dict]:
    """A caller's own function: words with a digit or capital of each text; texts that begin with a vowel are beyond it."""
    if re.match("[aeiouAEIOU]", row["text"] or ""):
        raise ValueError(f"begins with {row['text'][0]}")
    return [{"n_capitals": len(re.findall("[A-Z]", row["text"] or "")), "name": json.dumps({"id": row["doc_id"]})}] * ((row["doc_id"] or 0) % 3)


@R.add("""SELECT doc_id, 'result' AS kind, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n, '{"id": ' || doc_id || '}' AS told FROM documents, range(2) AS r(i) WHERE NOT regexp_matches(coalesce(text, ''), '^[aeiouAEIOU]') AND i < doc_id % 3
UNION ALL SELECT doc_id, 'ValueError', NULL, 'begins with ' || substr(text, 1, 1) FROM documents WHERE regexp_matches(coalesce(text, ''), '^[aeiouAEIOU]')""", common=False)
def processed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A function on every whole document; what it can't do is in the table of errors."""
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    done = callbacks.process(docs, "doc_id", _links_of, "n_capitals long, name string", folders.shared(spark))
    results = done.results().select("doc_id", F.lit("result").alias("kind"), F.col("n_capitals").alias("n"), F.col("name").alias("told"))
    return results.union(done.errors().select("doc_id", "kind", F.lit(None).cast("long"), "message"))


@R.add("""WITH RECURSIVE e AS (SELECT user_id % 40 AS entity_id, 'u' || (event_id % 25) AS url, epoch_us(ts) // 1000 AS ms FROM events),
v AS (SELECT entity_id, url, min(ms) AS ms, 'first' AS kind FROM e GROUP BY 1, 2
  UNION SELECT v.entity_id, v.url, (SELECT min(e.ms) FROM e WHERE e.entity_id = v.entity_id AND e.url = v.url AND e.ms >= v.ms + 259200000), 'again' FROM v WHERE v.ms IS NOT NULL)
SELECT entity_id, url, ms, kind FROM v WHERE ms IS NOT NULL""", common=False)
def stream_kept_visits(spark: SparkSession, d: str) -> DataFrame:
    """I01, I04, as a stream with a state of its own: visits three days or more after the last one count again."""
    kept = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(t.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = events.select((F.col("user_id") % 40).alias("entity_id"), F.concat(F.lit("u"), F.col("event_id") % 25).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    place = folders.shared(spark)
    try:
        return incremental.run_available(incremental.kept_visits(rows), "append", f"{place}/out", f"{place}/log").where("kind <> 'due'")
    finally:
        spark.conf.set(kept, before)


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """A row a customer: the name with its segment in brackets, two cells with grades; every ninth has no name, every 13th is short."""
    k = F.col("c_custkey")
    name = F.when(k % 9 == 0, " ").otherwise(F.concat(F.regexp_replace("c_name", "#", " "), F.lit(" ("), F.initcap(F.lower("c_mktsegment")), F.lit("/x)")))
    one = F.when(k % 4 == 0, "VG - very good").when(k % 4 == 1, " G").when(k % 4 == 2, "Yes").otherwise("none")
    two = F.when(k % 3 == 0, "R-").when(k % 3 == 1, "no ").otherwise("")
    return t.table(spark, d, "customer").select(k.alias("row_id"), F.when(k % 13 == 0, F.array(name, one)).otherwise(F.array(name, one, two)).alias("cells"))


_COLUMNS = {"trees": 1, "noise": 2}
_NAMES_SQL = """rows AS (SELECT c_custkey AS k, c_name, c_mktsegment AS m, c_custkey % 4 AS a, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE c_custkey % 3 END AS b FROM customer WHERE c_custkey % 9 <> 0)"""


@R.add(f"""WITH {_NAMES_SQL}, g AS (SELECT k, c_name, m, 'trees' AS domain_id, CASE a WHEN 0 THEN 'Very Good' WHEN 1 THEN 'Good' END AS grade FROM rows UNION ALL SELECT k, c_name, m, 'noise', CASE WHEN b = 0 THEN 'Red' END FROM rows)
SELECT 'NY-' || replace(replace(c_name, '#', ''), ' ', '') || '-' || upper(m[1]) || lower(m[2:]) AS entity_id, 'NY' AS state, domain_id, grade FROM g WHERE grade IS NOT NULL""", common=False)
def sheet_grades(spark: SparkSession, d: str) -> DataFrame:
    """A sheet read by a parser of codes."""
    return sheets.grades(_sheet(spark, d), sheets.GradeSheet(_COLUMNS, {"VG": "Very Good", "G": "Good", "R": "Red"}))


@R.add(f"""WITH {_NAMES_SQL}, g AS (SELECT k, c_name, m, 'trees' AS domain_id, CASE WHEN a = 2 THEN 'Good' END AS grade FROM rows UNION ALL SELECT k, c_name, m, 'noise', CASE WHEN b = 1 THEN 'Red' END FROM rows)
SELECT lower(replace(c_name, '#', '-')) || '-' || lower(m) || '-x' AS entity_id, '' AS state, domain_id, grade FROM g WHERE grade IS NOT NULL""", common=False)
def sheet_answers(spark: SparkSession, d: str) -> DataFrame:
    """The same sheet, read by a parser of yes and no."""
    return sheets.grades(_sheet(spark, d), sheets.PlainSheet(_COLUMNS))
