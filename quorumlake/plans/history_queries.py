"""Queries on crawl history, sources, usage, vectors, data domains and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import datadomain, history, sources, usage, vectors, versions
from quorumlake.plans.registry import Registry
from quorumlake.sources import folders
from quorumlake.sources import tables as t
from quorumlake.streaming import incremental

KINDS = (("click", "good"), ("view", "related"), ("error", "404"), ("signup", "good-index"), ("purchase", "irrelevant"))
STATUS_SQL = "CASE event_type WHEN 'click' THEN 'related' WHEN 'view' THEN 'related' WHEN 'error' THEN '404' WHEN 'signup' THEN 'index' WHEN 'purchase' THEN 'unrelated' ELSE 'no-content' END"
HISTORY_SQL = f"""log AS (
  SELECT event_id AS position, user_id % 40 AS entity_id, ts, {STATUS_SQL} AS status, 'https://www.site' || (user_id % 12) || '.org/' || (CASE WHEN event_id % 3 = 0 THEN 'parks' ELSE 'law' END) || '/' || (event_id % 25) AS url,
         CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN ['trees'] WHEN event_id % 4 = 2 THEN ['trees', 'noise'] ELSE ['property'] END AS domain_ids FROM events),
latest AS (SELECT entity_id, url, max_by(struct_pack(status := status, domain_ids := domain_ids, ts := ts, position := position), position) AS r FROM log GROUP BY 1, 2),
hist AS (SELECT entity_id, url, r.status AS status, r.domain_ids AS domain_ids, r.ts AS ts, r.position AS position FROM latest)"""
R = Registry(HISTORY_SQL)


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    status = F.lit(None).cast("string")
    for kind, name in KINDS:
        status = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(status)
    folder = F.when(F.col("event_id") % 3 == 0, "parks").otherwise("law")
    url = F.concat(F.lit("HTTPS://WWW.site"), F.col("user_id") % 12, F.lit(".org/"), folder, F.lit("/"), F.col("event_id") % 25, F.when(F.col("event_id") % 2 == 0, "/?utm=1").otherwise("#top"))
    n = F.col("event_id") % 4
    domains = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("trees"))).when(n == 2, F.array(F.lit("trees"), F.lit("noise"))).otherwise(F.array(F.lit("property")))
    return e.select(F.col("event_id").alias("position"), (F.col("user_id") % 40).alias("entity_id"), "ts", status.alias("status"), url.alias("url"), domains.alias("domain_ids"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(_log(spark, d))


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


@R.add("SELECT entity_id, url, status, array_to_string(domain_ids, ',') AS domains, position FROM hist")
def history_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each url."""
    return _history(spark, d).select("entity_id", "url", "status", _joined("domain_ids").alias("domains"), "position")


@R.add("SELECT entity_id, " + ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS \"{s}\"" for s in history.STATUSES) + " FROM hist GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """D09, D24."""
    return history.status_counts(_history(spark, d))


@R.add("""SELECT coalesce(g, 'TOTAL') AS grp, count(*) FILTER (status = 'related')::BIGINT AS n_related, count(*) FILTER (status = 'index')::BIGINT AS n_index, count(*) FILTER (status NOT IN ('related', 'index'))::BIGINT AS n_other
FROM (SELECT status, CASE WHEN regexp_extract(url, '://([^/]*)', 1) = 'www.site3.org' THEN 'www.site3.org/' || regexp_extract(url, '://[^/]*/([^/]*)', 1) ELSE regexp_extract(url, '://([^/]*)', 1) END AS g FROM hist) GROUP BY ROLLUP (g)""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """D10."""
    return history.review_summary(_history(spark, d), "www.site3.org")


@R.add("""SELECT entity_id, url, CASE WHEN len(domain_ids) > 0 THEN 'related' ELSE status END AS status, status NOT IN ('related', 'index') AS skippable,
  epoch_us(ts) <= epoch_us((SELECT max(ts) FROM events)) AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 3 * 86400000000 AS recent FROM hist""")
def crawl_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Mended status, whether it may be skipped, and whether it was tried within three days of the last event."""
    now = t.table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    rows = _history(spark, d).crossJoin(F.broadcast(now))  # one row
    mended = history.fixed(rows).select("entity_id", "url", F.col("status").alias("fixed"))
    return rows.join(mended, ["entity_id", "url"]).select("entity_id", "url", F.col("fixed").alias("status"), history.skippable(F.col("status")).alias("skippable"), history.attempted_recently(F.col("ts"), F.col("as_of"), 3).alias("recent"))


@R.add("SELECT entity_id, url FROM hist WHERE status = 'related' AND len(domain_ids) = 0")
def related_without_domains(spark: SparkSession, d: str) -> DataFrame:
    """B24."""
    return history.related_without_domains(_history(spark, d)).select("entity_id", "url")


@R.add("SELECT entity_id, domain_id, count(*)::BIGINT AS n, string_agg(url, ' ' ORDER BY url) AS links FROM (SELECT entity_id, url, unnest(domain_ids) AS domain_id FROM hist WHERE status = 'related') GROUP BY 1, 2")
def source_map(spark: SparkSession, d: str) -> DataFrame:
    """A41, D08."""
    return history.source_map(_history(spark, d)).select("entity_id", "domain_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


@R.add("SELECT c.c_custkey AS entity_id, coalesce(n, 0)::BIGINT AS n, coalesce(links, '') AS links FROM customer c LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS links FROM hist WHERE status = 'related' AND len(domain_ids) > 0 GROUP BY 1) h ON h.entity_id = c.c_custkey")
def download_summary(spark: SparkSession, d: str) -> DataFrame:
    """Downloads of every entity, sorted by url."""
    found = _history(spark, d).where("status = 'related' AND size(domain_ids) > 0").groupBy("entity_id").agg(F.sort_array(F.collect_list("url")).alias("l"))
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return people.join(found, "entity_id", "left").select("entity_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("l", " "), F.lit("")).alias("links"))


@R.add("""SELECT entity_id, url, array_to_string(CASE WHEN list_contains(domain_ids, 'noise') THEN list_filter(domain_ids, lambda x: x <> 'trees') ELSE list_transform(domain_ids, lambda x: CASE WHEN x = 'trees' THEN 'noise' ELSE x END) END, ',') AS domains FROM hist WHERE list_contains(domain_ids, 'trees')""")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """C32."""
    return history.reclassified(_history(spark, d), "trees", "noise").select("entity_id", "url", _joined("domain_ids").alias("domains"))


@R.add("SELECT regexp_extract(url, '://([^/]*)', 1) AS host, max_by(entity_id, (position, entity_id)) AS entity_id FROM log GROUP BY 1")
def host_owners(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    return history.host_owner(_log(spark, d))


@R.add("SELECT f.folder, count(*)::BIGINT AS n FROM hist JOIN (SELECT 'https://www.site' || i || '.org/' || p AS folder FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(['parks', 'law', '']) AS p)) f ON hist.url = f.folder OR starts_with(hist.url, rtrim(f.folder, '/') || '/') GROUP BY 1")
def folder_contents(spark: SparkSession, d: str) -> DataFrame:
    """Records under each folder, by an equality join on their ancestors."""
    folder = spark.range(6).select(F.explode(F.array(*(F.concat(F.lit("https://www.site"), "id", F.lit(".org/"), F.lit(p)) for p in ("parks", "law", "")))).alias("folder"))
    return history.under(_history(spark, d), folder).groupBy("folder").agg(F.count("*").alias("n"))


@R.add("""WITH a AS (SELECT user_id AS entity_id, event_id AS position, event_type IN ('error', 'click') AS rejected FROM events),
r AS (SELECT *, sum(CASE WHEN rejected THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY position) AS run FROM a)
SELECT entity_id, position, (sum(rejected::INTEGER) OVER (PARTITION BY entity_id, run ORDER BY position))::BIGINT AS streak, sum(rejected::INTEGER) OVER (PARTITION BY entity_id, run ORDER BY position) >= 3 AS give_up FROM r""", common=False)
def rejection_streaks(spark: SparkSession, d: str) -> DataFrame:
    """E06."""
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("position"), "event_type")
    return history.streaks(rows, F.col("event_type").isin("error", "click"), 3).select("entity_id", "position", "streak", "give_up")


@R.add("SELECT source, position, n::INTEGER AS n FROM (SELECT source, doc_id AS position, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 30", common=False)
def page_caps(spark: SparkSession, d: str) -> DataFrame:
    """E08."""
    return history.page_caps(t.table(spark, d, "documents").select("source", F.col("doc_id").alias("position")), 30)


@R.add("""SELECT event_id, floor(used * 10000 + 0.5) / 10000 AS used, CASE WHEN floor(used * 10000 + 0.5) / 10000 > 100 THEN least(oldest + 60000000 - us, 300000000) ELSE 0 END AS wait_us
FROM (SELECT event_id, epoch_us(ts) AS us, sum(value) OVER w AS used, min(epoch_us(ts)) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))""", common=False)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """D19, E05."""
    rows = t.table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), "ts", F.col("value").alias("tokens"))
    out = usage.sliding(rows)
    return out.select("event_id", (F.floor(F.col("used") * 10000 + 0.5) / 10000).alias("used"), "wait_us")


@R.add("SELECT event_type AS model, sum(n)::BIGINT AS n, floor(sum(tokens) * 100 + 0.5) / 100 AS tokens, floor(max(tokens) / 1000 * 10000 + 0.5) / 10000 AS peak FROM (SELECT event_type, epoch_us(ts) // 60000000 AS m, count(*) AS n, sum(value) AS tokens FROM events GROUP BY 1, 2) GROUP BY 1", common=False)
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    """D19."""
    rows = t.table(spark, d, "events").select(F.col("event_type").alias("model"), "ts", F.col("value").alias("tokens"))
    return usage.totals(rows, 1000).select("model", "n", (F.floor(F.col("tokens") * 100 + 0.5) / 100).alias("tokens"), (F.floor(F.col("peak") * 10000 + 0.5) / 10000).alias("peak"))


CHUNKS_SQL = """chunks AS (SELECT label || '-doc' || (vec_id % 20) || '-' || (vec_id // 20) AS chunk_id, vec_id, label AS entity_id, CASE WHEN vec_id % 3 = 0 THEN ['trees'] ELSE ['noise', 'trees'] END AS domain_ids, CASE WHEN vec_id % 2 = 0 THEN 'code' ELSE 'form' END AS kind, embedding FROM embeddings)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return t.table(spark, d, "embeddings").select(
        F.concat(F.col("label"), F.lit("-doc"), v % 20, F.lit("-"), F.floor(v / 20)).alias("chunk_id"), "vec_id", F.col("label").alias("entity_id"), F.when(v % 3 == 0, F.array(F.lit("trees"))).otherwise(F.array(F.lit("noise"), F.lit("trees"))).alias("domain_ids"),
        F.when(v % 2 == 0, "code").otherwise("form").alias("kind"), F.col("embedding").alias("vector"),
    )


@R.add(f"WITH {CHUNKS_SQL} SELECT 'prefix' AS what, count(*)::BIGINT AS n FROM chunks WHERE starts_with(chunk_id, '3-') UNION ALL SELECT 'domain', count(*)::BIGINT FROM chunks WHERE entity_id = 3 AND list_contains(domain_ids, 'noise') AND kind = 'code'", common=False)
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """A37, A38, B10."""
    rows = _chunks(spark, d)
    return vectors.count_prefix(rows, "3-").select(F.lit("prefix").alias("what"), "n").union(vectors.in_domain(rows, 3, "noise", "code").agg(F.lit("domain").alias("what"), F.count("*").alias("n")))


@R.add(f"WITH {CHUNKS_SQL} SELECT regexp_replace(chunk_id, '-0$', '') AS document FROM chunks WHERE ends_with(chunk_id, '-0') ORDER BY document LIMIT 100", common=False)
def indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A39, F11."""
    return vectors.documents(_chunks(spark, d))


@R.add(f"""WITH {CHUNKS_SQL}, s AS (SELECT q.vec_id AS query_id, c.chunk_id, floor(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM chunks c, embeddings q WHERE q.vec_id % 50 = 0 AND list_contains(c.domain_ids, 'noise'))
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""", common=False)
def nearest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Filtered first, then the five nearest."""
    queries = t.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = _chunks(spark, d).where(F.array_contains("domain_ids", "noise")).select("chunk_id", "vector")
    return vectors.nearest(queries, rows, 5).select("query_id", "chunk_id", "score", "rank")


@R.add(f"WITH {CHUNKS_SQL} SELECT vec_id, CASE WHEN starts_with(chunk_id, '3-doc1') THEN '9-new' || substr(chunk_id, 7) ELSE chunk_id END AS chunk_id FROM chunks WHERE regexp_replace(chunk_id, '-[0-9]+$', '') NOT IN ('4-doc4', '5-doc5', '2-doc2')", common=False)
def reindexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A62, A63, C33."""
    gone = spark.createDataFrame([("4-doc4",), ("5-doc5",), ("2-doc2",)], "document string")
    return vectors.renamed(vectors.without_prefix(_chunks(spark, d), gone), "3-doc1", "9-new").select("vec_id", "chunk_id")


@R.add(f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN vec_id % 5 = 0 THEN 0 WHEN kind = 'code' THEN 1 ELSE 2 END AS priority FROM chunks", common=False)
def prioritised_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the question, then of the kind, then the rest."""
    rows = _chunks(spark, d).select("chunk_id", "vec_id", "kind")
    return vectors.prioritised(rows.where("vec_id % 5 = 0"), rows.where("kind = 'code'"), rows).select("chunk_id", "priority")


@R.add("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_partkey || '-shared/' WHEN p_size % 4 = 1 THEN p_partkey || '-shared/codes.md' ELSE p_partkey || '-trees/' || (CASE WHEN p_size % 2 = 0 THEN 'policy' ELSE 'statute' END) END AS key FROM part", common=False)
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """H17."""
    size = F.col("p_size")
    kind = F.when(size % 4 < 2, F.lit(None)).when(size % 2 == 0, "policy").otherwise("statute")
    file = F.when(size % 4 == 1, "codes.md")
    return t.table(spark, d, "part").select("p_partkey", vectors.document_key(F.col("p_partkey").cast("string"), F.array(F.lit("trees")), kind, file).alias("key"))


def _rulesets(spark: SparkSession, d: str) -> DataFrame:
    """A ruleset a part with two sources, made up of its fields."""
    s = lambda url, title, kind: F.struct(url.alias("source_url"), title.alias("title"), kind.alias("type"))
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, "statute").when(F.col("p_size") % 3 == 1, "code").otherwise("guidance")
    one, two = s(F.concat(F.lit("https://a.org/"), k, F.lit("/#x")), F.col("p_name"), F.lit("general")), s(F.concat(F.lit("https://b.org/"), k % 10, F.lit("/")), F.col("p_brand"), kind)
    return t.table(spark, d, "part").select("p_partkey", F.array(one, two).alias("sources"))


@R.add("""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'https://b.org/' || (p_partkey % 10) || '/' END AS primary_url, CASE WHEN p_partkey % 10 = 3 THEN 'https://a.org/' || p_partkey || '/#x https://b.org/3' ELSE 'https://b.org/3 https://a.org/' || p_partkey || '/#x https://b.org/' || (p_partkey % 10) || '/' END AS upserted,
  (1 + CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END)::INTEGER AS n_removed FROM part""", common=False)
def ruleset_sources(spark: SparkSession, d: str) -> DataFrame:
    """B05, B06, B29, C34."""
    new = F.struct(F.lit("https://b.org/3").alias("source_url"), F.lit("New").alias("title"), F.lit("form").alias("type"))
    rows = sources.without_types(_rulesets(spark, d).withColumn("all", F.col("sources")), ("general", "guidance"))
    urls_of = F.array_join(F.transform(sources.upserted(F.col("all"), new), lambda x: x["source_url"]), " ")
    return rows.select("p_partkey", sources.primary_source(F.col("all"), "statute")["source_url"].alias("primary_url"), urls_of.alias("upserted"), "n_removed")


@R.add("""SELECT coalesce(n.url, o.url) AS url, coalesce(n.title, o.title) AS title
FROM (SELECT DISTINCT url, 'old' AS title FROM hist WHERE entity_id < 20) o FULL JOIN (SELECT DISTINCT url, 'new' AS title FROM hist WHERE entity_id >= 20) n ON n.url = o.url""")
def upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    """A55."""
    rows = _history(spark, d)
    old, new = rows.where("entity_id < 20").select("url", F.lit("old").alias("title")).distinct(), rows.where("entity_id >= 20").select("url", F.lit("new").alias("title")).distinct()
    return versions.override(old, new, ["url"])


@R.add("""SELECT DISTINCT url, 'old' AS title FROM hist WHERE entity_id < 20 UNION ALL SELECT DISTINCT url, 'history' FROM hist WHERE entity_id >= 20 AND url NOT IN (SELECT url FROM hist WHERE entity_id < 20)""")
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """C17, G03."""
    rows = _history(spark, d)
    old, new = rows.where("entity_id < 20").select("url", F.lit("old").alias("title")).distinct(), rows.where("entity_id >= 20").select("url", F.lit("history").alias("title")).distinct()
    return history.merged_sources(old, new, ["url"])


@R.add("SELECT url FROM hist WHERE entity_id < 20 INTERSECT SELECT url FROM hist WHERE entity_id >= 20 EXCEPT SELECT url FROM hist WHERE status = '404'")
def menu_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of both pages without those that are known to fail."""
    rows = _history(spark, d)
    return rows.where("entity_id < 20").select("url").intersect(rows.where("entity_id >= 20").select("url")).exceptAll(rows.where("status = '404'").select("url").distinct())


CELLS = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "flag")
CELLS_SQL = """cells AS (SELECT c_custkey AS row_id, unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment', 'flag']) AS "column", unnest([c_custkey::VARCHAR, c_name, (c_custkey % 977)::VARCHAR || ' USD', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END]) AS value FROM customer)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    k = F.col("c_custkey")
    wide = c.select(k.alias("row_id"), k.cast("string").alias("c_custkey"), "c_name", F.concat((k % 977).cast("string"), F.lit(" USD")).alias("c_acctbal"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 2 == 0, "Yes").otherwise("no").alias("flag"))
    return wide.unpivot("row_id", list(CELLS), "column", "value")


@R.add(f"""WITH {CELLS_SQL} SELECT "column", count(*)::BIGINT AS n, CASE "column" WHEN 'c_custkey' THEN 'number' WHEN 'c_acctbal' THEN 'number' WHEN 'flag' THEN 'boolean' ELSE 'string' END AS type FROM cells WHERE trim(value) <> '' GROUP BY 1""", common=False)
def column_types(spark: SparkSession, d: str) -> DataFrame:
    """H45."""
    return datadomain.column_types(_cells(spark, d))


@R.add(f"""WITH {CELLS_SQL} SELECT row_id, "column", CASE WHEN "column" IN ('c_custkey', 'c_acctbal') THEN regexp_extract(value, '^\\d+')::DOUBLE END AS num, CASE WHEN "column" = 'flag' THEN lower(value) = 'yes' END AS bool, CASE WHEN "column" IN ('c_name', 'c_mktsegment') THEN nullif(value, '') END AS str FROM cells""", common=False)
def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    """A57, H45."""
    cells = _cells(spark, d)
    return datadomain.typed_cells(cells, datadomain.column_types(cells)).select("row_id", "column", "num", "bool", "str")


@R.add("""SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 = 0 THEN 'us-' || 'nobody' || c_custkey WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'us-' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') ELSE c_custkey::VARCHAR END AS entity_id FROM customer""", common=False)
def sheet_entities(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet by name and type; a quarter is unknown, some have another type."""
    c, k = t.table(spark, d, "customer"), F.col("c_custkey")
    known = c.select(k.alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    kind = F.when((k % 4 == 1) & (k % 3 == 0), "Other").when(k % 2 == 0, "").otherwise(F.lower("c_mktsegment"))
    rows = c.select(k.alias("row_id"), F.when(k % 4 == 0, F.concat(F.lit("No body "), k)).otherwise(F.upper("c_name")).alias("name"), kind.alias("type"))
    return datadomain.matched_rows(rows, known, "us-")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, of one file or a folder of files: as a pattern, for Spark takes no plain path of a file here."""
    return spark.readStream.schema(t.table(spark, d, name).schema).parquet(f"{d.rstrip('/')}/{name}.parque[t]")


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    place = folders.shared(spark)
    return incremental.run_available(stream, mode, f"{place}/out", f"{place}/log")


@R.add("SELECT strftime(to_timestamp(epoch_us(ts) // 60000000 * 60), '%Y-%m-%d %H:%M:%S') AS start, event_type AS model, count(*)::BIGINT AS n, floor(sum(value) * 100 + 0.5) / 100 AS tokens FROM events GROUP BY epoch_us(ts) // 60000000, 2".replace("to_timestamp(epoch_us(ts) // 60000000 * 60)", "make_timestamp(epoch_us(ts) // 60000000 * 60000000)"), common=False)
def stream_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """I03, as a stream."""
    events = _stream(spark, d, "events").select(F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("tokens"))
    out = _finished(spark, incremental.token_windows(events), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "model", "n", (F.floor(F.col("tokens") * 100 + 0.5) / 100).alias("tokens"))


@R.add("""SELECT regexp_extract(url, '://([^/?#:]*)', 1) AS host, 'footer' AS zone, 'footer' AS selector, count(*)::BIGINT AS votes FROM pages WHERE regexp_matches(html, '(?i)<footer[\\s>]') GROUP BY 1""", common=False)
def stream_host_votes(spark: SparkSession, d: str) -> DataFrame:
    """I02, as a stream; the synthetic pages have footers alone."""
    return _finished(spark, incremental.host_vote_counts(_stream(spark, d, "pages").select("url", "html")), "complete")


@R.add("SELECT entity_id, url, status FROM (SELECT entity_id, url, max_by(status, (ts, position)) AS status FROM (SELECT user_id % 40 AS entity_id, 'u' || (event_id % 25) AS url, event_type AS status, ts, event_id AS position FROM events) GROUP BY 1, 2)", common=False)
def stream_latest_records(spark: SparkSession, d: str) -> DataFrame:
    """I06, as a stream: the newest by event time."""
    events = _stream(spark, d, "events").select((F.col("user_id") % 40).alias("entity_id"), F.concat(F.lit("u"), F.col("event_id") % 25).alias("url"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("position"))
    return _finished(spark, incremental.latest_records(events), "complete").select("entity_id", "url", "status")


@R.add("SELECT DISTINCT user_id % 40 AS entity_id, 'u' || (event_id % 25) AS url FROM events", common=False)
def stream_first_visits(spark: SparkSession, d: str) -> DataFrame:
    """I01, as a stream: one visit of each url, as all fall in one batch."""
    events = _stream(spark, d, "events").select((F.col("user_id") % 40).alias("entity_id"), F.concat(F.lit("u"), F.col("event_id") % 25).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    return _finished(spark, incremental.first_visits(events), "append").select("entity_id", "url").distinct()
