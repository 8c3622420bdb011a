"""Queries on maintenance: indexing, classification, recomputed scores, mended tables and stored orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import text, urls
from quorumlake.functions import time as times
from quorumlake.operators import history, lookup, pages, scoring, sources, upkeep
from quorumlake.plans import history_queries, text_queries
from quorumlake.plans.registry import Registry
from quorumlake.providers import models
from quorumlake.sources import folders
from quorumlake.sources import tables as t
from quorumlake.streaming import incremental

R = Registry(t.CIVIC_SQL)
H = history_queries.HISTORY_SQL


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents")


@R.add("""SELECT d.domain_id, count(q.question_id)::BIGINT AS n_questions, coalesce(sum(q.weight), 0)::BIGINT AS total_weight, coalesce(string_agg(q.question_id, ',' ORDER BY q.question_id), '') AS questions
FROM domains d LEFT JOIN questions q ON q.domain_id = d.domain_id GROUP BY 1""")
def domain_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every domain with its questions."""
    out = upkeep.domain_questions(t.domains(spark, d), t.questions(spark, d))
    return out.select("domain_id", "n_questions", "total_weight", F.array_join("questions", ",").alias("questions"))


@R.add("""SELECT a.entity_id, a.domain_id, count(*)::BIGINT AS n_questions, count(*) FILTER (s.answer IS NULL)::BIGINT AS n_open, sum(q.weight)::BIGINT AS total_weight
FROM (SELECT * FROM analyses WHERE version = 1) a JOIN questions q ON q.domain_id = a.domain_id LEFT JOIN (SELECT * FROM answers WHERE version = 1) s ON s.entity_id = a.entity_id AND s.domain_id = a.domain_id AND s.question_id = q.question_id GROUP BY 1, 2""")
def entity_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of a domain with an entity's answers, and how many of them are open."""
    rows = scoring.questionnaire(t.analyses(spark, d).where("version = 1"), t.questions(spark, d), t.answers(spark, d, current=True))
    return rows.groupBy("entity_id", "domain_id").agg(F.count("*").alias("n_questions"), F.count_if(F.col("answer") == "Not analyzed").alias("n_open"), F.sum("weight").alias("total_weight"))


@R.add("""SELECT a.entity_id, a.domain_id, CASE WHEN n IS NULL THEN 'skipped' ELSE 'scored' END AS state, coalesce(n, 0)::BIGINT AS n_answers FROM (SELECT * FROM analyses WHERE version = 1) a
LEFT JOIN (SELECT entity_id, domain_id, count(*) AS n FROM answers WHERE version = 1 GROUP BY 1, 2) s ON s.entity_id = a.entity_id AND s.domain_id = a.domain_id""")
def rescored_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Scores made anew; the values themselves are those of normalized_score."""
    given = t.answers(spark, d, current=True)
    stored = t.analyses(spark, d).where("version = 1").withColumn("overall_score", F.lit(-1.0))
    out = upkeep.rescored(stored, given, t.questions(spark, d))
    n = given.groupBy("entity_id", "domain_id").agg(F.count("*").alias("n"))
    return out.join(n, upkeep.KEY, "left").select("entity_id", "domain_id", F.when(F.col("state") == "skipped", "skipped").otherwise("scored").alias("state"), F.coalesce("n", F.lit(0)).alias("n_answers"))


@R.add("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'G+' WHEN o_custkey % 4 = 1 THEN 'R' WHEN o_custkey % 4 = 2 THEN 'old' ELSE 'Y' END AS grade FROM orders""", common=False)
def copied_grades(spark: SparkSession, d: str) -> DataFrame:
    """The cell's code, the grade field, or what was there."""
    o, k = t.table(spark, d, "orders"), F.col("o_custkey") % 4
    key = [F.col("o_orderkey").alias("entity_id"), F.lit("trees").alias("domain_id")]
    rules = o.select(*key, F.when(k == 0, "g+ - good").when(k == 2, "none").otherwise("").alias("cell"), F.when(k == 1, "R").when(k == 3, "Y").alias("grade"))
    out = upkeep.with_grades(o.select(*key, F.create_map(F.lit("wei"), F.lit("old")).alias("grades")), rules, "wei")
    return out.select(F.col("entity_id").alias("o_orderkey"), F.element_at("grades", "wei").alias("grade"))


@R.add("""SELECT vec_id % 20 AS document, count(*)::BIGINT AS n, min(vec_id) AS first_chunk FROM embeddings WHERE label = 3 GROUP BY 1""", common=False)
def chunks_of_url(spark: SparkSession, d: str) -> DataFrame:
    """all chunks of each document's address, in order of their index."""
    v = F.col("vec_id")
    address = lambda n: F.concat(F.lit("https://Site.org/doc/"), n)
    rows = t.table(spark, d, "embeddings").select(v.cast("string").alias("chunk_id"), F.col("label").alias("entity_id"), F.array(F.lit("trees"), F.lit("noise")).alias("domain_ids"), F.concat(address(v % 20), F.lit("/?q=1")).alias("url"), v.alias("chunk_index"))
    asked = spark.range(20).select(F.lit(3).alias("entity_id"), F.lit("noise").alias("domain_id"), address(F.col("id")).alias("url"))
    out = upkeep.chunks_of_url(rows, asked)
    return out.groupBy((F.col("chunk_index") % 20).alias("document")).agg(F.max("n").cast("long").alias("n"), F.min_by("chunk_index", "n").alias("first_chunk"))


@R.add(f"""WITH {H}, f AS (SELECT entity_id, 'f' || (position % 50) AS file, min_by(struct_pack(url := url, ts := ts, pos := position), position) AS r FROM hist GROUP BY 1, 2),
dl AS (SELECT DISTINCT entity_id, 'f' || (position % 60) AS file, (position % 60) % 5 AS k FROM hist), m AS (SELECT max(ts) AS now FROM events)
SELECT dl.entity_id, dl.file, CASE WHEN k = 0 THEN 'no domain' WHEN f.r.ts IS NOT NULL AND epoch_us(f.r.ts) < epoch_us(m.now) - 36 * 3600000000 THEN 'old' WHEN f.r.pos % 7 = 0 THEN 'pdf' WHEN k = 1 THEN 'indexed' ELSE 'index' END AS decision
FROM dl CROSS JOIN m LEFT JOIN f ON f.entity_id = dl.entity_id AND f.file = dl.file""", common=False)
def index_plan(spark: SparkSession, d: str) -> DataFrame:
    """What happens to each download of each entity."""
    rows = history_queries._history(spark, d)
    records = rows.select("entity_id", "url", "ts", "position", F.lit(None).cast("string").alias("text_file"), F.concat(F.lit("a/b/f"), F.col("position") % 50).alias("file"), F.when(F.col("position") % 7 == 0, "PDF").otherwise("HTML").alias("file_type"))
    mine = rows.select("entity_id", F.concat(F.lit("f"), F.col("position") % 60).alias("file"), (F.col("position") % 60 % 5).alias("k")).distinct()
    now = t.table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    met = upkeep.downloads_with_history(mine, records).crossJoin(F.broadcast(now))  # one row
    decision = upkeep.index_decision(F.when(F.col("k") == 0, 0).otherwise(1), F.col("ts"), F.col("as_of"), 36, F.col("file_type"), F.col("url"), F.col("k") == 1)
    return met.select("entity_id", "file", decision.alias("decision"))


INDEX_SQL = r"regexp_matches(lower({0}), '\b(index|table of contents|contents|sitemap|directory)\b')"


@R.add(f"""SELECT doc_id, {INDEX_SQL.format("source || ' ' || CASE WHEN doc_id % 9 = 0 THEN 'Site Directory' WHEN doc_id % 9 = 1 THEN 'indexes' ELSE 'x' END")} OR doc_id % 45 >= 40 AS is_index FROM documents""", common=False)
def index_pages(spark: SparkSession, d: str) -> DataFrame:
    """By marker and by links; the text's density is held by capital_words."""
    n = F.col("doc_id") % 9
    title = F.when(n == 0, "Site Directory").when(n == 1, "indexes").otherwise("x")
    return _docs(spark, d).select("doc_id", upkeep.index_page(F.col("source"), title, F.lit(""), F.col("doc_id") % 45).alias("is_index"))


@R.add("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'index' WHEN p_size % 4 = 1 THEN 'related' ELSE 'unrelated' END AS status FROM part""", common=False)
def link_classes(spark: SparkSession, d: str) -> DataFrame:
    """Links by their text: of a domain with and without signs of an index, of none."""
    n = F.col("p_size") % 4
    told = F.when(n == 0, "Tree planting boards").when(n == 1, "Tree planting rules").when(n == 2, "Boards").otherwise("Contact")
    links = t.table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit("https://a.org/x").alias("url"), told.alias("text"))
    keywords = spark.createDataFrame([("trees", "specific", "tree"), ("trees", "specific", "planting")], "domain_id string, type string, keyword string")
    return upkeep.classified_links(links, keywords).select(F.col("page_id").alias("p_partkey"), "status")


@R.add(f"""WITH {text_queries.PAGE_SCORES_SQL}, new AS (SELECT doc_id AS page_id, coalesce(string_agg(domain_id, ',' ORDER BY domain_id), '') AS ids FROM documents LEFT JOIN scored ON page_id = doc_id AND match >= 4 GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'parks' ELSE '' END AS old_ids, ids AS new_ids FROM new WHERE CASE WHEN page_id % 2 = 0 THEN 'parks' ELSE '' END <> ids""", common=False)
def rescored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose domains change when they are scored again."""
    old = _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("parks"))).otherwise(F.array().cast("array<string>")).alias("domain_ids"))
    out = upkeep.changed_domains(old, text_queries._scored(spark, d))
    return out.select("page_id", F.array_join("domain_ids", ",").alias("old_ids"), F.array_join("new_ids", ",").alias("new_ids"))


@R.add("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NewPark' WHEN 1 THEN 'OldPark' WHEN 2 THEN 'RedHook' ELSE 'Lone-Hill' END AS name, CASE p_size % 4 WHEN 0 THEN 'Town' WHEN 1 THEN 'Village' WHEN 2 THEN 'City' END AS type,
  CASE WHEN p_size % 2 = 0 THEN 'Town' ELSE 'CityHall' END AS plain FROM part""", common=False)
def name_cells(spark: SparkSession, d: str) -> DataFrame:
    """H09."""
    n = F.col("p_size") % 4
    cell = F.when(n == 0, "New Park (Town/Village)").when(n == 1, "Old Park village ").when(n == 2, "Red Hook City").otherwise("Lone-Hill!")
    return t.table(spark, d, "part").select("p_partkey", upkeep.name_and_type(cell).alias("x"), upkeep.plain_type(F.when(n % 2 == 0, " Town/Village").otherwise("City Hall ")).alias("plain")).select("p_partkey", "x.name", "x.type", "plain")


@R.add("""SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE substr(text, 1, 700) || chr(10) || chr(10) || '[Text truncated to fit context limit...]' END AS cut FROM documents""", common=False)
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """H14."""
    return _docs(spark, d).select("doc_id", upkeep.truncated(F.col("text"), 200).alias("cut"))


@R.add(f"""WITH {H} SELECT entity_id, url, row_number() OVER (PARTITION BY entity_id ORDER BY contains(url, 'parks') DESC, length(url), position)::INTEGER AS n FROM hist""", common=False)
def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """priority first, then by depth, then as they came."""
    rows = history_queries._history(spark, d)
    return upkeep.numbered(rows, ["entity_id"], [F.contains("url", F.lit("parks")).desc(), F.length("url"), F.col("position")]).select("entity_id", "url", "n")


@R.add("""SELECT e.entity_id, s.domain_id, row_number() OVER (PARTITION BY s.domain_id ORDER BY s.n DESC, e.entity_id)::INTEGER AS n FROM entities e JOIN (SELECT entity_id, domain_id, count(*) AS n FROM analyses GROUP BY 1, 2) s ON s.entity_id = e.entity_id""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """places of a report, the highest first, equals by id."""
    rows = t.analyses(spark, d).groupBy("entity_id", "domain_id").agg(F.count("*").alias("score"))
    return upkeep.numbered(rows, ["domain_id"], [F.desc("score"), F.col("entity_id")]).select("entity_id", "domain_id", "n")


@R.add("""SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, s_name)::INTEGER AS n, row_number() OVER (ORDER BY s_name DESC)::INTEGER AS back FROM supplier""", common=False)
def stored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Order of drawing, by name inside, and backups from the last to the first."""
    n = F.col("s_suppkey") % 4
    rows = t.table(spark, d, "supplier").withColumn("kind", F.when(n == 1, "Town").when(n == 2, "City").when(n == 0, "Village").otherwise("Park")).withColumn("one", F.lit(1))
    rows = upkeep.numbered(rows, ["s_nationkey"], [upkeep.size_rank(F.col("kind")), F.collate("s_name", "UNICODE")])
    return upkeep.numbered_everywhere(rows.drop("one"), [F.desc("s_name"), F.col("s_suppkey")], folders.shared(spark), "back").select("s_suppkey", "n", F.col("back").cast("int").alias("back"))


@R.add(f"""WITH {H} SELECT entity_id, count(*)::BIGINT AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM (SELECT DISTINCT entity_id, url FROM log) GROUP BY 1""", common=False)
def distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    """The distinct addresses of an entity, sorted."""
    rows = history_queries._history(spark, d).select("entity_id", "url").distinct()
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("url")), " ").alias("urls"))


@R.add("""WITH x AS (SELECT p_brand AS domain_id, p_partkey AS pos, 0 AS k, 'size ' || p_size AS fact FROM part UNION ALL SELECT p_brand, p_partkey, 1, p_type FROM part), f AS (SELECT domain_id, fact, min((pos, k)) AS first FROM x GROUP BY 1, 2)
SELECT domain_id, string_agg(fact, '; ' ORDER BY first) AS facts FROM f GROUP BY 1""", common=False)
def highlights(spark: SparkSession, d: str) -> DataFrame:
    """D27."""
    rows = t.table(spark, d, "part").select(F.col("p_brand").alias("domain_id"), F.col("p_partkey").alias("position"), F.array(F.concat(F.lit("size "), "p_size"), F.col("p_type")).alias("facts"))
    return upkeep.highlights(rows).select("domain_id", F.array_join("facts", "; ").alias("facts"))


@R.add("""SELECT source AS entity_id, count(*) FILTER (contains(text, 'the '))::BIGINT AS n_changed, count(*) FILTER (NOT contains(text, 'the '))::BIGINT AS n_same, sum(strlen(text) - strlen(replace(text, 'the ', '')))::BIGINT AS bytes_saved FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1""", common=False)
def rewrite_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a rewrite of texts changed."""
    rows = _docs(spark, d).where("text IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("entity_id"), F.col("doc_id").alias("file"), F.col("text").alias("body"))
    return upkeep.rewrite_totals(rows, rows.withColumn("body", F.replace("body", F.lit("the "), F.lit(""))))


@R.add(f"""WITH {H} SELECT h.entity_id, h.url, c.c_name || ' ' || h.position AS title FROM hist h LEFT JOIN customer c ON c.c_custkey = h.entity_id AND h.position % 2 = 0""", common=False)
def source_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title of each entity's address, null where none is stored."""
    rows = history_queries._history(spark, d)
    names = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    titles = rows.where("position % 2 = 0").join(names, "entity_id").select("entity_id", "url", F.concat("c_name", F.lit(" "), "position").alias("title"))
    return rows.select("entity_id", "url").join(titles, ["entity_id", "url"], "left")


@R.add(f"""WITH {H} SELECT entity_id, count(*)::BIGINT AS n, string_agg(url, ' ' ORDER BY url) AS texts FROM hist WHERE status = 'related' AND list_contains(domain_ids, 'noise') GROUP BY 1""", common=False)
def additional_sources(spark: SparkSession, d: str) -> DataFrame:
    """What related downloads of a domain hold, together."""
    rows = history_queries._history(spark, d).where((F.col("status") == "related") & F.array_contains("domain_ids", "noise"))
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("url")), " ").alias("texts"))


@R.add("""SELECT c_custkey AS entity_id, 'www.a' || c_nationkey || '.org' AS host, 'https://www.a' || c_nationkey || '.org/' || CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS url FROM customer""", common=False)
def website_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Maps of hosts and older lists of addresses in one form."""
    host, even = F.concat(F.lit("www.a"), F.col("c_nationkey"), F.lit(".org")), F.col("c_custkey") % 2 == 0
    sites = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(even, F.create_map(host, F.concat(F.lit("https://"), host, F.lit("/new")))).alias("hosts"), F.when(~even, F.array(F.concat(F.lit("https://"), host, F.lit("/old")))).alias("urls"))
    return upkeep.first_hosts(sites)


@R.add("""SELECT doc_id AS entity_id, source AS url, length(trim(text, ' '))::INTEGER AS n_chars, substr(trim(text, ' '), 1, 300) AS sample FROM documents WHERE text IS NOT NULL""", common=False)
def cached_pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages without their header line, and a sample."""
    docs = _docs(spark, d).where("text IS NOT NULL")
    made = docs.select(F.col("doc_id").alias("entity_id"), F.lit("f").alias("file"), text.artifact(F.lit("https://a"), F.lit("2024"), F.lit("2025"), F.col("text")).alias("content"))
    return upkeep.cached_pages(docs.select(F.col("doc_id").alias("entity_id"), F.col("source").alias("url"), F.lit("f").alias("file")), made, 300)


@R.add("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Red Hook' WHEN s_suppkey % 3 = 1 THEN 'Athens' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Town' WHEN s_suppkey % 3 = 1 THEN 'Village' END AS type FROM supplier""", common=False)
def folder_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the names of their folders."""
    n = F.col("s_suppkey") % 3
    name = F.when(n == 0, "NY-RedHook-Town").when(n == 1, "NY-Athens-Village").otherwise("notes")
    return t.table(spark, d, "supplier").select("s_suppkey", upkeep.folder_entity(name, "NY-").alias("x")).select("s_suppkey", "x.name", "x.type")


@R.add("""SELECT DISTINCT 'NY-' || 'NATION' || n_nationkey || '-Town' AS entity_id, 'NATION' || n_nationkey AS name, 'Town' AS type, 'NY' AS state FROM nation WHERE n_nationkey % 5 <> 0""", common=False)
def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet as entities, without notes."""
    k = F.col("n_nationkey")
    cells = t.table(spark, d, "nation").select(F.when(k % 10 == 0, "Key: colours").when(k % 10 == 5, " Environmental rules").otherwise(F.concat(F.col("n_name"), F.lit(" (Town/Village)"))).alias("cell"))
    return upkeep.entity_rows(cells, "NY")


@R.add("""SELECT n_name AS model, CASE WHEN n_nationkey % 3 = 0 THEN 30000 ELSE n_nationkey * 1000 END::BIGINT AS tokens_per_minute, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS buffer,
  floor(CASE WHEN n_nationkey % 3 = 0 THEN 30000 ELSE n_nationkey * 1000 END * CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE)::BIGINT AS usable FROM nation""", common=False)
def model_settings(spark: SparkSession, d: str) -> DataFrame:
    """A40."""
    k = F.col("n_nationkey")
    config = t.table(spark, d, "nation").select(F.col("n_name").alias("model"), F.when(k % 3 != 0, k * 1000).cast("long").alias("tokens_per_minute"), F.when(k % 2 == 0, 0.5).otherwise(7.0).alias("buffer"))
    return upkeep.model_settings(config, {"tokens_per_minute": 30000, "buffer": 0.8})


@R.add("""SELECT page_id, CASE WHEN contains(lower(url), 'blog') THEN 'blogs' WHEN contains(lower(url), '/de/') THEN 'german' END AS library, page_id % 4 <> 1 AND page_id % 4 <> 2 AS usable FROM pages""", common=False)
def library_urls(spark: SparkSession, d: str) -> DataFrame:
    """B36."""
    n = F.col("page_id") % 4
    told = F.when(n == 0, " N/A ").when(n == 1, "soon").otherwise(F.lit("https://a.org"))
    return t.table(spark, d, "pages").select("page_id", upkeep.first_library(F.col("url"), (("blogs", "BLOG"), ("german", "/de/"))).alias("library"), upkeep.usable_url(told, n != 2).alias("usable"))


@R.add("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'had' WHEN page_id % 2 = 0 THEN url END AS kept, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN 'had' ELSE '' END AS forced FROM pages""", common=False)
def filled_urls(spark: SparkSession, d: str) -> DataFrame:
    """B39."""
    old, ok = F.when(F.col("page_id") % 3 == 0, "had").otherwise(""), F.col("page_id") % 2 == 0
    return t.table(spark, d, "pages").select("page_id", upkeep.filled_url(old, F.col("url"), ok).alias("kept"), upkeep.filled_url(old, F.col("url"), ok, force=True).alias("forced"))


@R.add("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, epoch_us(now) - epoch_us(ts) <= 7 * 86400000000 AS menu_due, epoch_us(now) - epoch_us(ts) < 86400000000 AS fresh FROM events, m""", common=False)
def menu_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Menu links of seven days at most, and records younger than a day."""
    e = t.table(spark, d, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("as_of"))))  # one row
    return rows.select("event_id", upkeep.menu_due(F.col("ts"), F.col("as_of")).alias("menu_due"), times.fresh(F.col("ts"), F.col("as_of"), times.seconds_of(F.lit("1d"))).alias("fresh"))


@R.add("""SELECT p_partkey AS row, p_size AS col, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.org/' || p_partkey WHEN p_partkey % 3 = 0 THEN 'https://b.org/' || p_partkey END AS url FROM part""", common=False)
def cell_addresses(spark: SparkSession, d: str) -> DataFrame:
    """C10."""
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    cells = p.select(k.alias("row"), F.col("p_size").alias("col"), F.when(k % 2 == 0, F.concat(F.lit("see https://a.org/"), k)).otherwise("see it").alias("value"))
    laid = p.where("p_partkey % 3 = 0").select((k + 1).alias("row"), F.col("p_size").alias("col"), F.concat(F.lit("https://b.org/"), k).alias("url"))
    return upkeep.cell_address(cells, laid).drop("value")


@R.add(f"""WITH {H} SELECT doc_id AS entity_id, 'u' || doc_id AS url, 'f' || doc_id AS file FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0""", common=False)
def recovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that no record names by address (every third) or by file (every fifth)."""
    key = F.col("doc_id")
    files = _docs(spark, d).select(key.alias("entity_id"), F.concat(F.lit("u"), key).alias("url"), F.concat(F.lit("f"), key).alias("file"))
    known = files.withColumn("url", F.when(F.col("entity_id") % 3 == 0, F.col("url"))).withColumn("file", F.when(F.col("entity_id") % 5 == 0, F.col("file")))
    return upkeep.recovered(files, known)


@R.add("""SELECT c_custkey AS feature_id, c_custkey AS entity_id, CASE WHEN c_custkey % 5 = 0 THEN '#111111' WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN '#94a3b8' WHEN c_custkey % 2 = 0 THEN '#222222' ELSE '#cccccc' END AS colour FROM customer""", common=False)
def feature_colours(spark: SparkSession, d: str) -> DataFrame:
    """C22."""
    k = F.col("entity_id")
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("feature_id"), F.col("c_custkey").alias("entity_id"))
    summary = people.where("entity_id % 2 = 0").select("entity_id", (k % 7 == 0).alias("state_code"), F.lit("#222222").alias("colour"))
    return upkeep.feature_colours(people, summary, people.where("entity_id % 5 = 0").select("entity_id", F.lit("#111111").alias("colour")))


@R.add("""SELECT n_name AS domain_id, CASE WHEN n_nationkey % 2 = 0 THEN 'config' WHEN n_nationkey % 3 = 0 THEN 'own' END AS scoring FROM nation""", common=False)
def scored_data(spark: SparkSession, d: str) -> DataFrame:
    """C26."""
    n = t.table(spark, d, "nation")
    data = n.select(F.col("n_name").alias("domain_id"), F.when(F.col("n_nationkey") % 3 == 0, "own").alias("scoring"))
    return upkeep.with_scoring(data, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("domain_id"), F.lit("config").alias("scoring")))


@R.add("""SELECT doc_id, 'https://locus.invalid/' || doc_id AS source_url FROM documents WHERE length(text) >= 200 AND doc_id % 3 <> 0 AND doc_id % 90 >= 60""", common=False)
def relevant_ordinances(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of some length that the judge keeps, as sources that a ruleset doesn't have yet."""
    judged = _docs(spark, d).select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % 3 != 0).alias("is_relevant"), (F.col("doc_id") % 90).cast("double").alias("confidence"))
    kept = upkeep.relevant(judged).withColumn("new", F.struct(F.concat(F.lit("https://locus.invalid/"), "doc_id").alias("source_url"), F.lit("t").alias("title"), F.lit("statute").alias("type")))
    ruleset = F.array(F.struct(F.lit("https://old.org/").alias("source_url"), F.lit("t").alias("title"), F.lit("statute").alias("type")))
    return kept.select("doc_id", sources.upserted(ruleset, F.col("new"))[0]["source_url"].alias("source_url"))


@R.add("""SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rank)::INTEGER AS n FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents WHERE lang IS NOT NULL) WHERE rank <= 15 AND doc_id % 2 = 0 QUALIFY n <= 5""", common=False)
def post_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The best hits first, the wish after them."""
    hits = upkeep.numbered(_docs(spark, d).where("lang IS NOT NULL").select(F.col("lang").alias("query_id"), "doc_id"), ["query_id"], [F.col("doc_id")], "rank")
    return upkeep.post_filtered(hits, F.col("doc_id") % 2 == 0, 5).select("query_id", "doc_id", "n")


@R.add(f"""WITH h AS (SELECT page_id % 10 AS host, url, length(html) AS score FROM pages) SELECT host, url AS selector, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) AS n FROM (SELECT DISTINCT * FROM h)) WHERE n = 1""", common=False)
def best_selectors(spark: SparkSession, d: str) -> DataFrame:
    """the selector of the highest score of each host, the first of equals by name."""
    rows = t.table(spark, d, "pages").select((F.col("page_id") % 10).alias("host"), F.col("url").alias("selector"), F.length("html").alias("score")).distinct()
    return upkeep.numbered(rows, ["host"], [F.desc("score"), F.col("selector")]).where("n = 1").select("host", "selector", "score")


@R.add("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'briar,cliff' WHEN 1 THEN 'tarry' ELSE '' END AS tokens, p_size % 3 = 0 AS affiliate, CASE WHEN p_size % 2 = 0 THEN 'NY' END AS state FROM part""", common=False)
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    """H51."""
    n = F.col("p_size") % 3
    words = upkeep.name_tokens(F.when(n == 0, "Briar-Cliff Manor, Briar").when(n == 1, "Village of Tarry").otherwise("The Bay"))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(words, ",").alias("tokens"), upkeep.affiliate(F.lit("www.BriarTown.org"), words).alias("affiliate"), upkeep.state_of_id(F.when(F.col("p_size") % 2 == 0, "ny-X-Town").otherwise("X-Town")).alias("state"))


@R.add("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://a.org/' || p_partkey || ' http://b.org' ELSE '' END AS urls, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS n FROM part""", common=False)
def restored_urls(spark: SparkSession, d: str) -> DataFrame:
    """H55."""
    found = upkeep.urls_of_cell(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("G (https://a.org/"), "p_partkey", F.lit("); http://b.org, x"))).otherwise("none"))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: x["source_url"]), " ").alias("urls"), F.size(found).alias("n"))


@R.add("""SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'main=m,code=c' || c_custkey ELSE 'code=had' END AS links FROM customer""", common=False)
def migrated_links(spark: SparkSession, d: str) -> DataFrame:
    """Flat addresses as links, where there is none of their type."""
    k = F.col("c_custkey")
    had = F.when(k % 2 == 1, F.array(F.struct(F.lit("code").alias("type"), F.lit("had").alias("url")))).otherwise(F.array().cast("array<struct<type:string,url:string>>"))
    rows = t.table(spark, d, "customer").select(k.alias("entity_id"), had.alias("links"), F.when(k % 2 == 0, "m").otherwise("").alias("mainUrl"), F.concat(F.lit("c"), k).alias("codeUrl"))
    out = upkeep.migrated_links(rows, {"mainUrl": "main", "codeUrl": "code"})
    return out.select("entity_id", F.array_join(F.transform("links", lambda x: F.concat(x["type"], F.lit("="), x["url"])), ",").alias("links"))


@R.add("""SELECT r_regionkey AS realm_id, CASE WHEN r_regionkey % 2 = 0 THEN 'policy' ELSE 'statute' END AS rule_type, CASE WHEN r_regionkey % 3 = 0 THEN 'School districts' ELSE 'Municipalities' END AS label, r_regionkey = (SELECT min(r_regionkey) FROM region) AS is_default FROM region""", common=False)
def realm_terms(spark: SparkSession, d: str) -> DataFrame:
    """M19."""
    k = F.col("r_regionkey")
    return upkeep.realm_terms(t.table(spark, d, "region").select(k.alias("realm_id"), k.alias("position"), F.when(k % 2 == 0, "policy").otherwise("").alias("rule_type"), F.when(k % 3 == 0, "school").otherwise("town").alias("entity_type")))


@R.add("""SELECT domain_id, question_id, CASE WHEN question_id % 3 = 0 THEN 'fresh' ELSE 'old' END AS practice FROM questions""")
def partial_practices(spark: SparkSession, d: str) -> DataFrame:
    """An update of the stale questions alone."""
    q = t.questions(spark, d).select("domain_id", "question_id")
    return upkeep.scoped_practices(q.withColumn("practice", F.lit("old")), q.where("question_id % 3 = 0"), q.withColumn("practice", F.lit("fresh")))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS home FROM orders""", common=False)
def stored_rulesets(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are blank or can't be read count as none."""
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.concat(F.lit('{"home":'), "o_custkey", F.lit("}"))).when(k == 1, "  ").otherwise("{broken")
    read = F.when(F.length(F.trim(body)) > 0, F.from_json(body, "home long"))
    return t.table(spark, d, "orders").select("o_orderkey", read["home"].alias("home"))


@R.add(r"""SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title,
  CASE WHEN p_size % 2 = 0 THEN '"a ""b"", c"' ELSE 'plain' END AS field, CASE WHEN p_size % 2 = 0 THEN 'x\| y' ELSE 'x' END AS cell FROM part""", common=False)
def slugs_and_cells(spark: SparkSession, d: str) -> DataFrame:
    """H06, H19."""
    even = F.col("p_size") % 2 == 0
    return t.table(spark, d, "part").select(
        "p_partkey", urls.title_of_slug(F.replace("p_name", F.lit(" "), F.lit("_-"))).alias("title"), text.csv_field(F.when(even, 'a "b", c').otherwise("plain")).alias("field"), text.table_cell(F.when(even, "x|\ny").otherwise("x")).alias("cell")
    )


@R.add("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1 + 2 * 3.0 + 0.5 WHEN 1 THEN 1 + 3.5 + 1.5 ELSE 0.0 END::DOUBLE AS score FROM part""", common=False)
def boards_scores(spark: SparkSession, d: str) -> DataFrame:
    """H31."""
    n = F.col("p_size") % 3
    name = "conservation board"
    return t.table(spark, d, "part").select("p_partkey", pages.boards_score(
        F.when(n == 1, "https://a.org/conservation-board").otherwise("x"), F.when(n == 0, "Conservation Board and conservation  board").otherwise(""), F.when(n == 1, "CONSERVATION/BOARD").otherwise(""), F.when(n == 0, "the conservation board").otherwise("boards"), name).alias("score"))


@R.add(f"""WITH {H} SELECT h.entity_id, h.url, x.found FROM hist h JOIN (SELECT 'long title ' || (position % 30) AS title, min_by(url, position) AS found FROM hist GROUP BY 1) x ON x.title = 'long title ' || (h.position % 40)""", common=False)
def titled_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages and the first record of their title."""
    rows = history_queries._history(spark, d)
    seen = rows.select("entity_id", "url", F.concat(F.lit("Long Title "), F.col("position") % 40).alias("title"))
    return lookup.by_title(seen, rows.select("url", "position", F.concat(F.lit("long title "), F.col("position") % 30).alias("title"))).select("entity_id", "url", "found")


@R.add(r"""SELECT doc_id, doc_id % 3 = 0 AS control, doc_id % 6 = 0 AS early, CASE WHEN doc_id % 4 = 0 THEN 'form' ELSE 'general' END AS kind, CASE doc_id % 5 WHEN 0 THEN '404' WHEN 1 THEN 'blocked' WHEN 2 THEN 'timeout' ELSE 'no-content' END AS status FROM documents""", common=False)
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """B20, B30, B38."""
    k = F.col("doc_id")
    body = F.when(k % 6 == 0, F.lit("\x00abc")).when(k % 3 == 0, F.lit("abcdefgh\x01")).otherwise("abc")
    told = F.when(k % 5 == 0, "HTTP 404").when(k % 5 == 1, "Request blocked").when(k % 5 == 2, "ETIMEDOUT").otherwise("?")
    return _docs(spark, d).select("doc_id", text.has_control(body).alias("control"), text.has_control(body, 5).alias("early"), sources.inferred_type(F.lit("https://a"), F.when(k % 4 == 0, "Permit").otherwise("Law")).alias("kind"), history.error_status(told).alias("status"))


@R.add("""WITH l AS (SELECT user_id % 40 AS entity_id, 'u' || (event_id % 25) AS url, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1, 2) SELECT * FROM l WHERE last_ms + 21600000 < (SELECT max(epoch_us(ts) // 1000) FROM events) - 3600000""", common=False)
def stream_recrawls(spark: SparkSession, d: str) -> DataFrame:
    """I04, as a stream: addresses not visited for six hours when the watermark, an hour behind the last record, passes."""
    events = history_queries._stream(spark, d, "events").select((F.col("user_id") % 40).cast("long").alias("entity_id"), F.concat(F.lit("u"), F.col("event_id") % 25).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    return history_queries._finished(spark, incremental.due_recrawls(events, 0.25), "append")


@R.add("SELECT vec_id AS chunk_id, label, CASE WHEN vec_id % 2 = 0 THEN 'second' ELSE 'first' END AS body FROM embeddings", common=False)
def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of chunks, of which the second replaces a half of the first."""
    folder = folders.shared(spark)
    write = incremental.upsert_chunks(folder, "chunk_id")
    rows = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    write(rows.withColumn("body", F.lit("first")), 0)
    write(rows.where("chunk_id % 2 = 0").withColumn("body", F.lit("second")), 1)
    return incremental.read_upserted(spark, folder, "chunk_id").select("chunk_id", "label", "body")


@R.add("""SELECT entity_id, domain_id, count(*) || ' answers' AS summary FROM answers WHERE version = 1 GROUP BY 1, 2""")
def overall_summaries(spark: SparkSession, d: str) -> DataFrame:
    """K03, by a stand-in that counts what it was told."""
    return models.summaries(t.answers(spark, d, current=True).select("entity_id", "domain_id", "question_id", "answer", "score"), lambda p: f" {p.count('Q: ')} answers ")


@R.add(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain_id, question_id ORDER BY score DESC, entity_id) AS rank FROM answers WHERE version = 1)
SELECT domain_id, question_id, CASE WHEN question_id = 1 THEN '{t.NOT_IN_STATUTE}' ELSE 'Require ' || string_agg(entity_id, ' ' ORDER BY rank) END AS practice FROM r WHERE rank <= 3 GROUP BY 1, 2""".replace("WITH r AS", ", r AS"))
def best_practices(spark: SparkSession, d: str) -> DataFrame:
    """K04, on the three best answers; the stand-in names them, and says nothing on the first question."""
    top = upkeep.numbered(t.answers(spark, d, current=True), ["domain_id", "question_id"], [F.desc("score"), F.col("entity_id")], "rank").where("rank <= 3")
    said = top.withColumn("answer", F.when(F.col("question_id") == 1, "none").otherwise("some"))
    ask = lambda p: "Best practice: " if "Answer: none" in p else "Best practice:  Require " + " ".join(x.split(": ")[1].split("\n")[0] for x in p.split("\n---\n"))
    return models.best_practices(said, ask, t.NOT_IN_STATUTE)


@R.add(f"""SELECT entity_id, domain_id, question_id, CASE WHEN question_id > 5 OR question_id = 3 THEN NULL WHEN answer = '{t.NOT_IN_STATUTE}' THEN '' ELSE 'No gap' END AS gap,
  CASE WHEN question_id > 5 THEN NULL WHEN question_id = 3 THEN 0.7 WHEN answer = '{t.NOT_IN_STATUTE}' THEN 0.0 ELSE 0.9 END::DOUBLE AS score FROM answers WHERE version = 1""")
def enriched_answers(spark: SparkSession, d: str) -> DataFrame:
    """The third question has its scores already, those after the fifth have no best practice."""
    rows = t.answers(spark, d, current=True).select("entity_id", "domain_id", "question_id", "answer", F.when(F.col("question_id") == 3, 0.7).alias("score"))
    practices = t.questions(spark, d).where("question_id <= 5").select("domain_id", "question_id", F.lit("Require it.").alias("practice"))
    all_ = practices.union(t.domains(spark, d).select("domain_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("question_id"), F.lit("Require it.").alias("practice"))).distinct()
    return models.enriched(rows, all_, lambda p: '{"gap": "No gap", "score": 0.9, "nextPrompts": []}', (t.NOT_IN_STATUTE,))


@R.add("""SELECT doc_id, coalesce(length(text) % 2 = 0, false) AS is_relevant, CASE WHEN length(text) % 2 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS confidence FROM documents""", common=False)
def judged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Replies that can't be read count as no; the stand-in judges by the parity of what it is told."""
    rows = _docs(spark, d).select("doc_id", F.lit("x").alias("name"), F.col("text").alias("content"))
    ask = lambda p: '{"relevant": true, "confidence": 170}' if (len(p) - len("Is this about x?\n")) % 2 == 0 else "I can't say"
    return models.judged(rows, ask).select("doc_id", "is_relevant", "confidence")


@R.add("""SELECT page_id, (1 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_articles, CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '=== Article I ===' || chr(10) || chr(10) || repeat('a', 60) ELSE '' END
  || chr(10) || chr(10) || '=== Article II ===' || chr(10) || chr(10) || repeat('b', 60) AS text FROM pages""", common=False)
def stitched_articles(spark: SparkSession, d: str) -> DataFrame:
    """Two articles of each page, of which odd pages have the first on the page itself; a third is too short."""
    link = lambda to, title: F.concat(F.lit('<a class="x titleLink" href="'), to, F.lit('"><span class="titleNumber">'), F.lit(title), F.lit("</span> t</a>"))
    k = F.col("page_id")
    listed = F.concat(link(F.when(k % 2 == 0, "/one").otherwise("#one"), " Article I "), link(F.lit("/two"), "Article II"), link(F.lit("/three"), "Article III"), link(F.lit("/four"), "Chapter 4"))
    found = upkeep.article_links(t.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://a"), k, F.lit(".org/code")).alias("url"), listed.alias("html")))
    bodies = found.select("url", F.when(F.endswith("url", F.lit("/one")), F.repeat(F.lit("a"), F.lit(60))).when(F.endswith("url", F.lit("/two")), F.repeat(F.lit("b"), F.lit(60))).otherwise("short").alias("body"))
    return upkeep.stitched(found, bodies)
