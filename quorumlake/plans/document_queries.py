"""Queries that write documents of the store and read them back, and runs over whole pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import titles
from quorumlake.operators import indexing, rewrite, sources, upkeep, versions
from quorumlake.plans.registry import Registry
from quorumlake.providers import models
from quorumlake.sources import document_tree, folders, store
from quorumlake.sources import tables as t

R = Registry(t.CIVIC_SQL)


def _saved(rows: DataFrame, name: str) -> DataFrame:
    """realm us: documents of domain_id, entity_id, content, written by the data source and opened again."""
    spark, root = rows.sparkSession, folders.shared(rows.sparkSession)
    document_tree.register(spark)
    docs = rows.select(F.lit("us").alias("realm_id"), F.col("domain_id").cast("string").alias("domain_id"), F.col("entity_id").cast("string").alias("entity_id"), F.lit(name).alias("name"), "content")
    document_tree.save(docs, root)
    return spark.read.format("document_tree").option("path", root).load()


def _text(rows: DataFrame, path: str) -> str:
    """The column value of the rows as text files below a folder, a file for each partition."""
    rows.select(F.col("value").cast("string").alias("value")).write.text(path)
    return path


@R.add("""SELECT 'd' || s_nationkey AS domain_id, s_suppkey::VARCHAR AS entity_id, 'https://home/' || s_suppkey AS home_page, s_suppkey % 2 = 0 AS state_code, CASE WHEN s_suppkey % 7 = 2 THEN 0 ELSE 1 END AS n_sources, CASE WHEN s_suppkey % 7 <> 2 THEN s_name END AS title
FROM supplier WHERE s_suppkey % 7 NOT IN (0, 1)""", common=False)
def stored_ruleset_files(spark: SparkSession, d: str) -> DataFrame:
    """Of rulesets in files every seventh is blank, and every seventh broken, which is as if they weren't there."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 7
    source = F.array(F.struct(F.concat(F.lit("https://x/"), k).alias("sourceUrl"), F.col("s_name").alias("title")))
    whole = F.to_json(F.struct(F.concat(F.lit("https://home/"), k).alias("homePage"), F.when(k % 2 == 0, True).alias("stateCodeApplies"), F.when(kind != 2, source).otherwise(F.array().cast("array<struct<sourceUrl:string,title:string>>")).alias("sources")))
    rows = t.table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_nationkey").alias("domain_id"), k.alias("entity_id"), F.when(kind == 0, " \n\t").when(kind == 1, F.concat(F.lit("{broken"), whole)).otherwise(whole).alias("content"))
    found = store.rulesets(_saved(rows, "metadata.json"))
    return found.select("domain_id", "entity_id", "home_page", "state_code", F.size("sources").alias("n_sources"), F.try_element_at("sources", F.lit(1))["title"].alias("title"))


@R.add("""SELECT p_brand AS domain_id, count(*)::BIGINT AS n_analysed, min(p_partkey)::VARCHAR AS best_entity, sum(p_size)::BIGINT AS practice_sizes FROM part GROUP BY 1""", common=False)
def stored_meta_analyses(spark: SparkSession, d: str) -> DataFrame:
    """A file for each domain, with a best practice for each of its parts."""
    practice = F.struct(F.col("p_partkey").cast("int").alias("questionId"), F.col("p_name").alias("questionText"), F.col("p_size").cast("string").alias("bestAnswer"))
    rows = t.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("best"), F.collect_list(practice).alias("practices"))
    doc = F.to_json(F.struct(F.struct(F.col("p_brand").alias("id")).alias("domain"), F.col("n").alias("totalMunicipalitiesAnalyzed"), F.struct(F.col("best").cast("string").alias("id")).alias("highestScoringEntity"), F.col("practices").alias("bestPractices")))
    root = folders.shared(spark)
    rows.select("p_brand", doc.alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(root)
    found = store.meta_analyses(spark, f"{root}/*/*.txt")
    return found.select("domain_id", "n_analysed", "best_entity", F.aggregate("practices", F.lit(0), lambda s, p: s + p["bestAnswer"].cast("int")).cast("long").alias("practice_sizes"))


@R.add("""SELECT c_custkey::VARCHAR AS entity_id, 'https://s/' || c_custkey AS source_url, '"' || c_nationkey || '"' AS section, 'https://s/' || c_custkey || '#a' || c_nationkey AS url FROM customer""", common=False)
def stored_section_index(spark: SparkSession, d: str) -> DataFrame:
    """Quotes are kept as they are, blank lines skipped, the first line of each file too."""
    c = t.table(spark, d, "customer")
    line = F.concat_ws(",", F.col("c_custkey"), F.lit("trees"), F.concat(F.lit("https://s/"), "c_custkey"), F.concat(F.lit('"'), "c_nationkey", F.lit('"')), F.concat(F.lit("a"), "c_nationkey"), F.concat(F.lit("https://s/"), "c_custkey", F.lit("#a"), "c_nationkey"))
    lines = c.groupBy(F.pmod("c_custkey", F.lit(8)).alias("part")).agg(F.concat(F.lit("entity,domain,source,section,anchor,url\n\n"), F.array_join(F.collect_list(line), "\n\n")).alias("value"))
    root = folders.shared(spark)
    lines.repartition("part").write.partitionBy("part").text(root)
    rows = store.section_index(spark, f"{root}/*/*.txt")
    return rows.select("entity_id", "source_url", "section", "url")


@R.add("""WITH w AS (SELECT s_nationkey::VARCHAR AS entity_id, 'https://s/' || (s_suppkey % 50) AS url, s_suppkey FROM supplier)
SELECT w.entity_id, w.url, w.s_suppkey, f.title FROM w LEFT JOIN (SELECT entity_id, url, min_by(title, s_suppkey) AS title FROM (SELECT s_nationkey::VARCHAR AS entity_id, 'https://s/' || (s_suppkey % 50) AS url, s_name AS title, s_suppkey FROM supplier WHERE s_suppkey % 3 > 0) GROUP BY 1, 2) f ON f.entity_id = w.entity_id AND f.url = w.url""", common=False)
def stored_source_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles by entity and address from sources.json; the first of an address, null where there is none."""
    rows = t.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("entity_id"), F.concat(F.lit("https://s/"), F.col("s_suppkey") % 50).alias("url"), "s_suppkey", "s_name")
    each = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "url", "s_name"))), lambda x: F.struct(x["url"].alias("url"), x["s_name"].alias("title")))
    whole = rows.where("s_suppkey % 3 > 0").groupBy("entity_id").agg(each.alias("s")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("entity_id", "s")))).alias("value"))
    return store.source_titles(rows.drop("s_name"), store.source_map(spark, _text(whole, folders.shared(spark))))


@R.add("""SELECT s_nationkey::VARCHAR AS entity_id, 'h' || s_suppkey || '.org' AS host, CASE WHEN s_suppkey % 2 = 0 THEN 'header' ELSE '#masthead' END AS header, CASE WHEN s_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS content FROM supplier""", common=False)
def saved_websites(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of each entity, written twice for a half of them; the last write counts."""
    document_tree.register(spark)
    root, k = folders.shared(spark), F.col("s_suppkey")
    rows = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.concat(F.lit("h"), k, F.lit(".org")).alias("host"), F.when(k % 2 == 0, "header").otherwise("#masthead").alias("header"), F.lit(None).cast("string").alias("footer"))
    store.save_websites(rows.withColumn("content", F.lit("old")), root, "us")
    store.save_websites(rows.where("entity_id % 2 = 0").withColumn("content", F.lit("new")), root, "us")
    return store.websites(spark.read.format("document_tree").option("path", root).load()).select("entity_id", "host", "header", "content")


@R.add("""SELECT doc_id % 100 AS entity_id, domain_id, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS n_bytes FROM (SELECT doc_id, text, unnest(CASE WHEN doc_id % 3 = 0 THEN ['trees'] ELSE ['noise', 'trees'] END) AS domain_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 > 0) GROUP BY 1, 2""", common=False)
def additional_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of the downloads of each entity and domain, as rows."""
    k = F.col("doc_id")
    ids = F.when(k % 3 == 0, F.array(F.lit("trees"), F.lit("trees"))).otherwise(F.array(F.lit("noise"), F.lit("trees")))
    rows = t.table(spark, d, "documents").select((k % 100).alias("entity_id"), F.col("doc_id").alias("file"), ids.alias("domain_ids"), F.when(k % 4 > 0, "related").otherwise("index").alias("status"), F.col("text").alias("content"))
    return store.additional_sources(rows).groupBy("entity_id", "domain_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("n_bytes"))


@R.add("SELECT c_custkey::VARCHAR AS entity_id, c_name AS name, c_custkey = (SELECT min(c_custkey) FROM customer) AS looked_up, CASE c_custkey % 3 WHEN 0 THEN 'https://l/' || c_custkey WHEN 1 THEN 'https://flat/' || c_custkey END AS link FROM customer", common=False)
def stored_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a list, one of them by its id, and their main links: of the list, else the flat field."""
    root, k = folders.shared(spark), F.col("c_custkey")
    link = lambda kind, url: F.struct(F.lit(kind).alias("type"), url.alias("url"))
    rows = t.table(spark, d, "customer").select(k.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.array(link("code", F.lit("https://c")), link("main", F.concat(F.lit("https://l/"), k)))).when(k % 3 == 1, F.array(link("main", F.lit("")))).otherwise(F.array(link("code", F.lit("https://c")))).alias("links"), F.when(k % 3 == 1, F.concat(F.lit("https://flat/"), k)).alias("mainUrl"))
    _text(rows.select(F.to_json(F.struct("id", "name")).alias("value")), f"{root}/us/entities.json")
    people = spark.read.schema("id string, name string").json(f"{root}/us/entities.json")
    first = t.table(spark, d, "customer").agg(F.min("c_custkey")).first()[0]
    one = store.one_of(people, "id", str(first)).select("id", F.lit(True).alias("hit"))
    links = rows.select("id", sources.link(F.col("links"), "main", F.col("mainUrl")).alias("link"))
    return people.join(one, "id", "left").join(links, "id").select(F.col("id").alias("entity_id"), "name", F.coalesce("hit", F.lit(False)).alias("looked_up"), "link")


@R.add(f"""SELECT entity_id::VARCHAR AS entity_id, domain_id, count(*)::BIGINT AS n, floor(sum(confidence) / 100 * 10000 + 0.5) / 10000 AS confidence, max(question_id)::VARCHAR AS last FROM answers WHERE version = 1 GROUP BY 1, 2""")
def stored_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Analyses in files of the older form (municipality, questionId, gapAnalysis), read as they are to be."""
    rows = t.answers(spark, d, current=True)
    each = F.struct(F.col("question_id").cast("string").alias("questionId"), F.col("answer"), F.col("score"), F.col("confidence"), F.lit("g").alias("gapAnalysis"))
    docs = rows.groupBy("entity_id", "domain_id").agg(F.sort_array(F.collect_list(each)).alias("q"))
    doc = F.to_json(F.struct(F.struct(F.col("entity_id").cast("string").alias("id")).alias("municipality"), F.struct(F.col("domain_id").alias("id")).alias("domain"), F.col("q").alias("questions")))
    found = store.parsed(_saved(docs.withColumn("content", doc), "analysis.json"), store.ANALYSIS)
    skip = lambda c: F.nullif(c, F.lit(""))
    one = found.select(F.coalesce(skip(F.col("doc.entityId")), skip(F.col("doc.municipality.id")), "entity_id").alias("entity_id"), F.coalesce(skip(F.col("doc.domainId")), skip(F.col("doc.domain.id")), "domain_id").alias("domain_id"), F.explode("doc.questions").alias("q"))
    plain = one.select("entity_id", "domain_id", F.coalesce("q.id", "q.questionId").alias("question_id"), store.normal(F.col("q.confidence")).alias("confidence"))
    return plain.groupBy("entity_id", "domain_id").agg(F.count("*").alias("n"), (F.floor(F.sum("confidence") * 10000 + 0.5) / 10000).alias("confidence"), F.max("question_id").alias("last"))


@R.add(f"""WITH {t.CIVIC_SQL}, s AS (SELECT entity_id, domain_id, list(question_id ORDER BY question_id) AS up, list(question_id ORDER BY question_id DESC) AS down FROM answers WHERE version = 1 GROUP BY 1, 2),
x AS (SELECT entity_id, domain_id, CASE WHEN entity_id % 2 = 0 THEN up ELSE down END AS had, list_filter(up, lambda q: domain_id <> '{t.SHORT_DOMAIN}' OR q < {t.QUESTIONS}) AS right_ids FROM s)
SELECT entity_id, domain_id, array_to_string(right_ids, ',') AS ids FROM x WHERE had <> right_ids""", common=False)
def mended_orders(spark: SparkSession, d: str) -> DataFrame:
    """Answers of every second entity stand backwards; only what differs from the questions' order is to be written."""
    given = t.answers(spark, d, current=True).groupBy("entity_id", "domain_id").agg(F.sort_array(F.collect_list("question_id")).alias("q"))
    stored = given.select("entity_id", "domain_id", F.when(F.col("entity_id") % 2 == 0, F.col("q")).otherwise(F.reverse("q")).alias("question_ids"))
    asked = t.questions(spark, d).select("domain_id", F.col("question_id").cast("int").alias("question_id"), F.col("question_id").alias("position"))
    return versions.reordered(stored, asked).select("entity_id", "domain_id", F.array_join("question_ids", ",").alias("ids"))


@R.add("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'HTML' WHEN page_id % 5 = 1 THEN 'PDF' WHEN page_id % 5 = 2 THEN 'PDF' END AS file_type, CASE page_id % 5 WHEN 0 THEN 'patched' WHEN 1 THEN 'patched' WHEN 2 THEN 'skipped' WHEN 3 THEN 'missing' ELSE 'download' END AS action FROM pages""", common=False)
def migrated_file_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of pages' files by their first bytes; some have a type, some no file, some none yet."""
    p, k = t.table(spark, d, "pages"), F.col("page_id")
    kind = k % 5
    files = p.where(kind < 3).select(k.cast("string").alias("path"), F.encode(F.when(kind == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-1.7 "), "html")), "UTF-8").alias("content"))
    records = p.select("page_id", "url", F.when(k % 2 == 0, "related").otherwise("index").alias("status"), F.when(kind < 4, k.cast("string")).alias("file"), F.when(kind == 2, "PDF").alias("file_type"))
    return upkeep.file_types(records, files).select("page_id", "file_type", "action")


@R.add(r"""WITH h AS (SELECT page_id, url, regexp_replace(html, '(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>)|<!--.*?-->', '', 'g') AS html FROM pages),
c AS (SELECT page_id, url, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS t, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) AS h1 FROM h),
p AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM (SELECT page_id, url, CASE WHEN trim(t) <> '' THEN t ELSE h1 END AS x FROM c))
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Own ' || page_id WHEN page_id % 4 = 1 THEN 'Some Page ' || page_id || '.Html' ELSE substr(t, 1, 300) END AS title FROM p""", common=False)
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Of the page, for a quarter of the records their own, and for a quarter of the slug of an address."""
    k = F.col("page_id")
    kept = F.when(k % 4 > 1, F.col("html"))
    own = F.when(k % 4 == 0, F.concat(F.lit(" Own "), k)).when(k % 4 == 1, F.concat(F.lit("https://a.org/x/some_page-"), k, F.lit(".html")))
    url = F.when(k % 4 == 1, F.concat(F.lit("https://a.org/x/some_page-"), k, F.lit(".html"))).otherwise(F.col("url"))
    cached, given = F.when(k % 4 == 2, kept), F.when(k % 4 == 3, kept)
    return t.table(spark, d, "pages").select("page_id", titles.document_title(cached, given, own, url).alias("title"))


@R.add(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, url, CASE WHEN regexp_matches(html, '(?i)<footer[\s>]') THEN 'footer' END AS f,
  CASE WHEN regexp_matches(html, '(?i)<header[\s>]') THEN 'header' WHEN regexp_matches(html, '(?i)role=["'']banner["'']') THEN '[role=''banner'']' END AS h FROM pages),
v AS (SELECT host, count(f) AS nf, count(*) FILTER (h = 'header') AS nh, count(*) FILTER (h LIKE '[%') AS nr FROM p GROUP BY 1)
SELECT host, count(*)::BIGINT AS n_pages, count(*) FILTER (page_id % 2 = 0)::BIGINT AS n_stored, (CASE WHEN max(nf) >= 2 OR greatest(max(nh), max(nr)) >= 2 THEN count(*) ELSE 0 END)::BIGINT AS n_templates FROM p JOIN v USING (host) GROUP BY 1""", common=False)
def rewrite_run(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over all pages; the SQL knows the templates, tests the texts."""
    p = t.table(spark, d, "pages")
    stored = p.where("page_id % 2 = 0").select("page_id", F.lit("old text").alias("body"))
    rows = rewrite.rewritten(p.select("page_id", "url", "html"), stored, F.lit("2024-01-01"), F.lit("2024-01-02"))
    told = rows.groupBy("host").agg(F.count("old_bytes").alias("n_stored"))
    return rewrite.rewrite_report(rows).join(told, "host").select("host", "n_pages", "n_stored", "n_templates")


@R.add("""SELECT CASE WHEN doc_id % 9 = 0 THEN 'no domain' WHEN doc_id % 7 = 0 THEN 'old' WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 4 = 0 THEN 'indexed' ELSE 'index' END AS decision, count(*)::BIGINT AS n FROM documents GROUP BY 1""", common=False)
def index_run_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A run over all documents; what becomes of each.  Tests hold its chunks and its search."""
    return _indexed(spark, d).decisions().groupBy("decision").agg(F.count("*").alias("n"))


def _indexed(spark: SparkSession, d: str) -> indexing.Indexed:
    k = F.col("doc_id")
    file = F.concat(F.lit("f"), k, F.lit(".txt"))
    docs = t.table(spark, d, "documents")
    downloads = docs.select((k % 50).alias("entity_id"), file.alias("file"), F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("trees"))).alias("domain_ids"), F.col("text").alias("content"))
    day = F.when(k % 7 == 0, "2020-01-01").otherwise("2024-01-01").cast("timestamp")
    history = docs.select((k % 50).alias("entity_id"), F.lit(None).cast("string").alias("text_file"), F.concat(F.lit("down/"), file).alias("file"), F.concat(F.lit("https://x/"), k).alias("url"), day.alias("ts"), F.when(k % 5 == 0, "PDF").otherwise("HTML").alias("file_type"), k.alias("position"))
    known = docs.where(k % 4 == 0).select(F.concat((k % 50).cast("string"), F.lit("-shared/"), file).alias("document"))
    return indexing.index_run(downloads, history, known, models.provider("hashed-64"), folders.shared(spark), F.lit("2024-01-02"), 48)


@R.add("""SELECT count(*)::BIGINT AS n_documents, true AS all_chunks_indexed, true AS found_again FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 0 AND length(text) >= 1200""", common=False)
def index_run_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of longer documents are found again by their own text, the first or beside an equal one."""
    run = _indexed(spark, d)
    chunks = run.chunks()
    asked = chunks.where("chunk_index = 0 AND length(content) > 0").select(F.col("chunk_id").alias("query_id"), "content")
    hits = run.search(asked, models.provider("hashed-64"), 1).where("score >= 0.999999").select(F.regexp_replace("query_id", "-0$", "").alias("document"))
    name = F.concat((F.col("doc_id") % 50).cast("string"), F.lit("-shared/f"), "doc_id", F.lit(".txt"))
    done = run.decisions().where("decision = 'index'").select("file")
    long_ = t.table(spark, d, "documents").where("length(text) >= 1200").withColumn("file", F.concat(F.lit("f"), "doc_id", F.lit(".txt"))).join(done, "file", "left_semi").select(name.alias("document"))
    cut = chunks.select("document", F.lit(1).alias("cut")).distinct()  # texts of oversized parts alone have no chunk (H12)
    mine = long_.join(cut, "document", "left").join(hits.withColumn("hit", F.lit(1)), "document", "left")
    return mine.agg(F.count("*").alias("n_documents"), F.lit(run.index().size() == chunks.where("vector IS NOT NULL").count()).alias("all_chunks_indexed"), (F.count("hit") == F.count("cut")).alias("found_again"))
