"""Queries on decisions, picks and pipelines of maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import time as times
from quorumlake.operators import lookup, rules, versions
from quorumlake.plans.registry import Registry
from quorumlake.providers import models
from quorumlake.sources import tables as t

R = Registry()


def _part(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "part")


@R.add("""SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 200))), '^(<!doctype html|<html)') OR len(regexp_extract_all(html, '(?i)</?(?:p|div|span|table|a|br|h[1-6]|ul|li)\\b[^>]*>')) > 3 AS html,
  ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf') OR starts_with(url, '%PDF-') AS pdf, CASE WHEN page_id % 11 = 0 THEN 'FORCE' WHEN page_id % 3 = 0 THEN 'MISSING' WHEN length(html) - 3000 < 200 THEN 'SMALL' ELSE 'OK' END AS state FROM pages""")
def document_checks(spark: SparkSession, d: str) -> DataFrame:
    """B21, B22, B27."""
    p = t.table(spark, d, "pages")
    state = rules.statute_state(F.when(F.col("page_id") % 3 != 0, F.length("html") - 3000), F.lit(True), F.col("page_id") % 11 == 0)
    return p.select("page_id", rules.looks_like_html(F.col("html")).alias("html"), rules.is_pdf(F.col("url"), F.lit(None).cast("string"), F.col("url")).alias("pdf"), state.alias("state"))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'no ruleset' WHEN o_orderkey % 10 = 1 THEN 'url changed' WHEN o_orderkey % 10 = 2 THEN 'forced' WHEN o_orderkey % 10 = 3 THEN 'reload' WHEN o_totalprice > 200000 THEN 'older than 30 days' END AS reason,
  CASE WHEN o_orderkey % 8 = 0 THEN 'skip' WHEN o_orderkey % 8 = 1 THEN 'questions' WHEN o_orderkey % 8 = 2 THEN 'document' WHEN o_totalprice < 200000 THEN 'skip' ELSE 'stale' END AS refresh FROM orders""")
def update_decisions(spark: SparkSession, d: str) -> DataFrame:
    """B28, B32; prices stand for ages."""
    o, k = t.table(spark, d, "orders"), F.col("o_orderkey")
    days = F.col("o_totalprice") / 200000 * 30
    why = rules.update_reason(k % 10 != 0, F.when(k % 10 == 1, "old").otherwise("new"), F.lit("new"), k % 10 == 2, k % 10 == 3, days)
    return o.select("o_orderkey", why.alias("reason"), rules.refresh(F.when(k % 8 == 0, 0).otherwise(7), k % 8 == 1, k % 8 == 2, days).alias("refresh"))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 3 = 0 THEN 15 * 60 WHEN o_orderkey % 3 = 1 THEN 7200 ELSE 86400 END::BIGINT AS seconds,
  CASE WHEN s >= 86400 THEN (s // 86400) || 'd ago' WHEN s >= 3600 THEN (s // 3600) || 'h ago' ELSE (s // 60) || 'm ago' END AS age FROM (SELECT *, floor(o_totalprice)::BIGINT AS s FROM orders)""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """H34; prices stand for seconds."""
    k = F.col("o_orderkey")
    told = F.when(k % 5 == 4, "soon").when(k % 3 == 0, "15m").when(k % 3 == 1, "2h").otherwise("1d")
    return t.table(spark, d, "orders").select("o_orderkey", times.seconds_of(told).alias("seconds"), times.age_text(F.floor("o_totalprice")).alias("age"))


@R.add("""SELECT doc_id, CASE WHEN contains(lower(text), 'er' || (doc_id % 10)) OR contains(lower(text), 'thin') THEN 'valid' WHEN contains(lower(text), 'eineung') OR contains(lower(text), 'schlich') THEN 'invalid' ELSE 'valid' END AS relevance FROM documents""")
def entity_relevance(spark: SparkSession, d: str) -> DataFrame:
    """B31."""
    docs = t.table(spark, d, "documents")
    name = F.when(F.contains(F.lower("text"), F.concat(F.lit("er"), F.col("doc_id") % 10)), F.concat(F.lit("er"), F.col("doc_id") % 10)).otherwise("thin")
    return docs.select("doc_id", rules.relevance(F.col("text"), name, F.lit("town"), ("eineung", "schlich")).alias("relevance"))


@R.add(f"""WITH {t.CIVIC_SQL} SELECT entity_id, domain_id, question_id FROM answers WHERE version = 1 AND (score < 0.2 OR answer = '{t.NOT_IN_STATUTE}')""")
def requeued_answers(spark: SparkSession, d: str) -> DataFrame:
    """B34."""
    return t.answers(spark, d, current=True).where(rules.requeued(F.col("answer"), F.col("score"), 0.2)).select("entity_id", "domain_id", "question_id")


@R.add("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'enforcement' WHEN p_size % 5 = 1 THEN 'procedure' WHEN p_size % 5 = 2 THEN 'quantity' WHEN p_size % 5 = 3 THEN 'responsibility' ELSE 'general' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN 'What fine is due? penalty enforcement schedule always' WHEN p_size % 5 = 1 THEN 'Is a permit due? always' WHEN p_size % 5 = 2 THEN 'How many trees? always' WHEN p_size % 5 = 3 THEN 'Which board decides? always' ELSE 'Why? always' END AS enhanced FROM part""")
def question_guidance(spark: SparkSession, d: str) -> DataFrame:
    """H15, H41."""
    n = F.col("p_size") % 5
    asked = F.when(n == 0, "What fine is due?").when(n == 1, "Is a permit due?").when(n == 2, "How many trees?").when(n == 3, "Which board decides?").otherwise("Why?")
    given = F.expr("array(named_struct('conditions', array('Fine'), 'terms', array('penalty enforcement', 'schedule')), named_struct('conditions', cast(array() as array<string>), 'terms', array('always')))")
    return _part(spark, d).select("p_partkey", rules.guidance(asked).alias("kind"), rules.enhanced_question(asked, given).alias("enhanced"))


@R.add("""SELECT page_id, NOT (starts_with(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/de/') OR starts_with(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/en/7')) AS allowed FROM pages""")
def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    """B17."""
    robots = F.lit("User-agent: bad\nDisallow: /fr/\n\nUser-agent: *\nDisallow: /\nDisallow: /de/ # German\nDisallow:\nDisallow: /en/7\n")
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return t.table(spark, d, "pages").select("page_id", rules.robots_allow(path, rules.robots_rules(robots)).alias("allowed"))


@R.add("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Very Good' WHEN p_size % 4 = 1 THEN 'Good' WHEN p_size % 4 = 2 THEN 'Yellow' END AS grade, '1|1|' || CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END || '|1' AS parts, 'a' || p_size AS model FROM part""")
def cells_and_forms(spark: SparkSession, d: str) -> DataFrame:
    """H10, H38, H52."""
    n = F.col("p_size")
    cell = F.when(n % 4 == 0, "GG-strict").when(n % 4 == 1, "G").when(n % 4 == 2, "Y soft").otherwise("Green")
    form = F.concat(F.lit("Applicant name:\n\nA charge of $ 25\nPlease sign below\n"), F.when(n % 2 == 0, "You must attach a plan\n").otherwise(""), F.lit("Town Clerk\n"))
    parts = rules.form_parts(form)
    told = F.concat(F.lit('```json\n{"answer": "a'), n, F.lit('"}\n```'))
    return _part(spark, d).select(
        "p_partkey", rules.grade_of(cell, {"GG": "Very Good", "G": "Good", "Y": "Yellow", "R": "Red"}).alias("grade"), F.concat_ws("|", *(F.size(parts[k]).cast("string") for k in ("fields", "fees", "instructions", "departments"))).alias("parts"),
        rules.model_json(told, "answer string")["answer"].alias("model"),
    )


@R.add("""WITH w AS (SELECT DISTINCT o_custkey AS entity_id, o_orderpriority AS domain_id, (o_orderkey % 3)::VARCHAR AS section FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY entity_id, domain_id, section ORDER BY position) AS n FROM (SELECT o_custkey AS entity_id, o_orderpriority AS domain_id, (o_orderkey % 2)::VARCHAR AS section, o_orderkey AS position, 'u' || o_orderkey AS url FROM orders))
SELECT w.entity_id, w.domain_id, w.section, coalesce(b.url, 'https://r/' || w.entity_id) AS url FROM w LEFT JOIN (SELECT entity_id, domain_id, section, max_by(url, n) AS url FROM i WHERE n <= 2 GROUP BY 1, 2, 3) b ON b.entity_id = w.entity_id AND b.domain_id = w.domain_id AND b.section = w.section""")
def section_urls(spark: SparkSession, d: str) -> DataFrame:
    """A16, C27."""
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("domain_id"), F.col("o_orderkey").alias("position"))
    wanted = o.select("entity_id", "domain_id", (F.col("position") % 3).cast("string").alias("section")).distinct()
    index = o.select("entity_id", "domain_id", (F.col("position") % 2).cast("string").alias("section"), "position", F.concat(F.lit("u"), "position").alias("url"))
    fallback = o.select("entity_id", "domain_id").distinct().withColumn("ruleset_url", F.concat(F.lit("https://r/"), "entity_id"))
    return lookup.section_urls(wanted, index, fallback)


@R.add("""WITH f AS (SELECT s_suppkey AS flag_id, 'ordr' || (s_suppkey % 7) AS flag FROM supplier), k AS (SELECT unnest(['order', 'orders', 'ordr1', 'ordr55', 'domain']) AS name)
SELECT flag, name, levenshtein(flag, name)::INTEGER AS distance FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY levenshtein(flag, name), name) AS rn FROM (SELECT DISTINCT flag FROM f), k WHERE levenshtein(flag, name) <= 3) WHERE rn <= 3""")
def similar_flags(spark: SparkSession, d: str) -> DataFrame:
    """F07, H50."""
    flags = t.table(spark, d, "supplier").select(F.concat(F.lit("ordr"), F.col("s_suppkey") % 7).alias("flag")).distinct()
    known = spark.createDataFrame([(x,) for x in ("order", "orders", "ordr1", "ordr55", "domain")], "name string")
    return lookup.similar_flags(flags, known).select("flag", "name", "distance")


@R.add(r"""WITH a AS (SELECT conv_id AS title_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4))) AS w FROM conversations WHERE turn = 0),
b AS (SELECT item_id AS entity_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4))) AS w FROM benchmark),
h AS (SELECT title_id, entity_id, count(*) AS hits FROM a JOIN b ON a.w = b.w GROUP BY 1, 2)
SELECT title_id, entity_id, hits::BIGINT AS hits, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY hits DESC, entity_id) AS rank FROM h) WHERE rank <= 5""")
def fuzzy_entities(spark: SparkSession, d: str) -> DataFrame:
    """C12, F08."""
    titles = t.table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("title_id"), F.col("text").alias("title"))
    return lookup.fuzzy_entities(titles, t.table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("name")))


@R.add(r"""WITH a AS (SELECT item_id AS question_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM benchmark WHERE item_id % 2 = 0),
b AS (SELECT item_id AS practice_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM benchmark WHERE item_id % 2 = 1)
SELECT question_id, practice_id, count(*)::BIGINT AS shared FROM a JOIN b ON a.w = b.w GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """C29."""
    b = t.table(spark, d, "benchmark")
    return lookup.shared_words(b.where("item_id % 2 = 0").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), b.where("item_id % 2 = 1").select(F.col("item_id").alias("practice_id"), F.col("text").alias("practice")))


@R.add("""SELECT a.conv_id AS entity_id, a.turn AS position, b.turn AS needed, b.text AS needed_answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)""")
def earlier_answers(spark: SparkSession, d: str) -> DataFrame:
    """A turn depends on the two before it and, in vain, on the one after it."""
    c = t.table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("position"), F.col("text").alias("answer"), F.array(F.col("turn") - 1, F.col("turn") - 2, F.col("turn") + 1).alias("depends_on"))
    return lookup.earlier_answers(rows)


@R.add("""SELECT c_custkey AS feature_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey END AS entity_id, CASE c_custkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'name and type' WHEN 2 THEN 'name' END AS "by" FROM customer""")
def map_features(spark: SparkSession, d: str) -> DataFrame:
    """Features know an entity's id, its name and type, its name, or nothing."""
    c, n = t.table(spark, d, "customer"), F.col("c_custkey") % 4
    features = c.select(F.col("c_custkey").alias("feature_id"), F.when(n == 0, F.col("c_custkey").cast("string")).alias("ref"), F.when(n != 3, F.upper("c_name")).alias("name"), F.when(n == 1, F.lower("c_mktsegment")).alias("type"))
    return lookup.cascade(features, c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type")))


@R.add("""SELECT p_partkey, p_brand || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    """A60, E07."""
    return lookup.numbered(_part(spark, d), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@R.add("""SELECT 'f' || (p_partkey % 100) || '.txt' AS canonical, 'f' || (p_partkey % 100) || CASE WHEN max(p_partkey // 100) = 0 THEN '' ELSE '-' || (max(p_partkey // 100) + 1) END || '.txt' AS file, count(*)::BIGINT AS n_copies FROM part GROUP BY p_partkey % 100""")
def artifact_copies(spark: SparkSession, d: str) -> DataFrame:
    """D20."""
    k = F.col("p_partkey")
    file = F.concat(F.lit("f"), k % 100, F.when(k < 100, "").otherwise(F.concat(F.lit("-"), F.floor(k / 100) + 1)), F.lit(".txt"))
    return lookup.newest_copies(_part(spark, d).select(file.alias("file")))


@R.add("""SELECT o_custkey AS entity_id, o_orderpriority AS domain_id, (l_linenumber - 1)::INTEGER AS pos, 'q' || l_linenumber AS question, CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.6 ELSE 0.3 END AS confidence, 's' || l_linenumber || ', t' AS section
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE rn = 1 AND l_linenumber = 1""")
def legacy_answers(spark: SparkSession, d: str) -> DataFrame:
    """The first line of an order as the only answer of an old document."""
    o, line = t.table(spark, d, "orders"), t.table(spark, d, "lineitem")
    first = line.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")).alias("f")).where("f.l_linenumber = 1")
    a = F.struct(F.concat(F.lit("q"), "f.l_linenumber").alias("question"), F.lit("x").alias("answer"), F.when(F.col("f.l_returnflag") == "A", "high").when(F.col("f.l_returnflag") == "N", "medium").otherwise("?").alias("confidence"), F.array(F.concat(F.lit("s"), "f.l_linenumber"), F.lit("t")).alias("sections"))
    docs = o.join(first, o.o_orderkey == first.l_orderkey).select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("domain_id"), F.array(a).alias("answers"))
    return lookup.legacy_answers(docs).select("entity_id", "domain_id", "pos", "question", "confidence", "section")


@R.add(f"""WITH {t.CIVIC_SQL}, cur AS (SELECT * FROM analyses WHERE version = 1) SELECT e.entity_id::VARCHAR AS entity_id, d.domain_id, CASE WHEN c.state_code THEN 'state' ELSE e.entity_id::VARCHAR END AS source_id, CASE WHEN c.state_code THEN 'state text' WHEN e.entity_id % 2 = 0 THEN 'text ' || e.entity_id END AS text
FROM entities e CROSS JOIN domains d LEFT JOIN cur c ON c.entity_id = e.entity_id AND c.domain_id = d.domain_id""")
def state_documents(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    ids = t.entities(spark, d).select(F.col("entity_id").cast("string").alias("entity_id"))
    names = t.domains(spark, d).select("domain_id")
    wanted = ids.crossJoin(names).withColumn("state_id", F.lit("state"))
    current = t.analyses(spark, d).where("version = 1").select(F.col("entity_id").cast("string").alias("entity_id"), "domain_id", "state_code")
    own = ids.where("cast(entity_id as long) % 2 = 0").withColumn("text", F.concat(F.lit("text "), "entity_id")).union(spark.createDataFrame([("state", "state text")], "entity_id string, text string"))
    return lookup.state_documents(wanted, current, own.crossJoin(names))


@R.add(f"""WITH {t.CIVIC_SQL} SELECT e.entity_id, d.domain_id, CASE WHEN c.entity_id IS NULL THEN '' ELSE 'https://h/' || c.entity_id END AS home_page, coalesce(n_sources, 0)::BIGINT AS n_sources
FROM entities e CROSS JOIN domains d LEFT JOIN (SELECT entity_id, domain_id, count(*) AS n_sources FROM analyses GROUP BY 1, 2) c ON c.entity_id = e.entity_id AND c.domain_id = d.domain_id""")
def rulesets_or_default(spark: SparkSession, d: str) -> DataFrame:
    """A10, A65."""
    pairs = t.entities(spark, d).select("entity_id").crossJoin(t.domains(spark, d).select("domain_id"))
    had = t.analyses(spark, d).groupBy("entity_id", "domain_id").agg(F.count("*").alias("n_sources")).withColumn("home_page", F.concat(F.lit("https://h/"), "entity_id"))
    return lookup.rulesets_or_default(pairs, had)


@R.add("SELECT c_mktsegment AS city, " + ", ".join(f"string_agg(c_name, '; ' ORDER BY c_name) FILTER (c_nationkey % 3 = {i}) AS k{i}" for i in range(3)) + " FROM customer GROUP BY 1")
def category_columns(spark: SparkSession, d: str) -> DataFrame:
    """Names of each category side by side, the columns being given."""
    c = t.table(spark, d, "customer").withColumn("k", F.concat(F.lit("k"), F.col("c_nationkey") % 3))
    wide = c.groupBy(F.col("c_mktsegment").alias("city")).pivot("k", ["k0", "k1", "k2"]).agg(F.array_join(F.sort_array(F.collect_list("c_name")), "; "))
    return wide.select("city", *(F.nullif(x, F.lit("")).alias(x) for x in ("k0", "k1", "k2")))


@R.add(f"""WITH {t.CIVIC_SQL}, m AS (SELECT entity_id, domain_id, question_id FROM answers WHERE version = 1)
SELECT entity_id, domain_id, string_agg(question_id, ',' ORDER BY question_id) AS ids, count(*) <> max(question_id) AS has_gap FROM m GROUP BY 1, 2""")
def answer_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of an analysis' answers, and whether questions are missing in it."""
    rows = t.answers(spark, d, current=True).groupBy("entity_id", "domain_id").agg(F.sort_array(F.collect_list("question_id")).alias("q"))
    return rows.select("entity_id", "domain_id", F.array_join("q", ",").alias("ids"), (F.size("q") != F.array_max("q")).alias("has_gap"))


@R.add(f"""WITH {t.CIVIC_SQL} SELECT a.analysis_id, e.name, replace(a.domain_id, '-', ' ') AS domain FROM analyses a JOIN entities e ON e.entity_id = a.entity_id WHERE a.version = 1 AND e.type <> 'BUILDING'""")
def refreshed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names are looked up anew; a realm's own condition leaves out a type."""
    people = rules.ignored(t.entities(spark, d), "type = 'BUILDING'")
    return t.analyses(spark, d).where("version = 1").join(people, "entity_id").select("analysis_id", "name", F.replace("domain_id", F.lit("-"), F.lit(" ")).alias("domain"))


@R.add()
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by the offline stand-in; tests hold it, SQL has no such function."""
    docs = t.table(spark, d, "benchmark").select("item_id", F.col("text").alias("content"))
    out = models.with_embeddings(docs, models.provider("hashed-64"))
    return out.select("item_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v), 4).alias("norm"))


@R.add(f"""SELECT conv_id AS entity_id, turn AS question_id, CASE WHEN length(text) % 4 = 0 THEN '{t.NOT_IN_STATUTE}' ELSE 'Found.' END AS answer, CASE WHEN length(text) % 4 = 0 THEN 0.0 ELSE 0.5 END AS score, CASE WHEN length(text) % 3 = 0 THEN 100.0 WHEN length(text) % 3 = 1 THEN 50.0 ELSE 80.0 END AS confidence FROM conversations""")
def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a stand-in answers, tidied."""
    ask = lambda p: (t.NOT_IN_STATUTE if len(p) % 4 == 0 else "Found.", 0.5, [120.0, float("nan"), 80.0][len(p) % 3])
    rows = t.table(spark, d, "conversations").select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("question_id"), F.col("text").alias("prompt"))
    return models.answered(rows, ask, t.NOT_IN_STATUTE).drop("prompt")


@R.add("""SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def longest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The longest document of each place, the first of equals, as a grouped maximum."""
    docs = t.table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars").withColumn("back", -F.col("doc_id"))
    return versions.last_wins(docs, ["lang", "source"], ["n_chars", "back"]).drop("back")
