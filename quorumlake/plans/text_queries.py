"""Queries on addresses, texts, ordinances and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import chunk, html, text, urls
from quorumlake.operators import ordinances, pages, scoring, versions
from quorumlake.plans.registry import Registry
from quorumlake.sources import tables as t

ORDINANCES_SQL = """ordinances AS (
  SELECT doc_id, lang AS state, 'county' || (doc_id % 7) AS county, source AS city, CASE WHEN doc_id % 3 = 0 THEN 'City Council' ELSE 'Town Board' END AS source_jurisdiction_type,
         n_chars >= 200 AS is_substantive, substr(text, 1, 60) AS header, text AS content FROM documents)"""
HOST_SQL = "lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH_SQL = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
R = Registry(ORDINANCES_SQL)


def _ordinances(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "City Council").otherwise("Town Board")
    return docs.select(
        "doc_id", F.col("lang").alias("state"), F.concat(F.lit("county"), F.col("doc_id") % 7).alias("county"), F.col("source").alias("city"), kind.alias("source_jurisdiction_type"), (F.col("n_chars") >= 200).alias("is_substantive"),
        F.substring("text", 1, 60).alias("header"), F.col("text").alias("content"),
    )


def _search_sql(where: str) -> str:
    return f"SELECT doc_id, state, county, city, source_jurisdiction_type, header FROM ordinances WHERE is_substantive AND {where}"


@R.add(_search_sql("upper(state) = 'EN' AND city ILIKE '%src1%' AND source_jurisdiction_type ILIKE '%council%' AND (regexp_matches(header, '(?i)\\bthat') OR regexp_matches(content, '(?i)\\bthat') OR regexp_matches(header, '(?i)\\bthing') OR regexp_matches(content, '(?i)\\bthing'))"))
def ordinance_search(spark: SparkSession, d: str) -> DataFrame:
    """Any of the words, by their beginnings."""
    found = ordinances.search(_ordinances(spark, d), ordinances.Search(state="en", city="src1", kind="council", words=("that", "thing")))
    return found.select("doc_id", "state", "county", "city", "source_jurisdiction_type", "header")


@R.add(_search_sql("(regexp_matches(header, '(?i)\\bthe\\b') OR regexp_matches(content, '(?i)\\bthe\\b')) AND (regexp_matches(header, '(?i)\\bwith\\b') OR regexp_matches(content, '(?i)\\bwith\\b')) ORDER BY doc_id LIMIT 25"))
def ordinance_search_all(spark: SparkSession, d: str) -> DataFrame:
    """All words, whole, the first 25 by key."""
    found = ordinances.search(_ordinances(spark, d), ordinances.Search(words=("the", "with"), match_all=True, whole=True), limit=25)
    return found.select("doc_id", "state", "county", "city", "source_jurisdiction_type", "header")


@R.add("SELECT count(*)::BIGINT AS n FROM ordinances WHERE is_substantive AND (regexp_matches(header, '(?i)\\bhaus') OR regexp_matches(content, '(?i)\\bein'))")
def ordinance_count(spark: SparkSession, d: str) -> DataFrame:
    """D14, with one predicate for the header and another for the content."""
    rows = _ordinances(spark, d).where(F.col("header").rlike(text.keyword_pattern(["haus"])) | F.col("content").rlike(text.keyword_pattern(["ein"])))
    return ordinances.count(rows, ordinances.Search())


@R.add("""SELECT e.entity_id, e.city, e.state, count(o.doc_id)::BIGINT AS n FROM (SELECT c_custkey AS entity_id, 'src' || (c_custkey % 25) AS city, CASE WHEN c_custkey % 2 = 0 THEN 'EN' ELSE 'de' END AS state FROM customer) e
LEFT JOIN (SELECT * FROM ordinances WHERE is_substantive AND (regexp_matches(header, '(?i)\\bthe') OR regexp_matches(content, '(?i)\\bthe'))) o ON upper(o.state) = upper(e.state) AND contains(lower(o.city), lower(e.city)) GROUP BY 1, 2, 3""")
def entity_ordinance_counts(spark: SparkSession, d: str) -> DataFrame:
    """One count for each entity, decorrelated."""
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("src"), F.col("c_custkey") % 25).alias("city"), F.when(F.col("c_custkey") % 2 == 0, "EN").otherwise("de").alias("state"))
    return ordinances.counts_for_entities(people, _ordinances(spark, d), ordinances.Search(words=("the",)))


@R.add("""SELECT doc_id, CASE WHEN length(content) <= 400 THEN content WHEN NOT regexp_matches(content, '(?i)\\b(that|of)') THEN substr(content, 1, 400) || '...'
  ELSE (CASE WHEN pos - 150 > 0 THEN '...' ELSE '' END) || substr(content, (greatest(0, pos - 150) + 1)::BIGINT, (least(length(content), pos + length(m) + 250) - greatest(0, pos - 150))::BIGINT) || (CASE WHEN pos + length(m) + 250 < length(content) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, regexp_extract(content, '(?i)(?:\\bthat|\\bof)') AS m, length(regexp_extract(content, '(?is)^(.*?)(?:\\bthat|\\bof)', 1)) AS pos FROM ordinances)""")
def ordinance_snippets(spark: SparkSession, d: str) -> DataFrame:
    """H18."""
    return _ordinances(spark, d).select("doc_id", text.snippet(F.col("content"), ("that", "of")).alias("snippet"))


@R.add(r"""SELECT doc_id, regexp_replace(header, '(?i)((?:\bth|\bof))', '**\1**', 'g') AS header FROM ordinances""")
def highlighted_headers(spark: SparkSession, d: str) -> DataFrame:
    return _ordinances(spark, d).select("doc_id", text.highlighted(F.col("header"), ("th", "of")).alias("header"))


@R.add("SELECT doc_id, 'locus://' || state || '/' || county || '/' || city || '/' || substr(sha256(header || content), 1, 16) AS url FROM ordinances")
def synthetic_urls(spark: SparkSession, d: str) -> DataFrame:
    """H44."""
    return _ordinances(spark, d).select("doc_id", ordinances.synthetic_url(*(F.col(c) for c in ("state", "county", "city", "header", "content"))).alias("url"))


@R.add(f"""SELECT page_id, url AS normalized, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || {HOST_SQL} || CASE WHEN regexp_replace({PATH_SQL}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH_SQL}, '/+$', '') END AS matched,
  regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS source, {HOST_SQL} AS host, array_to_string(string_split({HOST_SQL}, '.')[-2:], '.') AS registrable, regexp_extract({PATH_SQL}, '^/*([^/]*)', 1) AS folder FROM pages""", common=False)  # fmt: skip
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """H01-H04."""
    u = F.col("url")
    return t.table(spark, d, "pages").select(
        "page_id", urls.normalized(u).alias("normalized"), urls.match_form(u).alias("matched"), urls.source_form(u).alias("source"), urls.hostname(u).alias("host"), urls.registrable(urls.hostname(u)).alias("registrable"), urls.first_folder(u).alias("folder")
    )


@R.add(f"""SELECT page_id, regexp_matches(url, '(?i){urls.SKIP}') AS skipped, lower(regexp_extract(regexp_extract({PATH_SQL}, '^/*([^/]*)', 1), '(?i)^([a-z]{{2}})(?:-[a-z]{{2}})?$', 1)) AS lang,
  CASE WHEN page_id % 10 = 0 THEN 'visited' WHEN regexp_matches(url, '(?i){urls.SKIP}') THEN 'pattern' WHEN {HOST_SQL} = '' THEN 'bad-url' WHEN array_to_string(string_split({HOST_SQL}, '.')[-2:], '.') NOT IN ('example.com', 'example.org') THEN 'host' END AS reason FROM pages""", common=False)  # fmt: skip
def link_filters(spark: SparkSession, d: str) -> DataFrame:
    """B13-B16."""
    u = F.col("url")
    return t.table(spark, d, "pages").select("page_id", urls.skipped(u).alias("skipped"), urls.language_folder(u).alias("lang"), pages.link_reason(u, F.lit("none"), ("example.com", "example.org"), F.col("page_id") % 10 == 0).alias("reason"))


@R.add("""WITH v AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, 'footer' AS zone, CASE WHEN regexp_matches(html, '(?i)<footer[\\s>]') THEN 'footer' END AS selector FROM pages
  UNION ALL SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)), 'header', CASE WHEN regexp_matches(html, '(?i)<header[\\s>]') THEN 'header' WHEN regexp_matches(html, '(?i)role=["'']banner["'']') THEN '[role=''banner'']' END FROM pages)
SELECT host, zone, selector, count(*)::BIGINT AS votes, count(*) >= 2 AS active FROM v WHERE selector IS NOT NULL GROUP BY 1, 2, 3""", common=False)  # fmt: skip
def host_votes(spark: SparkSession, d: str) -> DataFrame:
    """D18, H29; the SQL knows the selectors that the synthetic pages have."""
    return pages.host_votes(t.table(spark, d, "pages"))


@R.add("""WITH l AS (SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="([^"#][^"]*)"[^>]*>.*?</a>', 1)) AS href FROM pages),
f AS (SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN root || href ELSE root || '/' || href END AS full_url FROM l),
m AS (SELECT page_id, regexp_replace(full_url, '[?#].*$', '') AS u FROM f)
SELECT page_id, count(DISTINCT lower(regexp_extract(u, '^([^:]+://[^/]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(u, '^[^:]+://[^/]*(.*)$', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(u, '^[^:]+://[^/]*(.*)$', 1), '/+$', '') END)::BIGINT AS n_links FROM m GROUP BY 1""", common=False)  # fmt: skip
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links of each page."""
    return pages.links_of(t.table(spark, d, "pages").select("page_id", "url", "html")).groupBy("page_id").agg(F.count("*").alias("n_links"))


@R.add()
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Title, headings and readable text of each page; needs an HTML parser, so tests hold it."""
    parts = t.table(spark, d, "pages").select("page_id", html.html_parts("html").alias("p"))
    return parts.select("page_id", F.col("p.title").alias("title"), F.size("p.headers").alias("n_headers"), html.normal_text(F.col("p.text")).alias("text"))


DOMAINS = (("trees", "general", "Tree care", "thereon that rules", "ingthe"), ("property", "topic", "Property upkeep", "with thes thing", "erin"), ("noise", "topic", "Noise", "from this ation", "ndst"), ("wasser", "topic", "Wasser", "eine schaft lich", "ungen"))
_KEYWORDS = [(i, kind, w) for i, kind, *rest in DOMAINS for w in dict.fromkeys(x for x in " ".join((i, *rest)).lower().split() if len(x) >= 4)]
_VALUES = ", ".join(f"('{i}', '{k}', '{w}')" for i, k, w in _KEYWORDS)
PAGE_SCORES_SQL = f"""kw AS (SELECT * FROM (VALUES {_VALUES}) v(domain_id, type, keyword)),
pg AS (SELECT doc_id AS page_id, lower(source) AS url, lower(substr(text, 1, 60)) AS title, lower(substr(text, 61, 60)) AS headers, lower(substr(text, 1, 3000)) AS body FROM documents),
sums AS (
  SELECT page_id, domain_id, type, count(*) AS raw, count(*) FILTER (contains(title, keyword)) AS t, count(*) FILTER (contains(headers, keyword)) AS h, count(*) FILTER (contains(url, keyword)) AS u, count(*) FILTER (contains(body, keyword)) AS b
  FROM pg, kw WHERE contains(title, keyword) OR contains(headers, keyword) OR contains(url, keyword) OR contains(body, keyword) GROUP BY 1, 2, 3),
scored AS (SELECT *, round(raw + t * 2.0 + h * 2.5 + u * 0.5 + b * 0.1, 6)::DOUBLE AS match, round(raw + t * 2.0 + h * 2.5 + u * 0.5 + b * 0.1, 6)::DOUBLE + CASE WHEN type = 'general' THEN 0.5 ELSE 0 END AS weighted FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weighted DESC, raw DESC, domain_id) AS rank FROM scored)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([(i, k, n, desc, [kw]) for i, k, n, desc, kw in DOMAINS], "domain_id string, type string, name string, description string, keywords array<string>")
    rows = t.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 60).alias("headers"), F.col("text").alias("body"))
    return pages.domain_scores(rows, pages.domain_keywords(table))


@R.add(f"WITH {PAGE_SCORES_SQL} SELECT page_id, domain_id, raw::BIGINT AS raw, match, weighted, rank::INTEGER AS rank FROM ranked WHERE rank <= 3", common=False)
def page_domain_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three best domains of each page."""
    return _scored(spark, d).where("rank <= 3").select("page_id", "domain_id", "raw", "match", "weighted", "rank")


@R.add(f"""WITH {PAGE_SCORES_SQL} SELECT doc_id AS page_id, CASE WHEN doc_id % 50 = 0 THEN 'related' WHEN coalesce(best, 0) < 4 THEN CASE WHEN doc_id % 20 = 1 THEN 'related' ELSE 'unrelated' END WHEN n_chars > 5000 THEN 'index' ELSE 'related' END AS status
FROM documents LEFT JOIN (SELECT page_id, max(match) AS best FROM scored GROUP BY 1) s ON s.page_id = doc_id""", common=False)
def page_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each page by its best domain."""
    best = _scored(spark, d).groupBy("page_id").agg(F.max("match").alias("best"))
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "n_chars")
    out = docs.join(best, "page_id", "left")
    return out.select("page_id", pages.page_status(F.col("page_id") % 50 == 0, F.col("page_id") % 20 == 1, F.col("n_chars") > 5000, F.col("best")).alias("status"))


@R.add(f"WITH {PAGE_SCORES_SQL} SELECT d AS domain_id, coalesce(n, 0)::BIGINT AS n_pages FROM (SELECT DISTINCT domain_id AS d FROM kw) LEFT JOIN (SELECT domain_id, count(*) AS n FROM scored WHERE match >= 12 GROUP BY 1) ON domain_id = d WHERE coalesce(n, 0) < 300", common=False)
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Domains with fewer pages than wanted."""
    found = _scored(spark, d).where("match >= 12").groupBy("domain_id").agg(F.count("*").alias("n"))
    ids = spark.createDataFrame([(x[0],) for x in DOMAINS], "domain_id string")
    return ids.join(found, "domain_id", "left").select("domain_id", F.coalesce("n", F.lit(0)).alias("n_pages")).where("n_pages < 300")


@R.add("""SELECT doc_id, len(w)::INTEGER AS words, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z]') OR regexp_matches(x, '^[A-Z]{2,5}$')))::INTEGER AS capitals
FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda x: length(x) >= 3) AS w FROM documents)""", common=False)
def capital_words(spark: SparkSession, d: str) -> DataFrame:
    """B19."""
    words, capitals = text.capital_share(F.col("text"))
    return t.table(spark, d, "documents").select("doc_id", words.alias("words"), capitals.alias("capitals"))


@R.add(r"""SELECT doc_id, ceil(ceil(length(text) / 3) + (length(text) - length(regexp_replace(text, '[§()\[\].,:;]', '', 'g'))) * 0.1::DOUBLE + len(regexp_extract_all(text, '[0-9]+')) * 0.2::DOUBLE)::BIGINT AS tokens FROM documents""", common=False)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """H11."""
    return t.table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@R.add()
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """Numbered chunks of each document; packing depends on the chunks before, so tests hold it."""
    docs = t.table(spark, d, "documents").select("doc_id", chunk.chunks(F.col("text")).alias("chunks"))
    return docs.select("doc_id", F.posexplode("chunks").alias("chunk_index", "content")).withColumn("chunk_id", F.concat("doc_id", F.lit("-"), "chunk_index"))


@R.add(r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(refs[1:3])), '|') AS refs FROM (SELECT p_partkey, regexp_extract_all('See Section ' || p_size || '.' || (p_partkey % 10) || ' and § ' || p_size || ' or Section ' || p_size || '.' || (p_partkey % 10) || ' of Section 9.', '(?:Section|§)\s*\d+(?:[.-]\d+)*') AS refs FROM part)""", common=False)
def section_references(spark: SparkSession, d: str) -> DataFrame:
    """H16, on made-up references."""
    size, rest = F.col("p_size"), F.col("p_partkey") % 10
    told = F.concat(F.lit("See Section "), size, F.lit("."), rest, F.lit(" and § "), size, F.lit(" or Section "), size, F.lit("."), rest, F.lit(" of Section 9."))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.section_references(told)), "|").alias("refs"))


FACTS = "'Trees over ' || p_size || ' inches DBH or ' || (p_size + 3) || ' inches DBH need a permit; a fine of $' || p_partkey || ' or $1,' || lpad((p_size)::VARCHAR, 3, '0') || '; replacement ' || (p_size % 3 + 1) || ':1 by an arborist'"


@R.add(f"""SELECT p_partkey, list_min(list_transform(regexp_extract_all(x, '(?i)(\\d+)\\s*inch(?:es)?\\s*DBH', 1), lambda v: v::INTEGER)) AS inches, list_max(list_transform(regexp_extract_all(x, '\\$([\\d,]+)', 1), lambda v: replace(v, ',', '')::BIGINT)) AS dollars,
  regexp_extract(x, '(\\d+:\\d+)', 1) AS ratio, 'Higher penalties needed|Professional consultation required|Mandatory replacement standards|Permit process improvements' AS gaps FROM (SELECT p_partkey, {FACTS} AS x FROM part)""", common=False)  # fmt: skip
def quantitative_facts(spark: SparkSession, d: str) -> DataFrame:
    """H40, H42, on made-up answers."""
    told = F.expr(FACTS.replace("::VARCHAR", "").replace("(p_size)", "cast(p_size as string)"))
    rows = t.table(spark, d, "part").select("p_partkey", told.alias("x"))
    x = F.col("x")
    return rows.select("p_partkey", text.least_inches(x).alias("inches"), text.most_dollars(x).alias("dollars"), text.replacement_ratio(x).alias("ratio"), F.array_join(text.gap_categories(x), "|").alias("gaps"))


@R.add("""SELECT p_partkey, round(greatest(0.1, least(1.0, 0.5 + CASE WHEN p_size % 2 = 0 THEN 0.15 + 0.1 + 0.1 ELSE 0 END + 0.1 + CASE WHEN p_size % 3 = 0 THEN -0.1 ELSE 0 END)), 6)::DOUBLE AS score FROM part""", common=False)
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    """H32, on made-up answers: a permit always, a height in feet (which holds a fee) for even sizes, vagueness for every third."""
    told = F.concat(F.lit("A permit is due"), F.when(F.col("p_size") % 2 == 0, F.lit(" at a height of 12 feet")).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit(" in vague cases")).otherwise(""))
    return t.table(spark, d, "part").select("p_partkey", F.round(scoring.rubric_score(told), 6).alias("score"))


@R.add(r"""WITH c AS (SELECT conv_id, turn, role, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS fp FROM conversations)
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, fp ORDER BY turn) AS rn FROM c) WHERE rn = 1""", common=False)
def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Of a conversation's turns with one fingerprint the first."""
    rows = t.table(spark, d, "conversations").select("conv_id", "turn", "role", text.fingerprint(F.col("text")).alias("fp"))
    return versions.first_of(rows, ["conv_id", "fp"], ["turn"]).select("conv_id", "turn", "role")


@R.add(r"""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM conversations)
SELECT a.conv_id, a.turn, floor(coalesce(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0) * 1e6 + 0.5) / 1e6 AS jaccard FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""", common=False)
def turn_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each turn with the next."""
    rows = t.table(spark, d, "conversations").select("conv_id", "turn", text.long_words(F.col("text")).alias("w"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", (F.floor(text.jaccard(F.col("w"), F.col("v")) * 1e6 + 0.5) / 1e6).alias("jaccard"))


@R.add("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Customer' || right(c_name, 9) ELSE 'Customer' || right(c_name, 9) || '-' || CASE WHEN c_custkey % 5 = 1 THEN 'Town' ELSE lower(c_mktsegment) END END AS key,
  regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS token, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS id, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug FROM customer""", common=False)
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    """Keys of entities by name and type."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    cell = F.when(F.col("c_custkey") % 5 == 0, name).otherwise(F.concat(name, F.lit(" ("), F.when(F.col("c_custkey") % 5 == 1, F.lit("Town/Village")).otherwise(F.lower("c_mktsegment")), F.lit(")")))
    return t.table(spark, d, "customer").select("c_custkey", text.name_part(cell).alias("key"), text.token(F.col("c_name")).alias("token"), text.identifier(F.col("c_name")).alias("id"), urls.slug(F.col("c_name")).alias("slug"))


@R.add("""SELECT page_id, '# ' || url || ' downloaded at 2026-01-01, converted at 2026-01-02' || chr(10) || chr(10) || trim(url) AS artifact, url AS back, trim(url) AS body FROM pages""", common=False)
def artifact_texts(spark: SparkSession, d: str) -> DataFrame:
    """The header is written and read back."""
    made = text.artifact(F.col("url"), F.lit("2026-01-01"), F.lit("2026-01-02"), F.col("url"))
    return t.table(spark, d, "pages").select("page_id", made.alias("artifact"), text.artifact_url(made).alias("back"), text.artifact_body(made).alias("body"))


@R.add("""SELECT source AS city, lang AS state, count(*)::BIGINT AS n_docs, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang, source)""", common=False)
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and characters of each place, with totals."""
    docs = t.table(spark, d, "documents").select(F.col("source").alias("city"), F.col("lang").alias("state"), F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).alias("w"), F.length("text").alias("c"))
    return docs.rollup("state", "city").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"), F.sum("c").alias("n_chars")).select("city", "state", "n_docs", "n_words", "n_chars")
