"""Maintenance of a collection: what is indexed, classified, recomputed, mended and listed, and in which order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text, urls
from quorumlake.functions.numbers import COLOURS
from quorumlake.operators import pages, scoring

KEY = ["entity_id", "domain_id"]
#: Words that mark an index page, and those that mark a link to one.
INDEX_WORDS = r"\b(index|table of contents|contents|sitemap|directory)\b"
INDEX_LINKS = r"\b(index|directory|departments|boards?|commissions?)\b"
#: Links from which a page counts as an index, words of names that tell nothing, types of entities.
INDEX_LEAST = 40
COMMON_WORDS = ("town", "city", "village", "of", "the", "and", "on", "hudson", "manor")
TYPES = ("Town", "City", "Village", "County")


def index_page(url: Column, title: Column, body: Column, n_links: Column) -> Column:
    """A marker in address or title, forty links, or the density of an index in the text."""
    marked = F.lower(F.concat_ws(" ", url, title)).rlike(INDEX_WORDS)
    return marked | (n_links >= INDEX_LEAST) | F.coalesce(text.dense_index(F.concat_ws("\n", title, body)), F.lit(False))


def classified_links(links: DataFrame, keywords: DataFrame, threshold: float = pages.MATCH) -> DataFrame:
    """Links (page_id, url, text) as unrelated without a domain's match, else index by their signals, else related.

    A link's text stands for title, headers and body of a page with its address.
    """
    rows = links.withColumn("link_id", F.struct("page_id", "url"))
    told = rows.select(F.col("link_id").alias("page_id"), "url", F.col("text").alias("title"), F.col("text").alias("headers"), F.col("text").alias("body"))
    best = pages.domain_scores(told, keywords).groupBy(F.col("page_id").alias("link_id")).agg(F.max("match").alias("best"))
    signal = F.lower(F.concat_ws(" ", "text", "url")).rlike(INDEX_LINKS) | index_page(F.col("url"), F.col("text"), F.col("text"), F.lit(0))
    status = F.when(F.coalesce("best", F.lit(0.0)) < threshold, "unrelated").when(signal, "index").otherwise("related")
    return rows.join(best, "link_id", "left").select("page_id", "url", "text", status.alias("status"))


def chunks_of_url(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """all chunks of each asked entity_id, domain_id and url, by match form, numbered in order of their index."""
    rows = chunks.withColumn("form", urls.match_form(F.col("url"))).withColumn("domain_id", F.explode("domain_ids"))
    wants = asked.select("entity_id", "domain_id", urls.match_form(F.col("url")).alias("form")).distinct()
    order = Window.partitionBy("entity_id", "domain_id", "form").orderBy("chunk_index", "chunk_id")
    return rows.join(wants, ["entity_id", "domain_id", "form"]).withColumn("n", F.row_number().over(order))


def downloads_with_history(downloads: DataFrame, history: DataFrame) -> DataFrame:
    """Downloads (entity_id, file) with url, ts and file_type of the first record whose file has their name."""
    name = F.regexp_extract(F.coalesce("text_file", "file"), "([^/]*)$", 1)
    first = history.groupBy("entity_id", name.alias("file")).agg(F.min_by(F.struct("url", "ts", "file_type"), "position").alias("r"))
    return downloads.join(first, ["entity_id", "file"], "left").select(*downloads.columns, "r.url", "r.ts", "r.file_type")


def index_decision(n_domains: Column, ts: Column, as_of: Column, hours: float, file_type: Column, url: Column, indexed: Column) -> Column:
    """Why a download isn't indexed, or index."""
    old = F.unix_micros(ts.cast("timestamp")) < F.unix_micros(as_of.cast("timestamp")) - int(hours * 3_600_000_000)
    pdf = F.coalesce(file_type == "PDF", F.lit(False)) | F.coalesce(url.rlike(r"(?i)\.pdf(\?.*)?$"), F.lit(False))
    return F.when(n_domains == 0, "no domain").when(F.coalesce(old, F.lit(False)), "old").when(pdf, "pdf").when(F.coalesce(indexed, F.lit(False)), "indexed").otherwise("index")


def domain_questions(domains: DataFrame, questions: DataFrame) -> DataFrame:
    """Every domain with its questions in order, how many and their weight; a weight of 0 or none counts 1."""
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    own = questions.groupBy("domain_id").agg(F.count("*").alias("n_questions"), F.sum(weight).alias("total_weight"), F.sort_array(F.collect_list("question_id")).alias("questions"))
    return domains.select("domain_id").join(own, "domain_id", "left").select("domain_id", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("total_weight", F.lit(0)).alias("total_weight"), F.coalesce("questions", F.array().cast("array<int>")).alias("questions"))


def rescored(analyses: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Stored scores made anew from the answers that are there: old and new overall score, skipped without answers."""
    new = scoring.normalized_scores(answers, questions).select(*KEY, "normalized")
    state = F.when(F.col("normalized").isNull(), "skipped").when(F.col("normalized").eqNullSafe(F.col("overall_score")), "same").otherwise("updated")
    return analyses.join(new, KEY, "left").select(*KEY, "overall_score", F.coalesce("normalized", "overall_score").alias("new_score"), state.alias("state"))


def with_grades(analyses: DataFrame, rulesets: DataFrame, grading: str) -> DataFrame:
    """The grade of an analysis' ruleset put into its map of grades: the code its cell begins with, else the grade field."""
    code = F.upper(F.nullif(F.regexp_extract("cell", "(?i)^([GRY][+-]?)", 1), F.lit("")))
    grade = F.when(F.coalesce("cell", F.lit("")) != "", code).otherwise(F.col("grade"))
    found = rulesets.select(*KEY, grade.alias("__grade")).where("__grade IS NOT NULL")
    kept = F.map_filter("grades", lambda k, v: k != grading)
    return analyses.join(found, KEY, "left").withColumn("grades", F.when(F.col("__grade").isNull(), F.col("grades")).otherwise(F.map_concat(kept, F.create_map(F.lit(grading), F.col("__grade"))))).drop("__grade")


def changed_domains(old: DataFrame, scores: DataFrame, threshold: float = pages.MATCH) -> DataFrame:
    """Pages (page_id, domain_ids) whose set of matching domains isn't the stored one, with both."""
    new = scores.where(F.col("match") >= threshold).groupBy("page_id").agg(F.sort_array(F.collect_set("domain_id")).alias("new_ids"))
    rows = old.join(new, "page_id", "left").withColumn("new_ids", F.coalesce("new_ids", F.array().cast("array<string>"))).withColumn("domain_ids", F.sort_array("domain_ids"))
    return rows.where("domain_ids <> new_ids")


def name_and_type(cell: Column) -> Column:
    """Struct of name and type of a cell: a type in brackets, or a bare one at its end, else none."""
    inner = F.regexp_replace(F.regexp_extract(cell, r"\(([^)]*)\)", 1), "/.*$", "")
    bare = F.regexp_extract(F.trim(cell), r"(?i)\s+(" + "|".join(TYPES) + ")$", 1)
    plain = lambda x: F.regexp_replace(x, "[^a-zA-Z0-9-]", "")
    of_type = F.initcap(bare)
    before = F.regexp_replace(F.trim(cell), r"(?i)\s+(" + "|".join(TYPES) + ")$", "")
    kind = F.when(inner != "", inner).when(bare != "", of_type)
    return F.struct(F.when((inner == "") & (bare != ""), plain(before)).otherwise(plain(F.regexp_extract(cell, r"^([^(]*)", 1))).alias("name"), kind.alias("type"))


def plain_type(cell: Column) -> Column:
    """The value of a type column."""
    return F.when(F.trim(cell) == "Town/Village", "Town").otherwise(F.regexp_replace(F.trim(cell), "[^a-zA-Z0-9]", ""))


#: What stands where a text was cut, and the characters that are kept free for it.
CUT, CUT_ROOM = "\n\n[Text truncated to fit context limit...]", 100


def truncated(body: Column, tokens: int) -> Column:
    """A text of four characters a token at most, with a note where it was cut."""
    return F.when(F.length(body) <= 4 * tokens, body).otherwise(F.concat(F.substring(body, 1, 4 * tokens - CUT_ROOM), F.lit(CUT)))


def name_tokens(name: Column) -> Column:
    """Words of four letters or more, without common ones, each once."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z\s-]", " "), r"\s+", " ")), r"[\s-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS)))


def affiliate(host: Column, tokens: Column) -> Column:
    """Whether a host holds one of an entity's words."""
    return F.exists(tokens, lambda w: F.contains(F.lower(host), w))


def state_of_id(entity_id: Column) -> Column:
    """Two letters before a dash, null without."""
    return F.upper(F.nullif(F.regexp_extract(entity_id, "^([A-Za-z]{2})-", 1), F.lit("")))


def urls_of_cell(cell: Column) -> Column:
    """Sources for the addresses that stand in a cell, in order."""
    found = F.regexp_extract_all(cell, F.lit(r"(https?://[^\s,;)]+)"), F.lit(1))
    return F.transform(found, lambda u: F.struct(u.alias("source_url"), F.lit("statute").alias("type")))


def first_library(url: Column, libraries: Sequence[tuple[str, str]]) -> Column:
    """Name of the first library whose pattern the address holds."""
    return F.coalesce(*(F.when(F.contains(F.lower(url), F.lit(p.lower())), F.lit(n)) for n, p in libraries))


def usable_url(url: Column, download: Column) -> Column:
    """An address to load: none and n/a pass, unless loading is switched off."""
    return F.coalesce(download, F.lit(True)) & ((F.coalesce(F.trim(url), F.lit("")) == "") | (F.lower(F.trim(url)) == "n/a") | F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)))


def filled_url(old: Column, found: Column, valid: Column, force: bool = False) -> Column:
    """A found address that was validated where there is none, or everywhere if forced."""
    new = F.when(valid, found)
    return F.coalesce(new, old) if force else F.coalesce(F.nullif(old, F.lit("")), new)


def menu_due(ts: Column, as_of: Column, days: int = 7) -> Column:
    """As the stored files have it: true while a menu link is at most so many days old."""
    return F.coalesce(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) <= days * 86_400_000_000, F.lit(True))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 inside their group: the stored form of an order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def size_rank(kind: Column) -> Column:
    """towns are drawn first, then cities, then villages, then the rest."""
    return F.when(kind == "Town", 0).when(kind == "City", 1).when(kind == "Village", 2).otherwise(3)


def highlights(facts: DataFrame) -> DataFrame:
    """Facts (domain_id, position, facts) of a domain's top answers, each once, in order of their first place."""
    each = facts.select("domain_id", "position", F.posexplode("facts").alias("at", "fact"))
    first = each.groupBy("domain_id", "fact").agg(F.min(F.struct("position", "at")).alias("first"))
    return first.groupBy("domain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "fact"))), lambda x: x["fact"]).alias("facts"))


def rewrite_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of each entity that a rewrite changed or left, and the bytes it saved.  before, after: entity_id, file, body."""
    both = before.join(after.withColumnRenamed("body", "new"), ["entity_id", "file"])
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    changed = ~F.col("body").eqNullSafe(F.col("new"))
    return both.groupBy("entity_id").agg(F.count_if(changed).alias("n_changed"), F.count_if(~changed).alias("n_same"), F.sum(size(F.col("body")) - size(F.col("new"))).cast("long").alias("bytes_saved"))


def cell_address(cells: DataFrame, hyperlinks: DataFrame) -> DataFrame:
    """Cells (row, col, value) with the address in them, else that of the hyperlink laid on them (its rows count from 1)."""
    laid = hyperlinks.select((F.col("row") - 1).alias("row"), "col", F.col("url").alias("__link"))
    written = F.nullif(F.regexp_extract("value", r"(https?://\S+)", 1), F.lit(""))
    return cells.join(laid, ["row", "col"], "left").select("row", "col", "value", F.coalesce(written, F.col("__link")).alias("url"))


def recovered(files: DataFrame, history: DataFrame) -> DataFrame:
    """Local files (entity_id, url, file) that no record names, by address or by file."""
    return files.join(history.select("entity_id", "url"), ["entity_id", "url"], "left_anti").join(history.select("entity_id", "file"), ["entity_id", "file"], "left_anti").select("entity_id", "url", "file")


def feature_colours(features: DataFrame, summary: DataFrame, data: DataFrame, default: str = "#cccccc") -> DataFrame:
    """Colour of a map feature: of its data row, else grey-blue under the state's code, else of its summary, else the default."""
    rows = features.join(summary.select("entity_id", "state_code", F.col("colour").alias("__s")), "entity_id", "left").join(data.select("entity_id", F.col("colour").alias("__d")), "entity_id", "left")
    return rows.select("feature_id", "entity_id", F.coalesce("__d", F.when(F.col("state_code"), F.lit(COLOURS["gray"])), "__s", F.lit(default)).alias("colour"))


def with_scoring(data: DataFrame, config: DataFrame) -> DataFrame:
    """A domain's data with the scoring of its configuration, its own where that has none."""
    return data.join(config.select("domain_id", F.col("scoring").alias("__s")), "domain_id", "left").withColumn("scoring", F.coalesce("__s", "scoring")).drop("__s")


def relevant(judged: DataFrame, least_chars: int = 200, least_confidence: float = 60) -> DataFrame:
    """Candidates of some length that a judge found relevant with some confidence."""
    return judged.where((F.length("content") >= least_chars) & F.col("is_relevant") & (F.col("confidence") >= least_confidence))


def model_settings(config: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Tokens a minute and price of each model, defaults where they are missing, times a buffer of 0.5 to 1."""
    buffer = F.when(F.col("buffer").between(0.5, 1.0), F.col("buffer")).otherwise(F.lit(float(defaults["buffer"])))
    limit = F.coalesce("tokens_per_minute", F.lit(int(defaults["tokens_per_minute"])))
    return config.select("model", limit.alias("tokens_per_minute"), buffer.alias("buffer"), F.floor(limit * buffer).alias("usable"))


def folder_entity(name: Column, prefix: str) -> Column:
    """Struct of name and type of a folder prefix + Name-Type, the name's words apart; null for another folder."""
    parts = rf"^{prefix}([A-Za-z0-9]+)-([A-Za-z]+)$"
    apart = F.regexp_replace(F.regexp_extract(name, parts, 1), "([a-z])([A-Z])", "$1 $2")
    return F.when(name.rlike(parts), F.struct(apart.alias("name"), F.regexp_extract(name, parts, 2).alias("type")))


def entity_rows(sheet: DataFrame, state: str) -> DataFrame:
    """Rows of a sheet (cell) as entities; rows of notes and headings are left out."""
    kept = sheet.where(~F.lower(F.trim("cell")).rlike("^(environmental|key:)") & (F.trim("cell") != ""))
    named = kept.select(name_and_type(F.col("cell")).alias("x")).select("x.*").where("name <> ''")
    return named.select(F.concat(F.lit(state + "-"), "name", F.coalesce(F.concat(F.lit("-"), "type"), F.lit(""))).alias("entity_id"), "name", "type", F.lit(state).alias("state")).distinct()


def migrated_links(entities: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Flat addresses (field: type of link) become an array of links, after those that are there already."""
    flat = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(F.lit(k).alias("type"), F.col(f).alias("url"))) for f, k in fields.items())))
    had = F.transform("links", lambda x: x["type"])
    return entities.withColumn("links", F.concat("links", F.filter(flat, lambda x: ~F.array_contains(had, x["type"])))).drop(*fields)


def realm_terms(realms: DataFrame) -> DataFrame:
    """Words and labels of a realm, with defaults, and which realm comes first."""
    first = realms.agg(F.min("position").alias("least"))
    label = F.when(F.col("entity_type") == "school", "School districts").otherwise("Municipalities")
    return realms.crossJoin(F.broadcast(first)).select("realm_id", F.coalesce(F.nullif("rule_type", F.lit("")), F.lit("statute")).alias("rule_type"), label.alias("label"), (F.col("position") == F.col("least")).alias("is_default"))


def post_filtered(hits: DataFrame, wanted: Column, k: int) -> DataFrame:
    """Of the best 3 k hits of a query those that are wanted, k at most."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.where(F.col("rank") <= 3 * k).where(wanted).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def first_hosts(websites: DataFrame) -> DataFrame:
    """Host and address of each entity's sites, from a map of hosts or an older list of addresses."""
    listed = F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.struct(urls.hostname(u).alias("key"), u.alias("value")))
    pairs = F.when(F.col("hosts").isNotNull(), F.map_entries("hosts")).otherwise(listed)
    return websites.select("entity_id", F.explode(pairs).alias("x")).select("entity_id", F.col("x.key").alias("host"), F.col("x.value").alias("url"))


def cached_pages(history: DataFrame, artifacts: DataFrame, sample: int = 3000) -> DataFrame:
    """Records with the text of their artifact, without its header, and a sample of it."""
    body = text.artifact_body(F.col("content"))
    return history.join(artifacts, ["entity_id", "file"]).select("entity_id", "url", F.length(body).alias("n_chars"), F.substring(body, 1, sample).alias("sample"))


def scoped_practices(best: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """Best practices of a partial update: stale questions take the fresh ones, all others stay, in order of question."""
    kept = best.join(stale.select("domain_id", "question_id"), ["domain_id", "question_id"], "left_anti")
    return kept.unionByName(fresh.join(stale.select("domain_id", "question_id"), ["domain_id", "question_id"], "left_semi"))


def article_links(pages_: DataFrame) -> DataFrame:
    """Articles that a page's list of contents names, in order: page_id, position, title, url.

    Links of class titleLink whose number names an article and whose address has another path than the page itself.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*class=[\"'][^\"']*titleLink[^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    rows = pages_.select("page_id", "url", F.posexplode(tags).alias("position", "tag"))
    title = F.trim(F.regexp_extract("tag", r"(?is)class=[\"']titleNumber[\"'][^>]*>(.*?)<", 1))
    href = F.regexp_extract("tag", r"(?is)\bhref=[\"']([^\"']*)[\"']", 1)
    root = F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1)
    full = F.when(href.startswith("http"), href).when(href.startswith("#"), F.concat("url", href)).otherwise(F.concat(root, href))
    found = rows.select("page_id", "position", title.alias("title"), full.alias("to"), urls.path(F.col("url")).alias("__own"))
    return found.where(F.contains("title", F.lit("Article")) & (urls.path(F.col("to")) != F.col("__own"))).select("page_id", "position", "title", F.col("to").alias("url"))


def stitched(articles: DataFrame, bodies: DataFrame, least: int = 50) -> DataFrame:
    """The texts of a page's articles in order, each under its title; short ones are left out."""
    part = F.concat(F.lit("\n\n=== "), "title", F.lit(" ===\n\n"), "body")
    rows = articles.join(bodies.where(F.length("body") > least), "url").select("page_id", F.struct("position", part.alias("part")).alias("p"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_articles"), F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["part"]), "").alias("text"))


def file_types(records: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """File types of related and index records by the first bytes of their files.

    records: entity_id, url, status, file, file_type; files: path, content (binary, as Spark's binaryFile gives it).
    Returns the records with file_type and action: patched, correct, skipped (another status, or a type that is known and
    not to be forced), missing (no such file) or download (no file yet).  Only the first bytes of a file are shuffled.
    """
    head = files.select(F.col("path").alias("file"), F.when(F.decode(F.substring("content", 1, 4), "ISO-8859-1") == "%PDF", "PDF").otherwise("HTML").alias("found"))
    rows = records.join(head, "file", "left")
    open_ = F.col("status").isin("related", "index") & (F.lit(force) | F.col("file_type").isNull())
    action = F.when(~F.coalesce(open_, F.lit(False)), "skipped").when(F.col("file").isNull(), "download").when(F.col("found").isNull(), "missing").when(F.coalesce(F.col("file_type") == F.col("found"), F.lit(False)), "correct").otherwise("patched")
    rows = rows.withColumn("action", action)
    return rows.withColumn("file_type", F.when(F.col("action") == "patched", F.col("found")).otherwise(F.col("file_type"))).drop("found")


def numbered_everywhere(rows: DataFrame, order: Sequence[Column], folder: str, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in one order over all of them, without a task that has them all.

    Rows are sorted by ranges and written with their place in their range; the ranges' sizes, a number for each, make the
    rest.  Ties of the order are numbered in any order, so let it end with a key.
    """
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()  # the range's number, then the place in it
    rows.orderBy(*order).withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)).write.parquet(folder)
    placed = spark.read.parquet(folder)
    sizes = sorted((r["__range"], r["n"]) for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect())
    firsts = [(k, sum(n for _, n in sizes[:i]) + 1) for i, (k, _) in enumerate(sizes)]
    joined = placed.join(F.broadcast(spark.createDataFrame(firsts, "__range long, __first long")), "__range")
    return joined.withColumn(name, F.col("__first") + F.col("__at")).drop("__range", "__at", "__first")
