"""The document store: trees of JSON, text and CSV files as tables, and sinks that keep versions.

Paths may be in any store that Spark reads.  Nothing is listed or opened outside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quorumlake.sources import document_tree

REALM = "id string, name string, displayName string, state string, ruleType string, entityType string, entityFile string, datapath string"
ENTITY = "id string, name string, displayName string, type string, state string, test boolean"
DOMAIN = "id string, name string, displayName string, description string, type string, show boolean, keywords array<string>"
QUESTION = "id string, question string, text string, category string, weight double, `order` string"
ANSWER = "id string, questionId string, answer string, score double, confidence double, gap string, gapAnalysis string"
ANALYSIS = f"entityId string, domainId string, municipality struct<id:string>, domain struct<id:string>, overallScore double, questions array<struct<{ANSWER.replace(' string', ':string').replace(' double', ':double')}>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; a missing path is an empty table, a file that can't be read gives a row of nulls."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _listed(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Rows of an array: of the document's field, or of the document itself."""
    inner = spark.createDataFrame([], item).schema
    rows = _json(spark, path, f"{field} array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in inner.fields)}>>")
    wrapped = rows.where(F.col(field).isNotNull()).select(F.explode(field).alias("x")).select("x.*")
    bare = _json(spark, path, item)
    return wrapped.unionByName(bare.where(F.coalesce(*(F.col(f"`{f.name}`").cast("string") for f in inner.fields)).isNotNull()))


def realms(spark: SparkSession, root: str) -> DataFrame:
    """A01."""
    return _listed(spark, f"{root}/realms.json", "realms", REALM)


def realm(spark: SparkSession, root: str, realm_id: str) -> T.Row:
    """One realm; an unknown id tells which there are."""
    rows = realms(spark, root)
    found = rows.where(F.col("id") == realm_id).limit(1).collect()
    if not found:
        known = [r.id for r in rows.select("id").limit(1000).collect()]
        raise KeyError(f"no realm {realm_id}; there are {', '.join(known)}")
    return found[0]


def entities(spark: SparkSession, root: str, realm_id: str, file: str = "entities.json") -> DataFrame:
    """A03, A04."""
    return _listed(spark, f"{root}/{realm_id}/{file}", "entities", ENTITY)


def domains(spark: SparkSession, root: str, realm_id: str) -> DataFrame:
    """A05."""
    return _listed(spark, f"{root}/{realm_id}/domains.json", "domains", DOMAIN)


def questions(spark: SparkSession, root: str, realm_id: str, domain_id: str) -> DataFrame:
    """With their position, by the number in their order."""
    rows = _listed(spark, f"{root}/{realm_id}/{domain_id}/questions.json", "questions", QUESTION)
    return rows.select("id", F.coalesce("question", "text").alias("question"), "category", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce(F.col("order").try_cast("double"), F.lit(0.0)).alias("position")).orderBy("position", F.col("id"))


def analyses(spark: SparkSession, root: str, realm_id: str, domain_id: str = "*", entity_id: str = "*") -> DataFrame:
    """Documents with their keys from older fields or the path, answers exploded by position."""
    path = F.col("_metadata.file_path")
    rows = _json(spark, f"{root}/{realm_id}/{domain_id}/{entity_id}/analysis.json", ANALYSIS)
    if not rows.inputFiles():
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("path", path)
    skip = lambda c: F.nullif(c, F.lit(""))
    keyed = rows.select(
        F.coalesce(skip(F.col("entityId")), skip(F.col("municipality.id")), F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).alias("entity_id"), F.coalesce(skip(F.col("domainId")), skip(F.col("domain.id")), F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1)).alias("domain_id"),
        "overallScore", F.posexplode_outer("questions").alias("pos", "q"),
    )
    return keyed.select("entity_id", "domain_id", F.col("overallScore").alias("overall_score"), "pos", F.coalesce("q.id", "q.questionId").alias("question_id"), "q.answer", "q.score", normal(F.col("q.confidence")).alias("confidence"), F.coalesce("q.gap", "q.gapAnalysis").alias("gap"))


def entity_ids(spark: SparkSession, root: str, realm_id: str, domain_id: str) -> DataFrame:
    """The entities that have a folder in a domain, by a listing of its files alone."""
    files = spark.read.format("binaryFile").load(f"{root}/{realm_id}/{domain_id}/*/*").select("path")
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("entity_id")).distinct()


def one_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A point read: the row of a key, none if there is none; the comparison reaches the scan."""
    return rows.where(F.col(key) == value)


RULESET = "homePage string, stateCodeApplies boolean, sources array<struct<sourceUrl:string,title:string,type:string,provenance:string,downloadedFilename:string>>"
PRACTICE = "questionId int, questionText string, bestAnswer string, bestScore double, bestEntity struct<id:string,displayName:string>"
META = f"domain struct<id:string>, averageScore double, totalMunicipalitiesAnalyzed long, highestScoringEntity struct<id:string,score:double>, bestPractices array<struct<{PRACTICE.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' struct', ':struct')}>>"


def parsed(documents: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Documents whose text is JSON of the schema, as column doc; blank and broken ones are as good as missing."""
    broken = "__broken"
    doc = F.from_json(F.col(content), f"{schema}, {broken} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    rows = documents.where(F.trim(F.regexp_replace(content, r"\s+", " ")) != "").withColumn("doc", doc)
    return rows.where(F.col("doc").isNotNull() & F.col(f"doc.{broken}").isNull()).withColumn("doc", F.col("doc").dropFields(broken)).drop(content)


def rulesets(documents: DataFrame) -> DataFrame:
    """realm_id, domain_id, entity_id, home_page, state_code, sources of metadata.json; documents as document_tree reads them."""
    rows = parsed(documents.where("name = 'metadata.json'"), RULESET)
    return rows.select("realm_id", "domain_id", "entity_id", F.col("doc.homePage").alias("home_page"), F.coalesce("doc.stateCodeApplies", F.lit(False)).alias("state_code"), "doc.sources")


def meta_analyses(spark: SparkSession, pattern: str) -> DataFrame:
    """domain_id, mean_score, n_analysed, best_entity and practices of the meta-analyses that a pattern names."""
    rows = parsed(spark.read.text(pattern, wholetext=True).withColumnRenamed("value", "content"), META)
    return rows.select(F.col("doc.domain.id").alias("domain_id"), F.col("doc.averageScore").alias("mean_score"), F.col("doc.totalMunicipalitiesAnalyzed").alias("n_analysed"), F.col("doc.highestScoringEntity.id").alias("best_entity"), F.col("doc.bestPractices").alias("practices"))


def additional_sources(downloads: DataFrame) -> DataFrame:
    """entity_id, domain_id, file, content: a row for each related download and domain that it belongs to.

    Rows and not a list, so an entity may have any number; what needs them in one text orders and joins its own few.
    """
    related = downloads.where("status = 'related' AND content IS NOT NULL")
    return related.select("entity_id", F.explode(F.array_distinct("domain_ids")).alias("domain_id"), "file", "content")


def source_map(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, position, url, title of sources.json, an object of entities with arrays of sources."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<url:string,title:string>>>").alias("m"))
    return rows.select(F.explode("m").alias("entity_id", "s")).select("entity_id", F.posexplode("s").alias("position", "x")).select("entity_id", "position", "x.url", "x.title")


def source_titles(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """entity_id, url, title: of several sources of an address the first counts; null if there is none."""
    first = sources.groupBy("entity_id", "url").agg(F.min_by(F.struct("title"), "position").alias("r")).select("entity_id", "url", "r.title")
    return wanted.join(first, ["entity_id", "url"], "left")


def save_websites(hosts: DataFrame, root: str, realm_id: str) -> None:
    """The hosts of each entity as its websites.json, in place of the last one.

    hosts: entity_id, host, header, footer, content (selectors).  A document is a version (see document_tree), so a write
    that fails leaves the last one.
    """
    record = F.struct(F.col("host").alias("hostname"), F.col("header").alias("activeHeaderSelector"), F.col("footer").alias("activeFooterSelector"), F.col("content").alias("contentSelector"))
    by_host = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("host").alias("key"), record.alias("value")))))
    docs = hosts.groupBy("entity_id").agg(F.to_json(F.struct(by_host.alias("hosts"))).alias("content"))
    rows = docs.select(F.lit(realm_id).alias("realm_id"), F.lit("_websites").alias("domain_id"), F.col("entity_id").cast("string").alias("entity_id"), F.lit("websites.json").alias("name"), "content")
    document_tree.save(rows, root)


def websites(documents: DataFrame) -> DataFrame:
    """entity_id, host, header, footer, content of each websites.json."""
    rows = parsed(documents.where("name = 'websites.json'"), "hosts map<string,struct<hostname:string,activeHeaderSelector:string,activeFooterSelector:string,contentSelector:string>>")
    each = rows.select("entity_id", F.explode("doc.hosts").alias("host", "x"))
    return each.select("entity_id", "host", F.col("x.activeHeaderSelector").alias("header"), F.col("x.activeFooterSelector").alias("footer"), F.col("x.contentSelector").alias("content"))


def normal(confidence: Column) -> Column:
    return F.when(confidence > 1, confidence / 100).otherwise(confidence)


def texts(spark: SparkSession, root: str, realm_id: str, kind: str) -> DataFrame:
    """entity_id, domain_id, text of each statute or policy."""
    return text_files(spark, f"{root}/{realm_id}/*/*/{kind}.txt")


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as texts; the two folders above each name its entity and domain."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("entity_id"), F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1).alias("domain_id"), "text")


def file_stats(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size and time of change of the files that a pattern names."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def section_index(spark: SparkSession, path: str) -> DataFrame:
    """No quoting; blank lines are skipped.  url is the section's own address, source_url that of its document."""
    return spark.read.schema("entity_id string, domain_id string, source_url string, section string, anchor string, url string").option("header", True).option("quote", "").csv(path)


def sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A sheet as text cells; quotes as usual, a cell may hold line feeds."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Urls of a file; lines of notes and blank ones are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """A feature a row, its properties a map, its geometry as JSON."""
    rows = _json(spark, path, "features array<struct<properties:map<string,string>,geometry:string>>")
    return rows.select(F.explode("features").alias("f")).select("f.*")


def save_version(rows: DataFrame, folder: str, as_of: Column) -> None:
    """Rows join the log of versions; nothing is overwritten, so a failed write leaves the old state."""
    rows.withColumn("saved_at", as_of.cast("timestamp")).write.mode("append").parquet(folder)


def current(spark: SparkSession, folder: str, key: Sequence[str]) -> DataFrame:
    """The last version of each key."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "saved_at").alias("r")).select(*key, "r.*")


def prune(spark: SparkSession, folder: str, target: str, key: Sequence[str]) -> None:
    """A new log with the last version of each key and day."""
    rows = spark.read.parquet(folder).withColumn("__day", F.to_date("saved_at"))
    rest = [c for c in rows.columns if c not in (*key, "__day")]
    rows.groupBy(*key, "__day").agg(F.max_by(F.struct(*rest), "saved_at").alias("r")).select(*key, "r.*").write.mode("overwrite").parquet(target)


def write_report(rows: DataFrame, folder: str, kind: str, order: str) -> None:
    """A report as csv, json or a markdown table, in order; reports are short by nature, so one file."""
    rows = rows.orderBy(order).coalesce(1)
    if kind in ("csv", "json"):
        rows.write.mode("overwrite").option("header", True).format(kind).save(folder)
        return
    cells = [F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("—")) for c in rows.columns]
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    lines.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).union(lines).coalesce(1).write.mode("overwrite").text(folder)
