"""Queries of vector search and retrieval, over the embeddings and the documents of the same ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import retrieval, vector_index
from quorumlake.plans.registry import Registry
from quorumlake.providers import models
from quorumlake.sources import folders
from quorumlake.sources import tables as t

R = Registry()

HEADER = "Here are discovered relevant parts of statutes:"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings as chunks; those of ids that 50 divides as queries."""
    rows = t.table(spark, d, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


TOP_SQL = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, floor(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5"""


@R.add(TOP_SQL, common=False)
def blockwise_nearest(spark: SparkSession, d: str) -> DataFrame:
    """exact, every block of chunks with every block of queries."""
    queries, chunks = _vectors(spark, d)
    return vector_index.exact(queries, chunks)


@R.add(TOP_SQL, common=False)
def index_nearest(spark: SparkSession, d: str) -> DataFrame:
    """An index of all chunks is written and searched; cells that may hold a better chunk are read as well."""
    queries, chunks = _vectors(spark, d)
    return vector_index.InvertedFile.write(chunks, folders.shared(spark)).search_all(queries)


@R.add("SELECT count(*)::BIGINT AS n_indexed, (count(*) FILTER (vec_id % 50 = 0))::BIGINT AS n_queries, true AS recalled FROM embeddings", common=False)
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a search in as many cells as a sample of queries asks for, held against brute force: 0.9 or more."""
    queries, chunks = _vectors(spark, d)
    index = vector_index.InvertedFile.write(chunks, folders.shared(spark))
    probes = vector_index.probes_for(index, queries, chunks)
    told = vector_index.recall(index.search(queries, probes=probes), vector_index.exact(queries, chunks)).agg(F.count("*").alias("n_queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recalled"))
    return told.select(F.lit(index.size()).cast("long").alias("n_indexed"), "n_queries", "recalled")


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks: documents with the vector of their number, of the entity that its label names.  Questions: every 50th
    chunk's vector, every 150th's with the next vector as a second search term; a fifth ask an entity without chunks."""
    v, doc = F.col("vec_id"), t.table(spark, d, "documents")
    rows = t.table(spark, d, "embeddings")
    url = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("https://docs.example/"), "doc_id"))
    chunks = rows.join(doc, F.col("doc_id") == v).select(v.alias("chunk_id"), F.col("label").alias("entity_id"), F.when(v % 3 == 0, F.array(F.lit("trees"))).otherwise(F.array(F.lit("noise"), F.lit("trees"))).alias("domain_ids"), url.alias("url"), F.col("text").alias("content"), F.col("embedding").alias("vector"))
    second = rows.select((v - 1).alias("vec_id"), F.col("embedding").alias("second"))
    asked = rows.where("vec_id % 50 = 0").join(second, "vec_id", "left")
    domain = F.when(v % 100 == 0, "noise").otherwise("trees")
    vectors = F.when((v % 150 == 0) & F.col("second").isNotNull(), F.array("embedding", "second")).otherwise(F.array("embedding"))
    entity = F.when(v % 250 == 0, F.lit(-1)).otherwise(F.col("label"))
    return asked.select(entity.alias("entity_id"), domain.alias("domain_id"), v.alias("question_id"), v.alias("position"), F.concat(F.lit("What of "), v, F.lit("?")).alias("question"), vectors.alias("vectors")), chunks


CORPUS_SQL = r"""chunks AS (
  SELECT vec_id AS chunk_id, label AS entity_id, CASE WHEN vec_id % 3 = 0 THEN ['trees'] ELSE ['noise', 'trees'] END AS domain_ids, embedding::DOUBLE[] AS v,
         CASE WHEN doc_id % 4 > 0 THEN 'Source: https://docs.example/' || doc_id || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS excerpt
  FROM embeddings JOIN documents ON doc_id = vec_id),
asked AS (SELECT CASE WHEN vec_id % 250 = 0 THEN -1 ELSE label END AS entity_id, CASE WHEN vec_id % 100 = 0 THEN 'noise' ELSE 'trees' END AS domain_id, vec_id AS question_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
terms AS (SELECT entity_id, domain_id, question_id, 0 AS term, v FROM asked UNION ALL SELECT a.entity_id, a.domain_id, a.question_id, 1, e.embedding::DOUBLE[] FROM asked a JOIN embeddings e ON e.vec_id = a.question_id + 1 WHERE a.question_id % 150 = 0),
scored AS (SELECT t.entity_id, t.domain_id, t.question_id, t.term, c.chunk_id, c.excerpt, floor(list_cosine_similarity(c.v, t.v) * 1e6 + 0.5) / 1e6 AS score FROM terms t JOIN chunks c ON c.entity_id = t.entity_id AND list_contains(c.domain_ids, t.domain_id)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, term ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY entity_id, domain_id, lower(trim(regexp_replace(regexp_replace(excerpt, '^# [^\n]* downloaded at [^\n]*\n+', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) ORDER BY question_id, term, rank) AS nth FROM found),
told AS (
  SELECT a.question_id, a.entity_id, a.domain_id, count(*) FILTER (nth = 1) AS n_excerpts, count(*) FILTER (nth > 1) AS n_repeats, string_agg(excerpt, chr(10) || chr(10) ORDER BY term, rank) FILTER (nth = 1) AS body
  FROM asked a LEFT JOIN once o USING (question_id) GROUP BY ALL)"""


@R.add(f"WITH {CORPUS_SQL} SELECT entity_id, domain_id, question_id, term, chunk_id, score, rank::INTEGER AS rank FROM found", common=False)
def discovered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Of each search term the five nearest chunks of the entity and domain."""
    questions, chunks = _corpus(spark, d)
    return retrieval.discovered(questions, chunks)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    questions, chunks = _corpus(spark, d)
    found = retrieval.discovered(questions, chunks)
    return retrieval.requests(questions, retrieval.excerpts(found, questions, chunks), HEADER)


PROMPT_SQL = f"CASE WHEN body IS NOT NULL THEN 'Question: What of ' || question_id || '?' || chr(10) || chr(10) || '{HEADER}' || chr(10) || chr(10) || '=== VECTOR-RETRIEVED EXCERPTS ===' || chr(10) || body END"


@R.add(f"WITH {CORPUS_SQL} SELECT entity_id, domain_id, question_id, n_excerpts::INTEGER AS n_excerpts, n_repeats::BIGINT AS n_repeats, sha256({PROMPT_SQL}) AS prompt_sha256 FROM told", common=False)
def question_requests(spark: SparkSession, d: str) -> DataFrame:
    """The request of each question with the whole texts of its chunks, none of them twice a run."""
    return _requests(spark, d).select("entity_id", "domain_id", "question_id", "n_excerpts", "n_repeats", F.sha2("prompt", 256).alias("prompt_sha256"))


@R.add(f"""WITH {CORPUS_SQL} SELECT question_id, CASE WHEN body IS NULL THEN '{t.NOT_IN_STATUTE}' ELSE 'From ' || length({PROMPT_SQL}) || ' characters.' END AS answer, CASE WHEN body IS NULL THEN 0.0 ELSE 0.5 END AS score, CASE WHEN body IS NULL THEN 0.0 ELSE 80.0 END AS confidence FROM told""", common=False)
def retrieved_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions with sources are asked, others are answered by the sentinel without asking."""
    rows = _requests(spark, d)
    asked = models.answered(rows.where("prompt IS NOT NULL").select("question_id", "prompt"), lambda p: (f"From {len(p)} characters.", 0.5, 80.0), t.NOT_IN_STATUTE)
    rest = rows.where("prompt IS NULL").select("question_id", F.lit(t.NOT_IN_STATUTE).alias("answer"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    return asked.drop("prompt").unionByName(rest)
