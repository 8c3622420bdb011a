"""Retrieval for questions: the chunks that answer them, excerpts without repeats, and the requests that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text
from quorumlake.operators import vector_index

#: What stands before the excerpts in a request.
EXCERPTS = "=== VECTOR-RETRIEVED EXCERPTS ===\n"
MORE_SOURCES = "=== ADDITIONAL SOURCE {} ===\n"


def discovered(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Of each search vector of a question the k chunks most like it among those of its entity and domain.

    questions: entity_id, domain_id, question_id, vectors (one for each search term, in order); chunks: chunk_id,
    entity_id, domain_ids, vector.  Returns entity_id, domain_id, question_id, term, chunk_id, score, rank.  The filter is
    an equality join of blocks of vectors (B10 comes first), so a question meets the chunks of its entity alone.
    Questions without vectors, and vectors without chunks, have no rows.
    """
    by = ["entity_id", "domain_id"]
    terms = questions.select(*by, "question_id", F.posexplode("vectors").alias("term", "vector"))
    asked = vector_index._asked(terms.select(*by, F.struct("question_id", "term").alias("query_id"), "vector"), by)
    own = chunks.select("entity_id", F.explode(F.array_distinct("domain_ids")).alias("domain_id"), "chunk_id", "vector")
    met = vector_index.blocks(own, "chunk_id", by).join(asked, by)
    found = vector_index.best_of(met, k, by)
    return found.select(*by, "query_id.question_id", "query_id.term", "chunk_id", "score", "rank")


def excerpts(found: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts of the chunks found, with their source before them, each text once a run of an entity's questions.

    found: what discovered() returns; questions: also position, the order in which they are asked; chunks: also content
    and url.  A text that an earlier question or term of the entity and domain had (by fingerprint, H46) is not repeated.
    Returns entity_id, domain_id, question_id, position, term, rank, chunk_id, excerpt, first (whether it is kept).
    """
    source = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("Source: "), "url", F.lit("\n\n"), F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit("")))
    texts = chunks.select("chunk_id", source.alias("excerpt"))
    key = ["entity_id", "domain_id", "question_id"]
    rows = found.join(questions.select(*key, "position"), key).join(texts, "chunk_id")
    again = Window.partitionBy("entity_id", "domain_id", F.xxhash64("fp"), "fp").orderBy("position", "question_id", "term", "rank")
    rows = rows.withColumn("fp", F.sha2(text.fingerprint(F.col("excerpt")), 256)).withColumn("first", F.row_number().over(again) == 1)
    return rows.select(*key, "position", "term", "rank", "chunk_id", "excerpt", "first")


def references(excerpt: Column, order: Column) -> Column:
    """References to sections in the excerpts of a group, each once, in order."""
    each = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.section_references(excerpt).alias("refs")))), lambda x: x["refs"])
    return F.array_distinct(F.flatten(each))


def requests(questions: DataFrame, excerpts: DataFrame, header: str, additional: Column | None = None) -> DataFrame:
    """The request for each question: its excerpts in order, then additional sources; null if there are none.

    questions: entity_id, domain_id, question_id, position, question and what ``additional`` reads (an array of texts).
    Returns these keys, question, prompt, n_excerpts, n_repeats and refs (section references, of repeats too).
    """
    key = ["entity_id", "domain_id", "question_id"]
    place = F.struct("term", "rank")
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("first"), F.struct(place.alias("o"), "excerpt")))), lambda x: x["excerpt"])
    told = excerpts.groupBy(*key).agg(body.alias("body"), F.count_if(~F.col("first")).alias("n_repeats"), references(F.col("excerpt"), place).alias("refs"))
    rows = questions.join(told, key, "left").withColumn("body", F.coalesce("body", F.array().cast("array<string>")))
    more = F.transform(F.coalesce(additional, F.array().cast("array<string>")), lambda x, i: F.concat(F.lit(MORE_SOURCES.split("{}")[0]), (i + 1).cast("string"), F.lit(MORE_SOURCES.split("{}")[1]), x)) if additional is not None else F.array().cast("array<string>")
    sections = F.concat(F.when(F.size("body") > 0, F.array(F.concat(F.lit(EXCERPTS), F.array_join("body", "\n\n")))).otherwise(F.array().cast("array<string>")), F.when(F.size(more) > 0, F.array(F.array_join(more, "\n\n"))).otherwise(F.array().cast("array<string>")))
    prompt = F.when(F.size(sections) > 0, F.concat(F.lit("Question: "), "question", F.lit("\n\n"), F.lit(header), F.lit("\n\n"), F.array_join(sections, "\n\n")))
    return rows.select(*key, "position", "question", prompt.alias("prompt"), F.size("body").alias("n_excerpts"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
