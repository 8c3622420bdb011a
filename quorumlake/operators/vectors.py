"""Chunks with embeddings: keys, filters, counts and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.vector_index import exact


def document_key(entity: Column, domains: Column, kind: Column, file: Column) -> Column:
    """Prefix of a document's chunk ids."""
    shared = F.concat(entity, F.lit("-shared/"), F.coalesce(file, F.lit("")))
    return F.when(file.isNotNull() | (F.size(domains) == 0) | kind.isNull(), shared).otherwise(F.concat(entity, F.lit("-"), F.try_element_at(domains, F.lit(1)), F.lit("/"), kind))


def count_prefix(chunks: DataFrame, prefix: str) -> DataFrame:
    """A37."""
    return chunks.where(F.col("chunk_id").startswith(prefix)).agg(F.count("*").alias("n"))


def in_domain(chunks: DataFrame, entity_id: int, domain: str, kind: str | None = None) -> DataFrame:
    """Chunks of an entity in a domain, listed or single."""
    found = chunks.where((F.col("entity_id") == entity_id) & F.array_contains("domain_ids", domain))
    return found.where(F.col("kind") == kind) if kind else found


def documents(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """Keys of documents, from the ids of their first chunks, in order."""
    return chunks.where(F.col("chunk_id").endswith("-0")).select(F.regexp_replace("chunk_id", "-0$", "").alias("document")).orderBy("document").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks most like each query, ties by id; exact, for any number of queries.

    queries: query_id, vector; chunks: chunk_id, vector.  See vector_index, which has an index as well.
    """
    return exact(queries, chunks, k)


def renamed(chunks: DataFrame, old: str, new: str) -> DataFrame:
    """Chunks of a prefix under another one."""
    hit = F.col("chunk_id").startswith(old)
    return chunks.withColumn("chunk_id", F.when(hit, F.concat(F.lit(new), F.substring("chunk_id", len(old) + 1, 1_000_000))).otherwise(F.col("chunk_id")))


def without_prefix(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Chunks of no document in the list (column document); all of a document's chunks go, not a page of them."""
    key = F.regexp_replace("chunk_id", "-[0-9]+$", "")
    return chunks.withColumn("document", key).join(prefixes.select("document"), "document", "left_anti").drop("document")


def prioritised(primary: DataFrame, authoritative: DataFrame, shared: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Primary chunks, then authoritative ones, then shared ones, each id once where it comes first."""
    parts = [df.withColumn("priority", F.lit(i)) for i, df in enumerate((primary, authoritative, shared))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "priority").alias("r")).select(key, "r.*")
