"""Indexing runs: which downloads are indexed, their chunks with embeddings, and the index that is written from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import chunk
from quorumlake.operators import upkeep, vector_index
from quorumlake.operators.vectors import document_key
from quorumlake.providers.models import Embedder, with_embeddings


@dataclass(frozen=True)
class Indexed:
    """What a run has written: all chunks and the index over their vectors."""

    spark: SparkSession
    folder: str

    def chunks(self) -> DataFrame:
        """chunk_id, document, chunk_index, entity_id, domain_ids, url, content, vector."""
        return self.spark.read.parquet(f"{self.folder}/chunks")

    def decisions(self) -> DataFrame:
        """entity_id, file, decision: what became of each download."""
        return self.spark.read.parquet(f"{self.folder}/decisions")

    def index(self) -> vector_index.InvertedFile:
        return vector_index.InvertedFile.open(self.spark, f"{self.folder}/index")

    def search(self, texts: DataFrame, embed: Embedder, k: int = 5) -> DataFrame:
        """query_id, chunk_id, score, rank of texts (query_id, content): they are embedded as the chunks were."""
        return self.index().search_all(with_embeddings(texts, embed).select("query_id", "vector"), k)


def index_run(downloads: DataFrame, history: DataFrame, known: DataFrame, embed: Embedder, folder: str, as_of: Column, hours: float, most: int = 2000) -> Indexed:
    """Decides on each download (B37), cuts what is indexed into chunks (H12), embeds them (K01) and writes an index.

    downloads: entity_id, file, domain_ids, content; history: entity_id, file, text_file, url, ts, file_type, position
    (C08); known: document, those that are indexed already.  A document's chunks are numbered from 0 under its key (H17).
    Everything is written under folder, chunks before the index that is made from what was written, so a model is asked
    once for each chunk.  Downloads without text give no chunk; those of a repeated key are chunks of one document twice.
    """
    rows = upkeep.downloads_with_history(downloads, history).withColumn("document", document_key(F.col("entity_id").cast("string"), F.col("domain_ids"), F.lit(None), F.col("file")))
    rows = rows.join(known.select("document", F.lit(True).alias("indexed")).distinct(), "document", "left")
    decision = upkeep.index_decision(F.size("domain_ids"), F.col("ts"), as_of, hours, F.col("file_type"), F.coalesce("url", F.lit("")), F.col("indexed"))
    rows = rows.withColumn("decision", decision)
    rows.select("entity_id", "file", "decision").write.parquet(f"{folder}/decisions")
    cut = rows.where("decision = 'index'").select("document", "entity_id", "domain_ids", "url", F.posexplode(chunk.chunks(F.col("content"), most)).alias("chunk_index", "content"))
    named = cut.withColumn("chunk_id", F.concat("document", F.lit("-"), "chunk_index"))
    with_embeddings(named, embed).write.parquet(f"{folder}/chunks")
    out = Indexed(downloads.sparkSession, folder)
    vector_index.InvertedFile.write(out.chunks().select("chunk_id", "vector"), f"{folder}/index")
    return out
