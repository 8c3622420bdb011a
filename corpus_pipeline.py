"""A training corpus in five steps: language, lines, near-duplicates, benchmarks, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the shared
folder and reads it again as the next stage's docs.  All but the last return the columns of documents.

In every stage: null and empty texts have no letters, lines, words or shingles of their own; a null doc_id is an id like
others, and rows of one id are judged by their own texts where a stage judges texts. Columns that documents lack of COLUMNS
are an error, columns beyond them are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import decontaminate, language, line_dedup, mixing, near_dedup
from quorumlake.llm.shared import materialise, read_table, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null ones, and texts without a letter.  Repeated rows stay or go alike."""
    return language.identify(docs).where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; n_chars follows the text.  Documents stay, emptied ones too.

    A null text becomes an empty one.  Rows of one id are one document to this stage, so they keep the lines they share, and
    those of a null id come after all others.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group.

    All rows of that id stay, equal ones too: a row is repeated by its source and not by another document.  Texts without
    words are groups of their own.  Of a group without any id all rows stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more stand in benchmark passages.

    Rows of one id go together if one of them is to go.  Texts without words stay, and so do all without benchmark items.
    """
    bad = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix: copies, and taken words.  A null source is a source, the last one;
    documents without words are taken 0 words of, and repeated rows are drawn apart."""
    return mixing.mix(docs, word_count(F.col("text")))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Sampling and learned filters can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
