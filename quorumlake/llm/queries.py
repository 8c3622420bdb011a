"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import oracles
from quorumlake.llm.shared import read_table, shared_folder, word_count


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.mixing import mix

    docs = read_table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", "text"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.chat import format_chats, read_back

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.union(own)))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.fingerprint import with_neighbour

    docs = with_neighbour(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.line_dedup import dedup_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.language import identify

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.decontaminate import find_contamination

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quorumlake.llm.token_count import count_tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.substring_dedup import dedup_substrings

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.ball_tree import cluster

    return cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quorumlake.llm.token_files import checksums, write_ids

    path = shared_folder(spark)
    write_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return checksums(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_fingerprint": op3_fingerprint,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_count": op7_token_count,
    "op8_near_dedup": op8_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_spelling": op11_spelling,
    "op12_clusters": op12_clusters,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
