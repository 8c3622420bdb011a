"""Providers of embeddings and answers.  Calls to a service are injected; the stand-ins here are deterministic."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.functions.pieces import by_pieces


class Embedder(Protocol):
    """Texts of one batch to vectors of one dimension."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Counts of words in hashed places with hashed signs, of length 1: offline, and near for texts that share words.

    A text without words, or whose words cancel out, has the place of its whole hash alone, so it has a direction as well;
    blank texts have none.
    """

    def __init__(self, size: int = 64, most_chars: int = 8000):
        self.size, self.most_chars = size, most_chars

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "")[: self.most_chars].lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
            if not out[i].any() and (t or "").strip():
                out[i, int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % self.size] = 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


#: Providers by the beginning of a model's name.
PROVIDERS: dict[str, Callable[[], Embedder]] = {"hashed-": HashedWords}


def provider(model: str) -> Embedder:
    for prefix, make in PROVIDERS.items():
        if model.startswith(prefix):
            return make()
    raise KeyError(f"no provider for {model}; there are {sorted(PROVIDERS)}")


def with_embeddings(chunks: DataFrame, embed: Embedder, text: str = "content") -> DataFrame:
    """Adds vector; a service is called once for each piece of an Arrow batch."""

    def vectors(texts: list[str]) -> pa.Array:
        found = np.ascontiguousarray(embed(texts), dtype=np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))

    return chunks.withColumn("vector", by_pieces("array<float>", pa.list_(pa.float32()), vectors, once=True)(text))


def answered(questions: DataFrame, ask: Callable[[str], tuple[str, float, float]], sentinel: str) -> DataFrame:
    """Asks for each prompt and tidies what comes: confidence from 0 to 100, 50 if there is none, score 0 for a sentinel.

    questions: entity_id, question_id, prompt.  ask gives answer, score and confidence; rows are independent here, what
    depends on earlier answers goes into the prompt (C24).
    """
    schema = T.StructType([*questions.schema.fields, T.StructField("answer", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(p) for p in b["prompt"]]
            yield b.assign(answer=[g[0] for g in got], score=[g[1] for g in got], confidence=[g[2] for g in got])

    raw = questions.mapInPandas(run, schema)
    tidy = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("confidence", F.lit(50.0)), F.lit(50.0))))
    return raw.withColumn("confidence", tidy).withColumn("score", F.when(F.col("answer") == sentinel, 0.0).otherwise(F.col("score")))


def told(rows: DataFrame, ask: Callable[[str], str], name: str) -> DataFrame:
    """What a provider says to each row's prompt, trimmed, in a new column; rows without a prompt aren't asked."""
    said = by_pieces("string", pa.string(), lambda prompts: [None if p is None else (ask(p) or "").strip() for p in prompts], once=True)
    return rows.withColumn(name, said("prompt"))


def summaries(answers: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """A summary of each analysis from its answers in order of question."""
    line = F.concat(F.lit("Q: "), "question_id", F.lit("\nA: "), F.coalesce("answer", F.lit("")), F.lit(" (score: "), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit(")"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("question_id", line.alias("line")))), lambda x: x["line"])
    prompt = F.concat(F.lit("Summarise in 15 words how well the rules work:\n\n"), F.array_join(lines, "\n\n"))
    return told(answers.groupBy("entity_id", "domain_id").agg(prompt.alias("prompt")), ask, "summary").drop("prompt")


def best_practices(top: DataFrame, ask: Callable[[str], str], sentinel: str) -> DataFrame:
    """A best practice of each question from its top answers (rank), without a label before it; the sentinel if empty."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity_id", "answer"))), lambda x: F.concat(F.lit("entity "), x["rank"], F.lit(": "), x["entity_id"], F.lit("\nAnswer: "), x["answer"]))
    said = told(top.groupBy("domain_id", "question_id").agg(F.array_join(parts, "\n---\n").alias("prompt")), ask, "practice").drop("prompt")
    bare = F.trim(F.regexp_replace("practice", r"(?i)^(synthesized )?best practice:\s*", ""))
    return said.withColumn("practice", F.coalesce(F.nullif(bare, F.lit("")), F.lit(sentinel)))


def enriched(answers: DataFrame, practices: DataFrame, ask: Callable[[str], str], empty: tuple[str, ...]) -> DataFrame:
    """Gap and score of answers that have a best practice and no score yet; answers that say nothing get score 0 and no gap.

    ask returns JSON of gap, score and nextPrompts; what can't be read leaves the row as it was.
    """
    rows = answers.join(practices.select("domain_id", "question_id", F.col("practice").alias("__p")), ["domain_id", "question_id"], "left")
    open_, nothing = F.col("__p").isNotNull() & F.col("score").isNull(), (F.coalesce("answer", F.lit("")) == "") | F.col("answer").isin(*empty)
    prompt = F.when(open_ & ~nothing, F.concat(F.lit("Answer: "), "answer", F.lit("\nBest practice: "), "__p"))
    got = told(rows.withColumn("prompt", prompt), ask, "__said").withColumn("__j", F.from_json("__said", "gap string, score double, nextPrompts array<string>"))
    skipped = open_ & nothing
    return got.select("entity_id", "domain_id", "question_id", F.when(skipped, "").otherwise(F.col("__j.gap")).alias("gap"), F.when(skipped, F.lit(0.0)).otherwise(F.coalesce("score", F.col("__j.score"))).alias("score"))


def judged(candidates: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Whether a candidate (name, content) is about a name, with confidence from 0 to 100; not if the reply can't be read."""
    rows = candidates.withColumn("prompt", F.concat(F.lit("Is this about "), "name", F.lit("?\n"), "content"))
    got = told(rows, ask, "__said").withColumn("__j", F.from_json("__said", "relevant boolean, confidence double"))
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("__j.confidence", F.lit(0.0))))
    return got.withColumn("is_relevant", F.coalesce("__j.relevant", F.lit(False))).withColumn("confidence", bounded).drop("prompt", "__said", "__j")
