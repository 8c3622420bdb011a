"""Versions, differences and merges of keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity_id", "domain_id"]


def history(analyses: DataFrame) -> DataFrame:
    """Versions of each analysis, the newest first."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("analysis_id"))
    return analyses.withColumn("version", F.row_number().over(newest)).withColumn("is_current", F.col("version") == 1)


def last_per_period(analyses: DataFrame, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """The last version of each period is kept, the others are counted.  One aggregation, no window."""
    period = F.date_format("ts", pattern).alias("period")
    return analyses.groupBy(*KEY, period).agg(F.max_by("analysis_id", F.struct("ts", "analysis_id")).alias("analysis_id"), (F.count("*") - 1).alias("n_pruned"))


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the last one in the given order, as a grouped maximum."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("last")).select(*key, "last.*")


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the first one in the given order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*key, "first.*")


def diff(before: DataFrame, after: DataFrame, least: float) -> DataFrame:
    """Questions whose answer changed or whose score moved by least or more."""
    key = [*KEY, "question_id"]
    old = before.select(*key, F.col("score").alias("old_score"), F.col("answer").alias("old_answer"))
    new = after.select(*key, F.col("score").alias("new_score"), F.col("answer").alias("new_answer"))
    changed = ~F.col("old_answer").eqNullSafe(F.col("new_answer"))
    return old.join(new, key).where(changed | (F.abs(F.col("old_score") - F.col("new_score")) >= least)).select(*key, "old_score", "new_score", changed.alias("answer_changed"))


def compare(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """What to do with each key: analyze (new or reworded), keep, or remove (gone)."""
    n, o = new.withColumnRenamed("wording", "new_wording").withColumn("is_new", F.lit(True)), old.withColumnRenamed("wording", "old_wording").withColumn("is_old", F.lit(True))
    action = F.when(F.col("is_new").isNull(), "remove").when(F.col("is_old").isNull() | ~F.col("new_wording").eqNullSafe(F.col("old_wording")), "analyze").otherwise("keep")
    return n.join(o, list(key), "full").select(*key, action.alias("action"))


def override(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both, the new one where both have a key."""
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    return last_wins(both, key, ["__turn"]).drop("__turn")


def outdated(asked: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """C14: keys that aren't known or whose wording differs."""
    had = known.select(*key, F.col("wording").alias("known_wording"))
    return asked.join(had, list(key), "left").where(F.col("known_wording").isNull() | (F.col("known_wording") != F.col("wording"))).drop("known_wording")


def replace_sentinel(answers: DataFrame, general: str, old: str, new: str) -> DataFrame:
    """M04."""
    return answers.withColumn("answer", F.when((F.col("domain_id") != general) & (F.col("answer") == old), F.lit(new)).otherwise(F.col("answer")))


def gap_to_best(answers: DataFrame) -> DataFrame:
    """The best score of each question is an aggregate of few rows, joined back."""
    best = answers.groupBy("domain_id", "question_id").agg(F.max("score").alias("best"))
    joined = answers.join(best, ["domain_id", "question_id"])
    return joined.withColumn("gap", F.col("best") - F.col("score")).withColumn("is_best", F.col("score") >= F.col("best"))


def longest(answers: DataFrame, k: int) -> DataFrame:
    """the k longest answers of a question; Spark keeps k rows a task before it shuffles."""
    order = Window.partitionBy("domain_id", "question_id").orderBy(F.desc(F.length("answer")), "entity_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reordered(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Analyses whose answers aren't in the order of the questions, with the order that they are to have.

    stored: entity_id, domain_id, question_ids (in the order in which they are stored); asked: domain_id, question_id,
    position.  Answers to questions that are no longer asked go (C16); an analysis without answers is left alone.
    Returns entity_id, domain_id, question_ids: only what is to be written again.
    """
    known = asked.groupBy("domain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "question_id"))), lambda x: x["question_id"]).alias("asked"))
    rows = stored.where(F.size("question_ids") > 0).join(known, "domain_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast(stored.schema["question_ids"].dataType)))
    right = F.filter("asked", lambda q: F.array_contains("question_ids", q))
    return rows.withColumn("right", right).where(F.col("right") != F.col("question_ids")).select("entity_id", "domain_id", F.col("right").alias("question_ids"))
