"""Reports of a domain: distributions of scores, answers and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.scoring import not_specified


def overall(scores: DataFrame) -> DataFrame:
    """Mean, least and greatest overall score (0 to 10) and how many high scores rest on a low confidence."""
    low = (F.col("normalized") > 0) & (F.col("confidence") <= 10)
    return scores.groupBy("domain_id").agg(F.avg("normalized").alias("mean"), F.min("normalized").alias("least"), F.max("normalized").alias("most"), F.count_if(low).alias("n_low_confidence"))


def per_question(answers: DataFrame) -> DataFrame:
    """Count, mean and range of a question's scores (0 to 10), four buckets, unanswered, and the first best entity."""
    s = F.col("score") * 10
    rated = ~not_specified(F.col("answer"))
    bucket = lambda low, high: F.count_if(rated & (s >= low) & (s < high))
    return answers.groupBy("domain_id", "question_id").agg(
        F.count("*").alias("n"), F.avg(F.when(rated, s)).alias("mean"), F.min(F.when(rated, s)).alias("least"), F.max(F.when(rated, s)).alias("most"),
        bucket(0, 2.5).alias("b1"), bucket(2.5, 5).alias("b2"), bucket(5, 7.5).alias("b3"), bucket(7.5, 10.001).alias("b4"), F.count_if(~rated).alias("n_none"),
        F.max_by(F.when(rated, F.col("entity_id")), F.when(rated, F.struct(s, -F.col("entity_id")))).alias("best_entity"),
    )


def deciles(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities in each tenth of the scale (10 belongs to the last) and those without data."""
    decile = F.least(F.floor("normalized"), F.lit(9))
    counts = [F.count_if(decile == i).alias(f"d{i}") for i in range(10)]
    total = entities.agg(F.count("*").alias("n_all"))
    out = scores.groupBy("domain_id").agg(*counts, F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return out.select("domain_id", *(f"d{i}" for i in range(10)), (F.col("n_all") - F.col("n")).alias("n_no_data"))


def coverage(questions: DataFrame, analyses: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions, analysed entities, all entities and their share in whole percent, a row for each domain."""
    asked = questions.groupBy("domain_id").agg(F.count("*").alias("n_questions"))
    done = analyses.groupBy("domain_id").agg(F.count_distinct("entity_id").alias("n_analysed"))
    out = asked.join(done, "domain_id", "left").crossJoin(F.broadcast(entities.agg(F.count("*").alias("n_entities"))))  # one row
    return out.select("domain_id", "n_questions", F.coalesce("n_analysed", F.lit(0)).alias("n_analysed"), "n_entities", F.floor(100.0 * F.coalesce("n_analysed", F.lit(0)) / F.nullif("n_entities", F.lit(0)) + 0.5).alias("percent"))


def type_coverage(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """Entities of each type with a count above 0, of how many, and TOTAL over all types."""
    rows = entities.join(counts, "entity_id", "left").withColumn("has", F.coalesce("n", F.lit(0)) > 0)
    out = rows.rollup("type").agg(F.count_if("has").alias("n_with"), F.count("*").alias("n_all"), F.grouping("type").alias("is_total"))
    return out.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("type")).alias("type"), "n_with", "n_all")
