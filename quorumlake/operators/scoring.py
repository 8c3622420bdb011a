"""Scores of analyses: the weighted, detailed, rounded and plain means of answers, and what is reported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.numbers import half_up

KEY = ["entity_id", "domain_id"]
#: Answers that say that nothing was found.
NOT_SPECIFIED = ("Not specified in the provided sources.", "No relevant sources available", "Not specified in the statute.")


def not_specified(answer: Column) -> Column:
    """One of the answers that stand for none."""
    return F.coalesce(answer.isin(*NOT_SPECIFIED), F.lit(False))


def with_weights(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their question's weight, 1 for questions that aren't defined."""
    weights = questions.select("domain_id", "question_id", "weight")
    return answers.join(weights, ["domain_id", "question_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(1)))


def entity_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Weighted mean over the answers that are there; a missing score counts 0."""
    weighed = with_weights(answers, questions)
    total = F.sum(F.coalesce("score", F.lit(0.0)) * F.col("weight"))
    return weighed.groupBy(*KEY).agg((total / F.nullif(F.sum("weight"), F.lit(0))).alias("score"))


def questionnaire(analyses: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question of each analysis with its answer, "Not analyzed" and 0 where there is none."""
    asked = analyses.select(*KEY).join(questions, "domain_id")
    given = answers.select(*KEY, "question_id", "score", "confidence", "answer")
    joined = asked.join(given, [*KEY, "question_id"], "left")
    return joined.select(
        *KEY, "question_id", "weight", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.nullif("answer", F.lit("")), F.lit("Not analyzed")).alias("answer")
    )


def detailed_scores(analyses: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Weighted mean over the questions, answered or not, on scales of 0 to 1 and 0 to 10."""
    rows = questionnaire(analyses, questions, answers)
    out = rows.groupBy(*KEY).agg(F.sum(F.col("score") * F.col("weight")).alias("total"), F.sum("weight").alias("possible"))
    normal = F.coalesce(F.col("total") / F.nullif("possible", F.lit(0)), F.lit(0.0))
    return out.select(*KEY, "total", "possible", normal.alias("normalized"), (F.floor(half_up(normal * 100, 6) + 0.5) / 10).alias("overall"))


def normalized_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """As stored with an analysis; answers that say nothing score 0, each product is rounded before the sum."""
    weighed = with_weights(answers, questions)
    score = F.when(not_specified(F.col("answer")), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    weighed = weighed.withColumn("weighted", half_up(score * F.col("weight"), 2))
    out = weighed.groupBy(*KEY).agg(
        F.sum("weighted").alias("total"), F.sum("weight").alias("possible"), F.count("*").alias("n_questions"), F.sum((F.col("answer") != NOT_SPECIFIED[2]).cast("long")).alias("n_answered"),
        half_up(F.avg(F.coalesce("confidence", F.lit(0.0)))).cast("long").alias("confidence"), half_up(half_up(F.avg(F.coalesce("score", F.lit(0.0))), 8), 2).alias("mean_score"),
    )
    normal = F.coalesce(F.col("total") / F.nullif("possible", F.lit(0)), F.lit(0.0))
    return out.select(*KEY, "n_questions", "n_answered", "confidence", "mean_score", half_up(half_up(normal, 8), 4).alias("weighted_score"), half_up(half_up(normal * 10, 8), 2).alias("normalized"))


def domain_summary(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean of a domain's scores, entities with a score, and all entities."""
    total = entities.agg(F.count("*").alias("n_entities"))
    return scores.groupBy("domain_id").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_scored")).crossJoin(F.broadcast(total))  # one row


def plain_means(answers: DataFrame) -> DataFrame:
    """Unweighted mean of the scores of answers that have a question."""
    return answers.where("question_id <> 0").groupBy(*KEY).agg(F.avg("score").alias("mean_score"))


def question_weights(questions: DataFrame) -> DataFrame:
    """Questions of a domain and their total weight; a weight of 0 or none counts 1."""
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    return questions.groupBy("domain_id").agg(F.count("*").alias("n_questions"), F.sum(weight).alias("total_weight"))


def best_entities(scores: DataFrame) -> DataFrame:
    """Mean and best entity of a domain; the first of equals, none if no score is above 0."""
    best = F.max_by(F.when(F.col("score") > 0, F.col("entity_id")), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("entity_id")))
    return scores.groupBy("domain_id").agg(F.avg("score").alias("mean_score"), best.alias("best_entity"))


def entity_rank(scores: DataFrame) -> DataFrame:
    """Rank of each entity in its domain, ties alike."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("domain_id").orderBy(F.desc("score"))))


def rubric_score(answer: Column) -> Column:
    """Points for what an answer names, between 0.1 and 1.  The words are fixed values."""
    low = F.lower(answer)
    has = lambda *words: low.rlike("|".join(words))
    points = [
        (has(r"\d+\s*(inches?|feet|days?|hours?|percent|%|dollars?|\$)"), 0.15), (has("diameter", "dbh", "height"), 0.1), (has("permit", "application"), 0.1), (has("approval", "authorization"), 0.1), (has("inspection", "review"), 0.1),
        (has("fine", "penalty", "violation"), 0.1), (has(r"\$\d+", "fee"), 0.1), (has("replacement", "replant", "restore"), 0.15), (has("native", "species", "indigenous"), 0.1), (has("prohibited", "required", "mandatory"), 0.1),
        (has("arborist", "professional"), 0.05), (has("plan", "schedule", "timeline"), 0.05), (has("notice", "hearing", "appeal"), 0.05), ((F.length(answer) > 200) & ~has("does not"), 0.05), ((F.length(answer) > 400) & ~has("does not"), 0.05),
        (has("may", "might", "could"), -0.05), (has("unclear", "vague", "limited"), -0.1),
    ]
    total = F.lit(0.5)
    for test, value in points:
        total = total + F.when(test, value).otherwise(0.0)
    return (
        F.when((answer == NOT_SPECIFIED[2]) | has("does not specify", "not mentioned", "no information", "not addressed", "not covered"), 0.1)
        .when(has("general", "state code", "by law", "as determined", "may be", "if appropriate"), 0.3)
        .otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), total)))
    )
