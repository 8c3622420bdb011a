"""Entity by domain and entity by question views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.numbers import COLOURS, green_hex, green_rgb

KEY = ["entity_id", "domain_id"]


def visible(domains: DataFrame) -> DataFrame:
    """Domains that aren't hidden; one that doesn't say is visible."""
    return domains.where(~F.col("show").eqNullSafe(F.lit(False)))


def real(entities: DataFrame) -> DataFrame:
    """Entities that aren't for tests."""
    return entities.where(~F.coalesce("test", F.lit(False)))


def combined(entities: DataFrame, domains: DataFrame, analyses: DataFrame, means: DataFrame) -> DataFrame:
    """Every entity in every visible domain: whether it has an analysis, uses the state's code, and its mean score.

    Spark broadcasts the domains if they are few, which they are by nature, and else pairs partitions; a score counts only without the state's code.
    """
    cells = real(entities).select("entity_id", "name").crossJoin(visible(domains).select("domain_id"))
    state = analyses.select(*KEY, "state_code")
    out = cells.join(state, KEY, "left").join(means, KEY, "left")
    uses_state = F.coalesce("state_code", F.lit(False))
    return out.select(*KEY, "name", F.col("state_code").isNotNull().alias("has_data"), uses_state.alias("state_code"), F.when(~uses_state, F.col("mean_score")).alias("mean_score"))


def summary(entities: DataFrame, domains: DataFrame, analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of the domain pages: score and colour of each entity in each visible domain, no score under state code."""
    cells = real(entities).select("entity_id", "name", "type").crossJoin(visible(domains).select("domain_id"))
    out = cells.join(analyses.select(*KEY, "state_code"), KEY, "left").join(scores, KEY, "left")
    score = F.when(~F.coalesce("state_code", F.lit(False)), F.col("score"))
    return out.select(*KEY, "name", "type", F.coalesce("state_code", F.lit(False)).alias("state_code"), score.alias("score"), green_rgb(score).alias("colour"), green_hex(score).alias("colour_hex"))


def answer_map(answers: DataFrame) -> DataFrame:
    """One row an analysis, a map from question to score, confidence and answer; missing numbers are 0."""
    cell = F.struct(F.col("question_id"), F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("answer")))
    return answers.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(cell))).alias("answers"))


def question_matrix(answers: DataFrame, n: int) -> DataFrame:
    """The scores of questions 1 to n side by side; the list of columns is given, so no pass looks for them."""
    return answers.groupBy(*KEY).pivot("question_id", list(range(1, n + 1))).agg(F.first("score"))


def entity_domains(domains: DataFrame, analyses: DataFrame) -> DataFrame:
    """Domains with data of each entity, against all visible ones."""
    seen = visible(domains)
    total = seen.agg(F.count("*").alias("n_domains"))
    found = analyses.join(seen, "domain_id").groupBy("entity_id").agg(F.count("*").alias("n_available"), F.array_join(F.sort_array(F.collect_set("domain_id")), ",").alias("available"))
    return found.crossJoin(F.broadcast(total))  # one row


def grades(entities: DataFrame, analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """Grade of each analysis by its score; the state's code overrides it."""
    rows = analyses.join(real(entities).select("entity_id", "name"), "entity_id").join(scores, KEY, "left")
    grade = F.when(F.col("state_code"), "State").when(F.col("score").isNull(), "None").when(F.col("score") >= 0.7, "Very Good").when(F.col("score") >= 0.5, "Good").when(F.col("score") >= 0.3, "Yellow").otherwise("Red")
    return rows.select(*KEY, "name", grade.alias("grade"), F.when(F.col("state_code"), F.lit(COLOURS["gray"])).otherwise(green_hex(F.coalesce("score", F.lit(0.0)))).alias("colour"))
