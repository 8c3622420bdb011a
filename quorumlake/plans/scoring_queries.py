"""Queries on scores, matrices, reports and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import numbers
from quorumlake.operators import matrix, report, scoring, versions
from quorumlake.plans.registry import Registry, r4, r4_sql
from quorumlake.sources import tables as t

NONE = ", ".join(f"'{x}'" for x in scoring.NOT_SPECIFIED)
SCORES_SQL = f"""{t.CIVIC_SQL},
current AS (SELECT * FROM analyses WHERE version = 1),
mine AS (SELECT * FROM answers WHERE version = 1),
weighed AS (SELECT m.*, coalesce(q.weight, 1) AS weight FROM mine m LEFT JOIN questions q ON q.domain_id = m.domain_id AND q.question_id = m.question_id),
scores AS (SELECT entity_id, domain_id, sum(score * weight) / nullif(sum(weight), 0) AS score FROM weighed GROUP BY 1, 2),
stored0 AS (
  SELECT entity_id, domain_id, count(*) AS n_questions, count(*) FILTER (answer <> '{t.NOT_IN_STATUTE}') AS n_answered, floor(avg(confidence) + 0.5)::BIGINT AS confidence,
         floor(floor(avg(score) * 1e8 + 0.5) / 1e8 * 100 + 0.5) / 100 AS mean_score,
         sum(floor(CASE WHEN answer IN ({NONE}) THEN 0.0 ELSE score END * weight * 100 + 0.5) / 100) / nullif(sum(weight), 0) AS normal
  FROM weighed GROUP BY 1, 2),
stored AS (
  SELECT entity_id, domain_id, n_questions, n_answered, confidence, mean_score, floor(floor(normal * 1e8 + 0.5) / 1e8 * 10000 + 0.5) / 10000 AS weighted_score,
         floor(floor(normal * 10 * 1e8 + 0.5) / 1e8 * 100 + 0.5) / 100 AS normalized FROM stored0)"""
R = Registry(SCORES_SQL)

SHADE = "floor({light} + ({dark} - {light}) * greatest(0, least(1, {x})) + 0.5)::INTEGER"


def _shades(x: str) -> list[str]:
    return [SHADE.format(light=float(a), dark=float(b), x=x) for a, b in zip(numbers.LIGHT, numbers.DARK, strict=True)]


def rgb_sql(x: str) -> str:
    r, g, b = _shades(x)
    return f"'rgb(' || {r} || ', ' || {g} || ', ' || {b} || ')'"


def hex_sql(x: str) -> str:
    return "'#' || " + " || ".join(f"lower(printf('%02x', {s}))" for s in _shades(x))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return t.analyses(spark, d).where("version = 1")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.entity_scores(t.answers(spark, d, current=True), t.questions(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.normalized_scores(t.answers(spark, d, current=True), t.questions(spark, d))


def _r6(x: str) -> Column:
    return F.floor(F.col(x) * 1e6 + 0.5) / 1e6


ROUNDED = "floor(score * 1e6 + 0.5) / 1e6"


@R.add(f"""SELECT e.entity_id, d.domain_id, e.name, e.type, coalesce(c.state_code, false) AS state_code, {r4_sql("s.score")} AS score, {rgb_sql("s.score")} AS colour
FROM entities e CROSS JOIN domains d LEFT JOIN current c ON c.entity_id = e.entity_id AND c.domain_id = d.domain_id
LEFT JOIN (SELECT entity_id, domain_id, {ROUNDED} AS score FROM scores) s ON s.entity_id = e.entity_id AND s.domain_id = d.domain_id AND NOT c.state_code
WHERE NOT e.test AND d.show""")
def domain_summary(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d).withColumn("score", _r6("score"))
    rows = matrix.summary(t.entities(spark, d), t.domains(spark, d), _current(spark, d), scores)
    return rows.select("entity_id", "domain_id", "name", "type", "state_code", r4("score").alias("score"), "colour")


@R.add(f"SELECT entity_id, domain_id, {r4_sql('score')} AS score FROM scores")
def entity_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("entity_id", "domain_id", r4("score").alias("score"))


@R.add(f"""SELECT c.entity_id, c.domain_id, {r4_sql("sum(coalesce(m.score, 0) * q.weight)")} AS total, sum(q.weight)::BIGINT AS possible,
  floor(floor(sum(coalesce(m.score, 0) * q.weight) / sum(q.weight) * 100 * 1e6 + 0.5) / 1e6 + 0.5) / 10 AS overall
FROM current c JOIN questions q ON q.domain_id = c.domain_id LEFT JOIN mine m ON m.entity_id = c.entity_id AND m.domain_id = c.domain_id AND m.question_id = q.question_id GROUP BY 1, 2""")
def detailed_score(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.detailed_scores(_current(spark, d), t.questions(spark, d), t.answers(spark, d, current=True))
    return out.select("entity_id", "domain_id", r4("total").alias("total"), F.col("possible").cast("long").alias("possible"), "overall")


@R.add(f"""SELECT c.entity_id, c.domain_id, q.question_id, q.weight::INTEGER AS weight, {r4_sql("coalesce(m.score, 0)")} AS score, coalesce(m.confidence, 0) AS confidence, coalesce(m.answer, 'Not analyzed') AS answer
FROM current c JOIN questions q ON q.domain_id = c.domain_id LEFT JOIN mine m ON m.entity_id = c.entity_id AND m.domain_id = c.domain_id AND m.question_id = q.question_id""")
def questionnaire(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.questionnaire(_current(spark, d), t.questions(spark, d), t.answers(spark, d, current=True))
    return rows.select("entity_id", "domain_id", F.col("question_id").cast("long").alias("question_id"), "weight", r4("score").alias("score"), "confidence", "answer")


@R.add("SELECT * FROM stored")
def normalized_score(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)


@R.add(f"SELECT domain_id, {r4_sql('avg(score)')} AS mean_score, count(*)::BIGINT AS n_scored, (SELECT count(*) FROM entities)::BIGINT AS n_entities FROM scores GROUP BY domain_id")
def domain_averages(spark: SparkSession, d: str) -> DataFrame:
    return scoring.domain_summary(_scores(spark, d), t.entities(spark, d)).withColumn("mean_score", r4("mean_score"))


@R.add(f"""SELECT e.entity_id, d.domain_id, e.name, c.entity_id IS NOT NULL AS has_data, coalesce(c.state_code, false) AS state_code, {r4_sql("m.mean_score")} AS mean_score
FROM entities e CROSS JOIN domains d LEFT JOIN current c ON c.entity_id = e.entity_id AND c.domain_id = d.domain_id
LEFT JOIN (SELECT entity_id, domain_id, avg(score) AS mean_score FROM mine GROUP BY 1, 2) m ON m.entity_id = e.entity_id AND m.domain_id = d.domain_id AND NOT c.state_code
WHERE NOT e.test AND d.show""")
def combined_matrix(spark: SparkSession, d: str) -> DataFrame:
    means = scoring.plain_means(t.answers(spark, d, current=True))
    return matrix.combined(t.entities(spark, d), t.domains(spark, d), _current(spark, d), means).withColumn("mean_score", r4("mean_score"))


@R.add("SELECT domain_id, count(*)::BIGINT AS n_questions, sum(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END)::BIGINT AS total_weight FROM questions GROUP BY domain_id")
def question_weights(spark: SparkSession, d: str) -> DataFrame:
    return scoring.question_weights(t.questions(spark, d))


@R.add(f"""SELECT entity_id, string_agg(domain_id || '=' || (floor(score * 100 + 0.5)::BIGINT), ',' ORDER BY domain_id) AS scores, count(*)::BIGINT AS n_domains
FROM (SELECT entity_id, domain_id, {ROUNDED} AS score FROM scores) GROUP BY entity_id""")
def entity_score_maps(spark: SparkSession, d: str) -> DataFrame:
    """All domain scores of an entity."""
    cell = F.concat(F.col("domain_id"), F.lit("="), F.floor(_r6("score") * 100 + 0.5).cast("string"))
    return _scores(spark, d).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list(cell)), ",").alias("scores"), F.count("*").alias("n_domains"))


@R.add("""SELECT entity_id, domain_id, count(*)::BIGINT AS n_answers, string_agg(question_id || ':' || confidence::BIGINT, ',' ORDER BY question_id) AS confidences FROM mine GROUP BY 1, 2""")
def answer_maps(spark: SparkSession, d: str) -> DataFrame:
    maps = matrix.answer_map(t.answers(spark, d, current=True))
    cells = F.transform(F.map_entries("answers"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]["confidence"].cast("long").cast("string")))
    return maps.select("entity_id", "domain_id", F.size("answers").cast("long").alias("n_answers"), F.array_join(cells, ",").alias("confidences"))


@R.add("SELECT entity_id, domain_id, " + ", ".join(f"{r4_sql(f'max(score) FILTER (question_id = {i})')} AS q{i}" for i in range(1, 8)) + " FROM mine GROUP BY 1, 2")
def question_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = matrix.question_matrix(t.answers(spark, d, current=True), t.QUESTIONS)
    return wide.select("entity_id", "domain_id", *(r4(F.col(f"`{i}`")).alias(f"q{i}") for i in range(1, t.QUESTIONS + 1)))


@R.add("""SELECT c.entity_id, count(*)::BIGINT AS n_available, string_agg(c.domain_id, ',' ORDER BY c.domain_id) AS available, (SELECT count(*) FROM domains v WHERE v.show)::BIGINT AS n_domains
FROM current c JOIN domains d ON d.domain_id = c.domain_id WHERE d.show GROUP BY c.entity_id""")
def entity_domains(spark: SparkSession, d: str) -> DataFrame:
    return matrix.entity_domains(t.domains(spark, d), _current(spark, d))


@R.add(f"""SELECT c.entity_id, c.domain_id, e.name,
  CASE WHEN c.state_code THEN 'State' WHEN s.score IS NULL THEN 'None' WHEN s.score >= 0.7 THEN 'Very Good' WHEN s.score >= 0.5 THEN 'Good' WHEN s.score >= 0.3 THEN 'Yellow' ELSE 'Red' END AS grade,
  CASE WHEN c.state_code THEN '#94a3b8' ELSE {hex_sql("coalesce(s.score, 0)")} END AS colour
FROM current c JOIN entities e ON e.entity_id = c.entity_id LEFT JOIN (SELECT entity_id, domain_id, {ROUNDED} AS score FROM scores) s ON s.entity_id = c.entity_id AND s.domain_id = c.domain_id WHERE NOT e.test""")
def domain_grades(spark: SparkSession, d: str) -> DataFrame:
    return matrix.grades(t.entities(spark, d), _current(spark, d), _scores(spark, d).withColumn("score", _r6("score")))


@R.add(f"""SELECT domain_id, {r4_sql("avg(score)")} AS mean_score, (arg_max(entity_id, (score, -entity_id)) FILTER (score > 0)) AS best_entity
FROM (SELECT entity_id, domain_id, {ROUNDED} AS score FROM scores) GROUP BY domain_id""")
def best_entities(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_entities(_scores(spark, d).withColumn("score", _r6("score"))).withColumn("mean_score", r4("mean_score"))


@R.add(f"SELECT entity_id, domain_id, rank() OVER (PARTITION BY domain_id ORDER BY score DESC)::INTEGER AS rank FROM (SELECT entity_id, domain_id, {ROUNDED} AS score FROM scores)")
def entity_ranks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.entity_rank(_scores(spark, d).withColumn("score", _r6("score"))).select("entity_id", "domain_id", "rank")


@R.add(f"SELECT domain_id, {r4_sql('avg(normalized)')} AS mean, min(normalized) AS least, max(normalized) AS most, count(*) FILTER (normalized > 0 AND confidence <= 10)::BIGINT AS n_low_confidence FROM stored GROUP BY domain_id")
def report_overall(spark: SparkSession, d: str) -> DataFrame:
    return report.overall(_stored(spark, d)).withColumn("mean", r4("mean"))


@R.add(f"""SELECT domain_id, question_id, count(*)::BIGINT AS n, {r4_sql("avg(s) FILTER (rated)")} AS mean, {r4_sql("min(s) FILTER (rated)")} AS least, {r4_sql("max(s) FILTER (rated)")} AS most,
  count(*) FILTER (rated AND s >= 0 AND s < 2.5)::BIGINT AS b1, count(*) FILTER (rated AND s >= 2.5 AND s < 5)::BIGINT AS b2, count(*) FILTER (rated AND s >= 5 AND s < 7.5)::BIGINT AS b3, count(*) FILTER (rated AND s >= 7.5 AND s < 10.001)::BIGINT AS b4,
  count(*) FILTER (NOT rated)::BIGINT AS n_none, arg_max(entity_id, (s, -entity_id)) FILTER (rated) AS best_entity
FROM (SELECT *, score * 10 AS s, answer NOT IN ({NONE}) AS rated FROM mine) GROUP BY 1, 2""")
def report_questions(spark: SparkSession, d: str) -> DataFrame:
    out = report.per_question(t.answers(spark, d, current=True))
    return out.withColumns({c: r4(c) for c in ("mean", "least", "most")})


@R.add("SELECT domain_id, " + ", ".join(f"count(*) FILTER (least(floor(normalized), 9) = {i})::BIGINT AS d{i}" for i in range(10)) + ", ((SELECT count(*) FROM entities) - count(*))::BIGINT AS n_no_data FROM stored GROUP BY domain_id")
def report_deciles(spark: SparkSession, d: str) -> DataFrame:
    return report.deciles(_stored(spark, d), t.entities(spark, d))


@R.add("""SELECT q.domain_id, n_questions::BIGINT AS n_questions, coalesce(n_analysed, 0)::BIGINT AS n_analysed, n_entities::BIGINT AS n_entities, floor(100.0 * coalesce(n_analysed, 0) / n_entities + 0.5)::BIGINT AS percent
FROM (SELECT domain_id, count(*) AS n_questions FROM questions GROUP BY 1) q LEFT JOIN (SELECT domain_id, count(DISTINCT entity_id) AS n_analysed FROM current GROUP BY 1) c ON c.domain_id = q.domain_id, (SELECT count(*) AS n_entities FROM entities)""")
def describe_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(t.questions(spark, d), _current(spark, d), t.entities(spark, d))


@R.add("""SELECT CASE WHEN grouping(type) = 1 THEN 'TOTAL' ELSE type END AS type, count(*) FILTER (coalesce(n, 0) > 0)::BIGINT AS n_with, count(*)::BIGINT AS n_all
FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM current GROUP BY 1) c ON c.entity_id = e.entity_id GROUP BY ROLLUP (type)""")
def type_coverage(spark: SparkSession, d: str) -> DataFrame:
    counts = _current(spark, d).groupBy("entity_id").agg(F.count("*").alias("n"))
    return report.type_coverage(t.entities(spark, d), counts)


@R.add(f"""SELECT entity_id, domain_id, normalized, CASE WHEN normalized >= 7 THEN '#22c55e' WHEN normalized >= 4 AND normalized <= 6.99 THEN '#eab308' WHEN normalized < 4 THEN '#d21404' END AS colour,
  CASE WHEN normalized / 10 < 0.3 THEN 'low' WHEN normalized / 10 < 0.7 THEN 'medium' ELSE 'high' END AS band, {hex_sql("normalized / 10")} AS colour_hex, (floor(normalized / 10 * 100 + 0.5)::BIGINT) || '%' AS label FROM stored""")
def score_colours(spark: SparkSession, d: str) -> DataFrame:
    """An ordered mapping of ranges, named colours, bands, gradient and labels."""
    n = F.col("normalized")
    mapping = [(">=7", "green"), ("4-6.99", "yellow"), ("<4", "red")]
    return _stored(spark, d).select("entity_id", "domain_id", "normalized", numbers.colour_of(n, mapping).alias("colour"), numbers.band(n / 10).alias("band"), numbers.green_hex(n / 10).alias("colour_hex"), numbers.percent_text(n / 10).alias("label"))


@R.add(f"SELECT entity_id, domain_id, floor(normalized * 10 * 10 + 0.5) / 10 AS display, {hex_sql('normalized')} AS colour_hex FROM stored")
def domain_score_display(spark: SparkSession, d: str) -> DataFrame:
    """The stored score times ten and the colour of the stored score itself, clamped, as the score pages show them."""
    return _stored(spark, d).select("entity_id", "domain_id", (F.floor(F.col("normalized") * 10 * 10 + 0.5) / 10).alias("display"), numbers.green_hex(F.col("normalized")).alias("colour_hex"))


@R.add("SELECT analysis_id, entity_id, domain_id, strftime(ts, '%Y-%m-%d') AS day, version::INTEGER AS version, version = 1 AS is_current FROM analyses")
def analysis_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.history(t.analyses(spark, d).drop("version"))
    return rows.select("analysis_id", "entity_id", "domain_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "version", "is_current")


@R.add("""SELECT entity_id, domain_id, strftime(ts, '%Y') AS period, max_by(analysis_id, (ts, analysis_id)) AS analysis_id, (count(*) - 1)::BIGINT AS n_pruned
FROM analyses WHERE version > 1 GROUP BY 1, 2, 3""")
def pruned_backups(spark: SparkSession, d: str) -> DataFrame:
    """E03, over years: the synthetic orders of one customer and priority seldom share a day."""
    return versions.last_per_period(t.analyses(spark, d).where("version > 1"), "yyyy")


@R.add(f"""SELECT n.entity_id, n.domain_id, n.question_id, {r4_sql("o.score")} AS old_score, {r4_sql("n.score")} AS new_score, o.answer IS DISTINCT FROM n.answer AS answer_changed
FROM answers n JOIN answers o ON o.entity_id = n.entity_id AND o.domain_id = n.domain_id AND o.question_id = n.question_id AND n.version = 1 AND o.version = 2
WHERE o.answer IS DISTINCT FROM n.answer OR abs({r4_sql("o.score")} - {r4_sql("n.score")}) >= 0.1""")
def analysis_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the last two versions."""
    rows = t.answers(spark, d).withColumn("score", r4("score"))
    out = versions.diff(rows.where("version = 2"), rows.where("version = 1"), 0.1)
    return out


@R.add("""SELECT entity_id, domain_id, question_id, action FROM (
  SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, coalesce(n.domain_id, o.domain_id) AS domain_id, coalesce(n.question_id, o.question_id) AS question_id,
         CASE WHEN n.entity_id IS NULL THEN 'remove' WHEN o.entity_id IS NULL OR n.answer <> o.answer THEN 'analyze' ELSE 'keep' END AS action
  FROM (SELECT * FROM answers WHERE version = 1) n FULL JOIN (SELECT * FROM answers WHERE version = 2) o ON o.entity_id = n.entity_id AND o.domain_id = n.domain_id AND o.question_id = n.question_id)""")
def question_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which questions to analyse, keep or remove, by comparing what is asked with what was answered."""
    rows = t.answers(spark, d)
    key = ["entity_id", "domain_id", "question_id"]
    new, old = rows.where("version = 1").select(*key, F.col("answer").alias("wording")), rows.where("version = 2").select(*key, F.col("answer").alias("wording"))
    return versions.compare(new, old, key)


@R.add("""SELECT entity_id, domain_id, question_id, max_by(answer, -version) AS answer FROM answers WHERE version <= 2 GROUP BY 1, 2, 3""")
def merged_answers(spark: SparkSession, d: str) -> DataFrame:
    """New answers override old ones, kept in the questions' order."""
    rows = t.answers(spark, d).select("entity_id", "domain_id", "question_id", "version", "answer")
    return versions.override(rows.where("version = 2"), rows.where("version = 1"), ["entity_id", "domain_id", "question_id"]).drop("version")


@R.add(f"""SELECT q.domain_id, q.question_id::BIGINT AS question_id FROM questions q LEFT JOIN (SELECT domain_id, question_id, max(answer) AS w FROM answers WHERE version = 1 AND score > 0.8 AND answer <> '{t.NOT_IN_STATUTE}' AND question_id < 5 GROUP BY 1, 2) b
  ON b.domain_id = q.domain_id AND b.question_id = q.question_id WHERE b.w IS NULL OR b.w <> 'x'""")
def stale_best_practices(spark: SparkSession, d: str) -> DataFrame:
    """C14: questions without a best practice, or whose wording differs from it."""
    best = t.answers(spark, d, current=True).where(f"score > 0.8 AND answer <> '{t.NOT_IN_STATUTE}' AND question_id < 5").groupBy("domain_id", "question_id").agg(F.max("answer").alias("wording"))
    asked = t.questions(spark, d).select("domain_id", F.col("question_id").cast("long").alias("question_id"), F.lit("x").alias("wording"))
    return versions.outdated(asked, best, ["domain_id", "question_id"]).select("domain_id", "question_id")


@R.add(f"""SELECT entity_id, domain_id, question_id, CASE WHEN domain_id <> '5-LOW' AND answer = '{t.NOT_IN_STATUTE}' THEN '{scoring.NOT_SPECIFIED[0]}' ELSE answer END AS answer FROM mine""")
def sentinel_answers(spark: SparkSession, d: str) -> DataFrame:
    """Outside the general domain one sentinel stands for the other."""
    return versions.replace_sentinel(t.answers(spark, d, current=True), "5-LOW", scoring.NOT_SPECIFIED[2], scoring.NOT_SPECIFIED[0]).select("entity_id", "domain_id", "question_id", "answer")


@R.add(f"""SELECT m.entity_id, m.domain_id, m.question_id, {r4_sql("b.best - m.score")} AS gap, m.score >= b.best AS is_best
FROM mine m JOIN (SELECT domain_id, question_id, max(score) AS best FROM mine GROUP BY 1, 2) b ON b.domain_id = m.domain_id AND b.question_id = m.question_id""")
def best_practice_gap(spark: SparkSession, d: str) -> DataFrame:
    """How far each answer is behind the best one to its question."""
    rows = t.answers(spark, d, current=True)
    return versions.gap_to_best(rows).withColumn("gap", r4("gap")).select("entity_id", "domain_id", "question_id", "gap", "is_best")


@R.add("""SELECT domain_id, question_id, rn AS rank, entity_id, answer FROM (
  SELECT *, row_number() OVER (PARTITION BY domain_id, question_id ORDER BY length(answer) DESC, entity_id)::INTEGER AS rn FROM mine) WHERE rn <= 8""")
def top_answers(spark: SparkSession, d: str) -> DataFrame:
    """the eight longest answers to each question."""
    return versions.longest(t.answers(spark, d, current=True), 8).select("domain_id", "question_id", "rank", "entity_id", "answer")
