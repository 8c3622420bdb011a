"""Queries of whole runs: best practices, sources from ordinances, gaps by a given scoring function, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import runs, scoring
from quorumlake.plans.registry import Registry, r4, r4_sql
from quorumlake.plans.text_queries import ORDINANCES_SQL, _ordinances
from quorumlake.sources import folders
from quorumlake.sources import tables as t

R = Registry(t.CIVIC_SQL)

# The last run knew domains 1 and 3, their questions under 5, of which every second had another wording.
KNOWN = "domain_id IN ('1-URGENT', '3-MEDIUM')"
MINE_SQL = f"""WITH {t.CIVIC_SQL},
mine AS (SELECT entity_id, domain_id, question_id, answer, score FROM answers WHERE version = 1)"""
KNOWN_SQL = f"known AS (SELECT domain_id, question_id, CASE WHEN question_id % 2 = 0 THEN 'other' ELSE 'Q' || question_id END AS wording, 'old ' || question_id AS practice FROM questions WHERE {KNOWN} AND question_id < 5)"


def _practice_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers = t.answers(spark, d, current=True).select("entity_id", "domain_id", "question_id", "answer", "score")
    asked = t.questions(spark, d).select("domain_id", F.col("question_id").cast("int").alias("question_id"), F.concat(F.lit("Q"), "question_id").alias("wording"))
    wording = F.when(F.col("question_id") % 2 == 0, "other").otherwise(F.col("wording"))
    return answers, asked, asked.where(f"{KNOWN} AND question_id < 5").select("domain_id", "question_id", wording.alias("wording"), F.concat(F.lit("old "), "question_id").alias("practice"))


def _said(prompt: str) -> str:
    """A stand-in that shows what it was asked: the number of answers and the length of the request."""
    return f"Best practice: {prompt.count('Answer:')} answers, {len(prompt)}"


@R.add(f"""{MINE_SQL}, {KNOWN_SQL},
every AS (SELECT DISTINCT m.domain_id, m.question_id, CASE WHEN q.question_id IS NOT NULL THEN 'Q' || q.question_id END AS wording FROM mine m LEFT JOIN questions q ON q.domain_id = m.domain_id AND q.question_id = m.question_id),
due AS (
  SELECT q.domain_id, q.question_id, 'Q' || q.question_id AS wording FROM questions q LEFT JOIN known k ON k.domain_id = q.domain_id AND k.question_id = q.question_id
  WHERE q.domain_id IN (SELECT domain_id FROM known) AND (k.wording IS NULL OR k.wording <> 'Q' || q.question_id)
  UNION ALL SELECT * FROM every WHERE domain_id NOT IN (SELECT domain_id FROM known)),
top AS (SELECT m.*, row_number() OVER (PARTITION BY m.domain_id, m.question_id ORDER BY length(answer) DESC, entity_id) AS rank FROM mine m JOIN due ON due.domain_id = m.domain_id AND due.question_id = m.question_id),
fresh AS (SELECT domain_id, question_id, count(*) AS n, sum(length('entity ' || rank || ': ' || entity_id || chr(10) || 'Answer: ' || answer)) + 5 * (count(*) - 1) AS chars FROM top WHERE rank <= 8 GROUP BY 1, 2)
SELECT domain_id, question_id::INTEGER AS question_id, wording, practice FROM known k WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.domain_id = k.domain_id AND due.question_id = k.question_id)
UNION ALL SELECT f.domain_id, f.question_id::INTEGER, due.wording, f.n || ' answers, ' || f.chars::BIGINT FROM fresh f JOIN due ON due.domain_id = f.domain_id AND due.question_id = f.question_id""", common=False)
def practice_run(spark: SparkSession, d: str) -> DataFrame:
    """Two domains have an older run, of which what is due is made anew."""
    return runs.meta_analysis(*_practice_inputs(spark, d), _said, "none")[0]


@R.add(f"""{MINE_SQL}, means AS (SELECT entity_id, domain_id, avg(coalesce(score, 0)) AS score FROM mine GROUP BY 1, 2)
SELECT domain_id, count(*)::BIGINT AS n_analysed, {r4_sql('avg(score)')} AS mean_score, count(*) FILTER (score >= top - 1e-9)::BIGINT >= 1 AS has_best FROM means JOIN (SELECT domain_id AS d, max(score) AS top FROM means GROUP BY 1) ON d = domain_id GROUP BY 1""", common=False)
def practice_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What the run tells of each domain."""
    rows = runs.meta_analysis(*_practice_inputs(spark, d), _said, "none")[1]
    return rows.select("domain_id", "n_analysed", r4("mean_score").alias("mean_score"), F.col("best_entity").isNotNull().alias("has_best"))


TOPICS = (("paths", "Paths", ("that", "thing")), ("wege", "Wege", ("wein", "schaft")))
#: What the judge says of an excerpt: relevant by its letters, confident by its length.
JUDGE_SQL = "(length(content) % 3 <> 0 AND length(content) % 90 >= 60)"


def _judge(prompt: str) -> str:
    content = prompt.split("?\n", 1)[1]
    return f'{{"relevant": {str(len(content) % 3 != 0).lower()}, "confidence": {len(content) % 90}}}'


def _topic_sql(words: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(header, '(?i)\\b{w}') OR regexp_matches(content, '(?i)\\b{w}')" for w in words)


@R.add(f"""WITH {ORDINANCES_SQL},
people AS (SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'EN' ELSE 'de' END AS state, 'SRC' || (s_suppkey % 25) AS city FROM supplier),
about AS ({" UNION ALL ".join(f"SELECT *, '{d}' AS domain_id FROM ordinances WHERE is_substantive AND ({_topic_sql(w)})" for d, _, w in TOPICS)}),
met AS (SELECT * FROM (SELECT p.entity_id, a.*, row_number() OVER (PARTITION BY p.entity_id, domain_id ORDER BY doc_id) AS nth FROM people p JOIN about a ON upper(a.state) = upper(p.state) AND contains(lower(a.city), lower(p.city))) WHERE nth <= 25),
kept AS (SELECT entity_id, domain_id, doc_id, header AS title, (length(content) % 90)::DOUBLE AS confidence,
  'locus://' || coalesce(nullif(lower(state), ''), 'na') || '/' || coalesce(nullif(lower(county), ''), 'na') || '/' || coalesce(nullif(lower(city), ''), 'na') || '/' || substr(sha256(coalesce(header, '') || content), 1, 16) AS source_url
  FROM met WHERE length(content) >= 200 AND {JUDGE_SQL}),
once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY entity_id, domain_id, source_url ORDER BY doc_id) = 1)
SELECT entity_id, domain_id, doc_id, source_url, title, 'statute' || row_number() OVER (PARTITION BY entity_id, domain_id ORDER BY doc_id) || '.txt' AS filename, confidence FROM once""", common=False)
def populated_sources(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for entities, whose places are parts of the ordinances' sources."""
    k = F.col("s_suppkey")
    people = t.table(spark, d, "supplier").select(k.alias("entity_id"), F.when(k % 2 == 0, "EN").otherwise("de").alias("state"), F.concat(F.lit("SRC"), k % 25).alias("city"))
    domains = spark.createDataFrame([(i, n, list(w)) for i, n, w in TOPICS], "domain_id string, name string, keywords array<string>")
    return runs.populate(people, domains, _ordinances(spark, d), _judge)


def _gaps(spark: SparkSession, d: str, calculate_score: runs.Score) -> DataFrame:
    """Conversations' turns as answers to the turns before them, in two domains; every seventh benchmark text as a best practice."""
    c = t.table(spark, d, "conversations").withColumn("domain_id", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    answers = c.alias("a").join(c.alias("q"), (F.col("a.conv_id") == F.col("q.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1)).select(
        F.col("a.conv_id").alias("entity_id"), F.col("a.domain_id").alias("domain_id"), F.col("a.turn").alias("question_id"), F.col("q.text").alias("question"), F.col("a.text").alias("answer"), (F.length("a.text") % 100).cast("double").alias("confidence")
    )
    b = t.table(spark, d, "benchmark").where("item_id % 7 = 0")
    practices = b.select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("domain_id"), F.col("item_id").alias("practice_id"), F.col("text").alias("question"), F.col("text").alias("practice"), F.lit(1).alias("best_score"), F.lit("e").alias("best_entity"))
    return runs.gap_requests(answers, practices, calculate_score)


def _gap_sql(score: str) -> str:
    words = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 3))"
    return f"""WITH c AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain_id FROM conversations),
a AS (SELECT x.conv_id AS entity_id, x.domain_id, x.turn AS question_id, q.text AS question, x.text AS answer, (length(x.text) % 100)::DOUBLE AS confidence FROM c x JOIN c q ON q.conv_id = x.conv_id AND x.turn = q.turn + 1),
p AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain_id, item_id AS practice_id, text AS question, {words.format('text')} AS w FROM benchmark WHERE item_id % 7 = 0),
m AS (SELECT q.domain_id, q.question, min(practice_id) AS practice_id FROM (SELECT DISTINCT domain_id, question, {words.format('question')} AS w FROM a) q JOIN p ON p.domain_id = q.domain_id AND (lower(p.question) = lower(q.question) OR len(list_intersect(p.w, q.w)) >= 2) GROUP BY 1, 2),
s AS (SELECT *, {score} AS score FROM a)
SELECT s.entity_id, s.domain_id, s.question_id, floor(s.score * 10000 + 0.5) / 10000 AS score, m.practice_id FROM s LEFT JOIN m ON m.domain_id = s.domain_id AND m.question = s.question WHERE coalesce(s.score < 1, true)"""


def _by_confidence(answer: Column, confidence: Column) -> Column:
    return confidence / 50


def _by_length(answer: Column, confidence: Column) -> Column:
    return F.length(answer) / 300


@R.add(_gap_sql("confidence / 50"), common=False)
def gaps_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A scoring function that is given."""
    return _gaps(spark, d, _by_confidence).select("entity_id", "domain_id", "question_id", r4("score").alias("score"), "practice_id")


@R.add(_gap_sql("length(answer) / 300"), common=False)
def gaps_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Another scoring function, other answers with a gap."""
    return _gaps(spark, d, _by_length).select("entity_id", "domain_id", "question_id", r4("score").alias("score"), "practice_id")


@R.add(f"""{MINE_SQL},
cells AS (SELECT entity_id, domain_id, question_id, score FROM mine)
SELECT domain_id, 'matrix' AS report, count(DISTINCT entity_id)::BIGINT AS n, floor(sum(score) * 1000 + 0.5) / 1000 AS total FROM cells WHERE question_id <= {t.QUESTIONS} GROUP BY 1
UNION ALL SELECT domain_id, 'questions', count(DISTINCT question_id)::BIGINT, count(*)::DOUBLE FROM cells GROUP BY 1
UNION ALL SELECT domain_id, 'deciles', 1, (SELECT count(*) FROM entities)::DOUBLE FROM cells GROUP BY 1
UNION ALL SELECT domain_id, 'overall', 1, 0.0 FROM cells GROUP BY 1""", common=False)
def report_run(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all domains, written and read back; told by their rows and totals."""
    answers = folders.kept(t.answers(spark, d, current=True).select("entity_id", "domain_id", "question_id", "answer", "score", "confidence"))
    stored = folders.kept(scoring.normalized_scores(answers, t.questions(spark, d)))
    folder = folders.shared(spark)
    runs.domain_reports(answers.select("entity_id", "domain_id", "question_id", "answer", "score"), stored, t.entities(spark, d), folder, t.QUESTIONS)
    read = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}")
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cells = sum((double(f"`{i}`") for i in range(1, t.QUESTIONS + 1)), F.lit(0.0))
    rows = read("matrix").groupBy("domain_id").agg(F.lit("matrix").alias("report"), F.count("*").alias("n"), (F.floor(F.sum(cells) * 1000 + 0.5) / 1000).alias("total"))
    rows = rows.union(read("questions").groupBy("domain_id").agg(F.lit("questions"), F.count("*"), F.sum(double("n"))))
    tenths = sum((double(f"d{i}") for i in range(10)), double("n_no_data"))
    rows = rows.union(read("deciles").groupBy("domain_id").agg(F.lit("deciles"), F.count("*"), F.sum(tenths)))
    return rows.union(read("overall").groupBy("domain_id").agg(F.lit("overall"), F.count("*"), F.lit(0.0)))
