"""Whole runs made of the library's steps: best practices of domains, sources from ordinances, gaps of answers, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.text import keyword_pattern
from quorumlake.operators import ordinances as found
from quorumlake.operators import report, rules, scoring, upkeep, versions
from quorumlake.operators.lookup import overlapping, word_set
from quorumlake.operators.matrix import question_matrix
from quorumlake.providers import models

PAIR = ["domain_id", "question_id"]
#: Answers that a best practice is made of, and keywords of a domain that are searched.
TOP_ANSWERS, KEYWORDS = 8, 20
#: Fixed value: confidence below which an answer counts as unsure.
UNSURE = 40


def meta_analysis(answers: DataFrame, asked: DataFrame, known: DataFrame, ask: Callable[[str], str], sentinel: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best practices of all domains, made anew where that is due, and a summary of each domain.

    answers: entity_id, domain_id, question_id, answer, score; asked: domain_id, question_id, wording (the questions of
    now); known: domain_id, question_id, wording, practice (the best practices of the last run).  Due are questions that
    have no best practice or another wording (C14), all answered ones of a domain without any best practice, and with
    ``force`` all of every domain.  Those that are due take a new one from their longest answers (F06, K04) or, without
    answers, none; the others stay.  Only what is due is asked for.

    Returns practices (domain_id, question_id, wording, practice) and summaries (domain_id, n_analysed, mean_score: the
    mean of the analyses' mean scores, missing scores 0; best_entity: of the highest mean above 0, the first by id).
    """
    started = known.select("domain_id").distinct()
    given = answers.where(F.coalesce("answer", F.lit("")) != "")
    every = given.select(*PAIR).distinct().join(asked, PAIR, "left")
    if force:
        due = every
    else:
        due = versions.outdated(asked, known, PAIR).join(started, "domain_id", "left_semi").select(*PAIR, "wording").unionByName(every.join(started, "domain_id", "left_anti").select(*PAIR, "wording"))
    top = versions.longest(given.join(due.select(*PAIR), PAIR, "left_semi").select("entity_id", *PAIR, "answer"), TOP_ANSWERS)
    fresh = models.best_practices(top.withColumn("entity_id", F.col("entity_id").cast("string")), ask, sentinel).join(due, PAIR)
    kept = known.join(due.select(*PAIR), PAIR, "left_anti") if not force else known.limit(0)
    columns = [*PAIR, "wording", "practice"]
    means = answers.groupBy("entity_id", "domain_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    summary = scoring.best_entities(means).join(means.groupBy("domain_id").agg(F.count("*").alias("n_analysed")), "domain_id")
    return kept.select(*columns).unionByName(fresh.select(*columns)), summary.select("domain_id", "n_analysed", "mean_score", "best_entity")


def populate(entities: DataFrame, domains: DataFrame, ordinances: DataFrame, ask: Callable[[str], str], limit: int = 25, least_chars: int = 200, least_confidence: float = 60) -> DataFrame:
    """Sources of each entity and domain from ordinances of its place that are about the domain.

    entities: entity_id, state, city (a part of the ordinances' city); domains: domain_id, name, keywords; ordinances as
    in ordinances.Search, with doc_id.  An ordinance is a candidate if its header or content has a word that begins with
    one of the domain's first KEYWORDS keywords; of an entity's and domain's candidates the first ``limit`` by doc_id are
    looked at, those of some length are judged (K06, once for each ordinance and domain), and those judged relevant with
    enough confidence become statutes, numbered in order.

    Returns entity_id, domain_id, doc_id, source_url, title, filename, confidence.  Words are looked for once in each
    ordinance for all domains, and places meet by one automaton over all cities, then on equality.  Entities of one state
    and city have the same candidates, so what meets is places, and of each place's ordinances ``limit``.
    """
    words = domains.select("domain_id", F.explode(F.slice("keywords", 1, KEYWORDS)).alias("word")).where(F.length("word") > 0)
    patterns = {d: keyword_pattern(sorted({r.word for r in rows})) for d, rows in _grouped(words)}  # domains are configuration
    about = F.array_compact(F.array(*(F.when(F.coalesce(F.col("header").rlike(p), F.lit(False)) | F.coalesce(F.col("content").rlike(p), F.lit(False)), F.lit(d)) for d, p in sorted(patterns.items()))))
    rows = ordinances.where("is_substantive").withColumn("domain_id", F.explode(about if patterns else F.array().cast("array<string>")))
    keyed = rows.select("doc_id", "domain_id", F.upper("state").alias("s"), F.lower("city").alias("c"))
    some = lambda df, *key: df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).where(F.col("nth") <= limit).drop("nth")
    heads = some(keyed, "domain_id", "s", "c")  # an entity's first ones are among the first ones of its places
    placed = entities.groupBy("entity_id").agg(F.sort_array(F.collect_set(F.struct("state", "city"))).alias("places"))
    wanted = placed.select("places").distinct().select(F.col("places").alias("entity_id"), F.inline("places"))
    met = some(found.places_of(wanted, heads).join(heads, ["s", "c"]), "entity_id", "domain_id").select(F.col("entity_id").alias("places"), "doc_id", "domain_id")
    first = Window.partitionBy("entity_id", "domain_id").orderBy("doc_id")
    texts = ordinances.where(F.length("content") >= least_chars)
    candidates = met.select("doc_id", "domain_id").distinct().join(texts, "doc_id").join(domains.select("domain_id", "name"), "domain_id")
    judged = models.judged(candidates.select("doc_id", "domain_id", "name", "content", "header", "state", "county", "city"), ask)
    kept = upkeep.relevant(judged, least_chars, least_confidence)
    url = found.synthetic_url(F.lower("state"), F.lower("county"), F.lower("city"), F.coalesce("header", F.lit("")), F.col("content"))
    sources = kept.select("doc_id", "domain_id", url.alias("source_url"), F.coalesce("header", F.lit("LOCUS ordinance excerpt")).alias("title"), "confidence")
    own = met.join(sources, ["doc_id", "domain_id"]).join(placed, "places")
    once = own.groupBy("entity_id", "domain_id", "source_url").agg(F.min_by(F.struct("doc_id", "title", "confidence"), "doc_id").alias("r")).select("entity_id", "domain_id", "source_url", "r.*")
    return once.withColumn("filename", F.concat(F.lit("statute"), F.row_number().over(first), F.lit(".txt")))


def _grouped(words: DataFrame) -> list[tuple[str, list]]:
    rows = words.collect()
    return [(d, [r for r in rows if r.domain_id == d]) for d in sorted({r.domain_id for r in rows})]


Score = Callable[[Column, Column], Column]


def gap_requests(answers: DataFrame, practices: DataFrame, calculate_score: Score) -> DataFrame:
    """Requests for what is missing in answers, by a scoring function of the caller's own over (answer, confidence).

    answers: entity_id, domain_id, question_id, question, answer, confidence; practices: domain_id, practice_id,
    question (their wording), practice, best_score, best_entity.  Answers that score 1 or more have no gap and no row.
    The best practice is the first by id whose wording is the question's or shares two words of more than three letters
    with it (C29).  Questions meet practices under a digest, so their words are shuffled without their texts.  Returns the
    answer's keys, score, practice_id (null if none), prompt.
    """
    rows = answers.withColumn("score", calculate_score(F.col("answer"), F.col("confidence"))).where(F.coalesce(F.col("score") < 1.0, F.lit(True)))
    rows = rows.withColumn("__q", F.unhex(F.sha2("question", 256)))
    low = F.unhex(F.sha2(F.lower("question"), 256)).alias("low")
    asked = answers.where("question IS NOT NULL").select("domain_id", F.unhex(F.sha2("question", 256)).alias("__q"), low, word_set(F.col("question"), 4).alias("words")).dropDuplicates(["domain_id", "__q"])
    offered = practices.select("domain_id", "practice_id", low, word_set(F.col("question"), 4).alias("words"))
    tagged = lambda df, key: df.select(F.struct("domain_id", key).alias("id"), F.transform("words", lambda w: F.concat("domain_id", F.lit("/"), w)).alias("words"))  # noqa: E731  words of a domain meet those of the same one
    two = overlapping(tagged(asked, "__q").withColumnRenamed("id", "a"), tagged(offered, "practice_id").withColumnRenamed("id", "b"), "a", "b", 2).select("a.domain_id", "a.__q", "b.practice_id")
    same = asked.select("domain_id", "__q", "low").join(offered.drop("words"), ["domain_id", "low"]).select("domain_id", "__q", "practice_id")
    first = two.union(same).groupBy("domain_id", "__q").agg(F.min("practice_id").alias("practice_id"))
    out = rows.join(first, ["domain_id", "__q"], "left").join(practices.select("domain_id", "practice_id", "practice", "best_score", "best_entity"), ["domain_id", "practice_id"], "left")
    told = F.when(F.col("practice_id").isNotNull(), F.concat(F.lit("\nBest practice of "), F.coalesce(F.col("best_entity").cast("string"), F.lit("unknown")), F.lit(" ("), F.coalesce(F.col("best_score").cast("string"), F.lit("?")), F.lit("): "), F.substring(F.coalesce("practice", F.lit("")), 1, 200))).otherwise("")
    sure = F.when(scoring.not_specified(F.col("answer")), "none").when(F.col("confidence") < UNSURE, "unsure").otherwise("answered")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer ("), sure, F.lit("): "), F.coalesce("answer", F.lit("")), told, F.lit("\n"), rules.guidance(F.col("question")))
    return out.select("entity_id", "domain_id", "question_id", "score", "practice_id", prompt.alias("prompt"))


def domain_reports(answers: DataFrame, stored: DataFrame, entities: DataFrame, folder: str, n_questions: int) -> None:
    """The report of every domain: overall scores, questions, deciles and the matrix of answers.

    answers: entity_id, domain_id, question_id, answer, score; stored: as scoring.normalized_scores() gives it.  Each is a
    table of CSV files in a folder for each domain, written by the tasks that have its rows; none is gathered in one.
    """
    tables = {"overall": report.overall(stored), "questions": report.per_question(answers), "deciles": report.deciles(stored, entities), "matrix": question_matrix(answers, n_questions)}
    for name, rows in tables.items():
        rows.repartition("domain_id").sortWithinPartitions(*[c for c in ("domain_id", "question_id", "entity_id") if c in rows.columns]).write.partitionBy("domain_id").option("header", True).csv(f"{folder}/{name}")
