"""Joins that pick one partner: by section, title, name, words or edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_urls(wanted: DataFrame, index: DataFrame, fallback: DataFrame) -> DataFrame:
    """Address of a section: the second of several matches, else the only one, else that of the ruleset.

    wanted: entity_id, domain_id, section; index: also position and url; fallback: entity_id, domain_id, ruleset_url.
    """
    key = ["entity_id", "domain_id", "section"]
    pick = index.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("position"))).where("n <= 2")
    best = pick.groupBy(*key).agg(F.max_by("url", "n").alias("url"))
    out = wanted.join(best, key, "left").join(fallback, ["entity_id", "domain_id"], "left")
    return out.select(*key, F.coalesce("url", "ruleset_url").alias("url"))


def by_title(pages: DataFrame, history: DataFrame, least: int = 10) -> DataFrame:
    """The first record whose title is the page's, if it is long enough and no address."""
    titled = lambda df: df.withColumn("t", F.lower(F.trim("title"))).where((F.length("t") >= least) & ~F.col("t").rlike("^https?://"))
    first = titled(history).groupBy("t").agg(F.min_by("url", "position").alias("found"))
    return titled(pages).join(first, "t").drop("t")


def word_set(text: Column, least: int) -> Column:
    """The distinct words of a text with so many characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def _counted_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """w, n: how many sets of both sides hold each word that either has."""
    return left.select(F.explode("words").alias("w")).union(right.select(F.explode("words").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))


def _rare_words(rows: DataFrame, key: str, counts: DataFrame, spare: int) -> DataFrame:
    """key, w: the words of each set without its ``spare`` commonest ones, ties by the word."""
    each = rows.select(key, F.explode("words").alias("w")).join(counts, "w")
    order = F.array_sort(F.collect_list(F.struct("n", "w")))
    return each.groupBy(key).agg(order.alias("o")).select(key, F.explode(F.slice("o", F.lit(1), F.greatest(F.size("o") - spare, F.lit(0)))).alias("o")).select(key, "o.w")


def overlapping(left: DataFrame, right: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """a, b, shared: every pair of sets (column words) with ``least`` words in common or more.

    A prefix filter: words are ordered by how many sets hold them, and sets with ``least`` in common share one of the
    words that are left when either drops its least - 1 commonest.  Pairs meet on those and are verified on the full
    sets, so the commonest words, which most pairs have in common, bring no pair together by themselves.
    """
    counts = _counted_words(left, right)
    met = _rare_words(left, a, counts, least - 1).join(_rare_words(right, b, counts, least - 1), "w").select(a, b).distinct()
    full = met.join(left.select(a, F.col("words").alias("__a")), a).join(right.select(b, F.col("words").alias("__b")), b)
    return full.select(a, b, F.size(F.array_intersect("__a", "__b")).cast("long").alias("shared")).where(F.col("shared") >= least)


def fuzzy_entities(titles: DataFrame, entities: DataFrame, k: int = 5, word: int = 4) -> DataFrame:
    """The k entities most of whose name's words stand in a title, ties by id.

    Pairs with two words or more in common come from overlapping().  Those with one matter only where these are fewer
    than k, and then the smallest ids of a word are enough: k, and as many more as there can be among those already
    found.  So a word that all names hold gives 2 k rows a title, not one for each name.
    """
    left, right = titles.select("title_id", word_set(F.col("title"), word).alias("words")), entities.select("entity_id", word_set(F.col("name"), word).alias("words"))
    many = overlapping(left, right, "title_id", "entity_id", 2).withColumnRenamed("shared", "hits")
    smallest = Window.partitionBy("w").orderBy("entity_id")
    heads = right.select("entity_id", F.explode("words").alias("w")).withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= 2 * k).select("w", "entity_id")
    single = left.select("title_id", F.explode("words").alias("w")).join(heads, "w").select("title_id", "entity_id", F.lit(1).cast("long").alias("hits"))
    hits = many.unionByName(single).groupBy("title_id", "entity_id").agg(F.max("hits").alias("hits"))
    order = Window.partitionBy("title_id").orderBy(F.desc("hits"), "entity_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _segments(name: Column, size: Column, parts: int) -> list[tuple[Column, Column]]:
    """Begin (from 0) and length of each of so many parts of a name of that size, as equal as can be."""
    short = F.floor(size / parts)
    wide = size - short * parts
    return [((F.lit(i) * short + F.greatest(F.lit(0), F.lit(i) - parts + wide)).cast("int"), (short + F.when(F.lit(i) >= parts - wide, 1).otherwise(0)).cast("int")) for i in range(parts)]


def similar_flags(unknown: DataFrame, known: DataFrame, most: int = 3, k: int = 3) -> DataFrame:
    """The k names nearest by edits, within a distance.

    Each known name is cut into most + 1 parts; of a name within ``most`` edits one part stays whole, and moves by no
    more places than there are edits on either side of it.  So parts are joined on equality with the pieces of the
    unknown name that may be theirs, and edits are counted for what meets.  Names shorter than most + 1 have empty
    parts, which meet every name short enough.  Repeated names count once; null ones never.
    """
    parts = most + 1
    flags, names = unknown.where("flag is not null").select("flag").distinct(), known.where("name is not null").select("name").distinct()
    size = F.length("name")
    cut = F.array(*(F.struct(F.lit(i).alias("part"), F.substring(F.col("name"), at + 1, n).alias("piece")) for i, (at, n) in enumerate(_segments(F.col("name"), size, parts))))
    index = names.select("name", size.alias("size"), F.explode(cut).alias("x")).select("name", "size", "x.*")
    probes = []
    for more in range(-most, most + 1):  # the known name is longer by so much
        wanted = F.length("flag") + more
        for i, (at, n) in enumerate(_segments(F.col("flag"), wanted, parts)):
            for shift in range(-most, most + 1):
                if abs(shift) + abs(-more - shift) <= most:
                    begin = at + shift
                    fits = (wanted >= 0) & (begin >= 0) & (begin + n <= F.length("flag"))
                    probes.append(F.when(fits, F.struct(wanted.alias("size"), F.lit(i).alias("part"), F.substring(F.col("flag"), begin + 1, n).alias("piece"))))
    asked = flags.select("flag", F.explode(F.array_distinct(F.array_compact(F.array(*probes)))).alias("x")).select("flag", "x.*")
    met = asked.join(index, ["size", "part", "piece"]).select("flag", "name").distinct().withColumn("distance", F.levenshtein("flag", "name", most))
    order = Window.partitionBy("flag").orderBy("distance", "name")
    return met.where(F.col("distance") >= 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shared_words(questions: DataFrame, practices: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of a question and a best practice with enough words of more than three letters in common."""
    left, right = questions.select("question_id", word_set(F.col("question"), 4).alias("words")), practices.select("practice_id", word_set(F.col("practice"), 4).alias("words"))
    return overlapping(left, right, "question_id", "practice_id", least)


def earlier_answers(answers: DataFrame) -> DataFrame:
    """Answers that a question depends on, if they came before it.  answers: entity_id, position, depends_on."""
    wants = answers.select("entity_id", "position", F.explode("depends_on").alias("needed"))
    had = answers.select("entity_id", F.col("position").alias("needed"), F.col("answer").alias("needed_answer"))
    return wants.where("needed < position").join(had, ["entity_id", "needed"])


def cascade(features: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of a map feature: by its id, else by its name and type, else by a name that only one entity has.

    features: feature_id, ref, name, type; entities: entity_id, name, type.  Each step is a join on equality.
    """
    low = lambda c: F.lower(F.trim(c))
    by_id = entities.select(F.col("entity_id").alias("id1"), F.col("entity_id").cast("string").alias("k1"))
    by_both = entities.groupBy(low("name").alias("k2"), low("type").alias("t2")).agg(F.min("entity_id").alias("id2"))
    by_name = entities.groupBy(low("name").alias("k3")).agg(F.min("entity_id").alias("id3"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = features.join(by_id, F.col("ref") == F.col("k1"), "left").join(by_both, (low(features["name"]) == F.col("k2")) & (low(features["type"]) == F.col("t2")), "left").join(by_name, low(features["name"]) == F.col("k3"), "left")
    return out.select("feature_id", F.coalesce("id1", "id2", "id3").alias("entity_id"), F.when(F.col("id1").isNotNull(), "id").when(F.col("id2").isNotNull(), "name and type").when(F.col("id3").isNotNull(), "name").alias("by"))


def numbered(names: DataFrame, key: str, order: str) -> DataFrame:
    """Unique names: the second of a name gets -2, the third -3."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return names.withColumn("unique_name", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), n)))


def newest_copies(files: DataFrame) -> DataFrame:
    """Of files that differ by their number alone (name-2.txt), the one of the highest number."""
    base = F.regexp_replace("file", r"-\d+(\.[a-z]+)$", "$1")
    n = F.coalesce(F.nullif(F.regexp_extract("file", r"-(\d+)\.[a-z]+$", 1), F.lit("")).try_cast("int"), F.lit(1))
    return files.groupBy(base.alias("canonical")).agg(F.max_by("file", n).alias("file"), F.count("*").alias("n_copies"))


def legacy_answers(docs: DataFrame) -> DataFrame:
    """Rows of older documents: confidence words as numbers, sections in one text.

    docs: entity_id, domain_id, answers (array of structs of question, answer, confidence, sections).
    """
    rows = docs.select("entity_id", "domain_id", F.posexplode("answers").alias("pos", "a"))
    confidence = F.when(F.col("a.confidence") == "high", 0.9).when(F.col("a.confidence") == "medium", 0.6).otherwise(0.3)
    return rows.select("entity_id", "domain_id", "pos", "a.question", "a.answer", confidence.alias("confidence"), F.array_join("a.sections", ", ").alias("section"))


def state_documents(wanted: DataFrame, rulesets: DataFrame, documents: DataFrame) -> DataFrame:
    """An entity's text, or its state's where the ruleset says that the state's code applies."""
    ref = wanted.join(rulesets, ["entity_id", "domain_id"], "left")
    source = F.when(F.coalesce("state_code", F.lit(False)), F.col("state_id")).otherwise(F.col("entity_id"))
    texts = documents.select(F.col("entity_id").alias("source_id"), "domain_id", "text")
    return ref.withColumn("source_id", source).join(texts, ["source_id", "domain_id"], "left").select("entity_id", "domain_id", "source_id", "text")


def rulesets_or_default(pairs: DataFrame, rulesets: DataFrame) -> DataFrame:
    """The ruleset of each pair, or one without sources."""
    return pairs.join(rulesets, ["entity_id", "domain_id"], "left").select("entity_id", "domain_id", F.coalesce("home_page", F.lit("")).alias("home_page"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
