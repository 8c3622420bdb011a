"""Which of many keywords stand in a text: by a list of a few, one automaton for all of them, or an index of their grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords up to which they are a list in the plan itself.
LISTED = 64
#: Characters of all keywords up to which they make one automaton that every task gets (some 100 bytes a character).
AUTOMATON = 1 << 20
#: Characters of the grams that more keywords are joined by; shorter keywords go into the automaton, as they are few.
GRAM = 4


def keyword_hits(texts: DataFrame, key: str, columns: Sequence[str], keywords: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """key, keyword and a boolean for each text column: whether the keyword is a part of it; keywords without a hit have no row.

    texts: key (unique) and the columns, as they are to be searched (case counts); keywords: column keyword.  Null texts
    hold nothing; null and empty keywords are no keywords, repeated ones count once.  The size of the keywords is looked
    at first: a table of any length gives the same rows by the other way.
    """
    given = keywords.where(F.length("keyword") > 0).select("keyword")
    first = [r.keyword for r in given.limit(16 * LISTED + 1).collect()]  # all of them, if there are few
    if most and len(first) <= 16 * LISTED and len(set(first)) <= LISTED:
        return by_list(texts, key, columns, sorted(set(first)))
    distinct = given.distinct()
    if (distinct.agg(F.sum(F.length("keyword"))).first()[0] or 0) <= most:
        return by_automaton(texts, key, columns, distinct)
    long_ = F.length("keyword") >= GRAM
    short = distinct.where(~long_)
    hits = by_grams(texts, key, columns, distinct.where(long_))
    return hits.unionByName(by_contains(texts, key, columns, short))


def by_list(texts: DataFrame, key: str, columns: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """keyword_hits() of a few keywords: each text is searched for each of them, without a join or a pass through Python."""
    words = F.array(*map(F.lit, keywords)) if keywords else F.array().cast("array<string>")
    low = [F.coalesce(F.col(c), F.lit("")) for c in columns]

    def found(w: Column) -> Column:
        hits = [F.contains(c, w) for c in low]
        return F.struct(w.alias("keyword"), *(h.alias(f"_{i}") for i, h in enumerate(hits)))

    some = F.filter(F.transform(words, found), lambda x: reduce(lambda a, b: a | b, [x[f"_{i}"] for i in range(len(columns))]))
    rows = texts.select(key, F.explode(some).alias("__x"))
    return rows.select(key, F.col("__x.keyword").alias("keyword"), *(F.col(f"__x._{i}").alias(c) for i, c in enumerate(columns)))


def by_automaton(texts: DataFrame, key: str, columns: Sequence[str], keywords: DataFrame) -> DataFrame:
    """keyword_hits() in one pass over each text, whatever the number of keywords; they are collected, so see their size first."""
    words = sorted(r.keyword for r in keywords.select("keyword").collect())
    shared = texts.sparkSession.sparkContext.broadcast(words)
    rows = texts.select(key, *(F.col(c).cast("string").alias(c) for c in columns))
    schema = T.StructType([rows.schema[key], T.StructField("keyword", T.StringType()), *(T.StructField(c, T.BooleanType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            automaton.add_word(w, i)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            at, word, where = [], [], []
            for i in range(len(batch) if shared.value else 0):
                seen: dict[int, int] = {}
                for c in range(len(columns)):
                    for _, w in automaton.iter(batch.column(c + 1)[i].as_py() or ""):
                        seen[w] = seen.get(w, 0) | 1 << c
                at += [i] * len(seen)
                word += [shared.value[w] for w in seen]
                where += seen.values()
            flags = [pa.array([bool(x >> c & 1) for x in where], pa.bool_()) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(word, pa.string()), *flags], names=schema.names)

    return rows.mapInArrow(run, schema)


def by_grams(texts: DataFrame, key: str, columns: Sequence[str], keywords: DataFrame) -> DataFrame:
    """keyword_hits() by joins: each keyword stands under its rarest gram, texts are dealt by their distinct grams, and what
    meets is looked at again.  Keywords have GRAM characters at least."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM))))
    own = keywords.select("keyword", F.explode(grams(F.col("keyword"))).alias("gram"))
    counts = own.groupBy("gram").agg(F.count("*").alias("n"))
    index = own.join(counts, "gram").groupBy("keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    every = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    found = texts.select(key, F.explode(grams(every)).alias("gram")).join(index, "gram").select(key, "keyword").distinct()
    flags = [F.coalesce(F.contains(F.col(c), F.col("keyword")), F.lit(False)).alias(c) for c in columns]
    return found.join(texts.select(key, *columns), key).select(key, "keyword", *flags).where(F.greatest(*(F.col(c).cast("int") for c in columns)) > 0)


def by_contains(texts: DataFrame, key: str, columns: Sequence[str], keywords: DataFrame) -> DataFrame:
    """keyword_hits() of keywords shorter than a gram: their parts of texts of the same lengths are joined on equality."""
    lengths = range(1, GRAM)
    every = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(every) - n + 1, F.lit(1))), lambda i: F.substring(every, i, F.lit(n)))
    found = texts.select(key, F.explode(F.array_distinct(F.concat(*(parts(n) for n in lengths)))).alias("keyword")).join(keywords, "keyword")
    flags = [F.coalesce(F.contains(F.col(c), F.col("keyword")), F.lit(False)).alias(c) for c in columns]
    return found.join(texts.select(key, *columns), key).select(key, "keyword", *flags).where(F.greatest(*(F.col(c).cast("int") for c in columns)) > 0)
