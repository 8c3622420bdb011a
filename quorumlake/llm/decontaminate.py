"""Benchmark decontamination: winnowed word-gram fingerprints of both sides are joined and their hits extended."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import textbatch as tb
from quorumlake.llm.shared import bitmap_of, in_bitmap, materialise

#: Words of a window; a shared span of so many is always found.
SPAN = 13
#: Words of a hashed gram.
GRAM = 5
#: Bits of the filters of benchmark fingerprints and of the windows around them that each task gets: a fixed 2 MB each.
FILTER_BITS = 1 << 24
#: A run of places is its first one, times this, plus how many there are.
_RUN = 1 << 31


@dataclass(frozen=True)
class Windows:
    """Windows of some texts: where each starts (its word), its fingerprint, and two hashes of all its words."""

    start: np.ndarray
    print: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def only(self, some: np.ndarray) -> Windows:
        return Windows(self.start[some], self.print[some], self.one[some], self.two[some])


def windows(words: tb.Words, size: int) -> Windows:
    """All windows of ``size`` words with their fingerprints.

    A window of SPAN words has the smallest hash of its grams of GRAM words, the rightmost of equals; so two texts that
    share a window share its fingerprint (the guarantee of winnowing).  Shorter ones have the hash of all their words.
    """
    one, start = tb.grams(words.hash, words.ptr, size)
    two, _ = tb.grams(words.hash, words.ptr, size, salt=1)
    if size < SPAN or not len(one):
        return Windows(start, one, one, two)
    width = SPAN - GRAM + 1
    h, at = tb.grams(words.hash, words.ptr, GRAM)
    # an order that prefers the rightmost of equals; a window lies in one text if its first and last gram do
    rank = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - (np.arange(len(h), dtype=np.uint64) & np.uint64((1 << 24) - 1)))
    low = tb.sliding_min(rank, width)
    first = np.flatnonzero(at[width - 1 :] - at[: len(at) - width + 1] == width - 1)
    pick = first + (((np.uint64((1 << 24) - 1) - (low[first] & np.uint64((1 << 24) - 1))).astype(np.int64) - first) & ((1 << 24) - 1))
    return Windows(start, h[pick], one, two)


def _runs(found: Windows, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows with the text of each: an order that puts those of one text and kind together, where kinds begin in it,
    and where runs of consecutive places do."""
    order = np.lexsort((found.start, found.two, found.one, owner))
    new = lambda x: np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=bool)
    kind = new(owner[order]) | new(found.one[order]) | new(found.two[order])
    start = found.start[order]
    run = kind.copy()
    run[1:] |= start[1:] != start[:-1] + 1
    return order, np.flatnonzero(kind), np.flatnonzero(run)


_HITS = "array<struct<fp:long,size:int,one:long,two:long,runs:array<long>>>"


def _hits(parts: list[tuple[int, Windows]], w: tb.Words, n: int) -> pa.Array:
    """The kinds of windows of each of n texts: fingerprint, size, hashes, and the runs of places where each starts."""
    fields: list[list[np.ndarray]] = [[] for _ in range(5)]
    runs, lengths, owners = [], [], []
    for size, found in parts:
        owner = w.text_of()[found.start]
        order, kinds, begins = _runs(found, owner)
        some = order[kinds]
        ends = np.append(begins[1:], len(order))
        runs.append((found.start[order[begins]] - w.ptr[owner[order[begins]]]) * _RUN + ends - begins)
        lengths.append(np.diff(np.append(np.searchsorted(begins, kinds), len(begins))))
        owners.append(owner[some])
        for column, values in zip(fields, (tb.signed(found.print[some]), np.full(len(some), size), tb.signed(found.one[some]), tb.signed(found.two[some]), np.arange(len(some))), strict=True):
            column.append(values)
    owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    by = np.argsort(owner, kind="stable")
    length = np.concatenate(lengths)[by] if owners else owner
    first = (np.cumsum(np.concatenate(lengths)) - np.concatenate(lengths))[by] if owners else owner
    places = np.concatenate(runs)[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())] if owners else owner
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(places, pa.int64()))
    columns = [pa.array(np.concatenate(f)[by] if f else owner, t) for f, t in zip(fields[:4], (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
    rows = pa.StructArray.from_arrays([*columns, lists], names=["fp", "size", "one", "two", "runs"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[by], np.arange(n + 1)), pa.int32()), rows)


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """cls, size, fp, one, two: the kinds of windows of each distinct benchmark text; a text of fewer than SPAN words is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column(0)):
                w = tb.words(texts, tb.letter_words())
                for i in range(len(texts)):
                    own = w.hash[w.ptr[i] : w.ptr[i + 1]]
                    if not len(own):
                        continue
                    size = min(SPAN, len(own))
                    found = windows(tb.Words(own, np.array([0, len(own)]), own, own), size)
                    order, kinds, _ = _runs(found, np.zeros(len(found.start), dtype=np.int64))
                    some = found.only(order[kinds])
                    cls = np.full(len(kinds), tb.digest64(own.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.full(len(kinds), size), pa.int32()), *(pa.array(tb.signed(x)) for x in (some.print, some.one, some.two))], names=["cls", "size", "fp", "one", "two"])

    return items.mapInArrow(run, "cls long, size int, fp long, one long, two long")


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """What of each document also stands in a benchmark.

    docs: doc_id and the text column; items: item_id and text.  Words are runs of digits, letters a-z (A-Z lower-cased)
    and everything beyond ASCII.  A window is SPAN consecutive words of an item, or all words of a shorter item.
    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with an occurrence),
    item_ids (sorted as strings) and contaminated (n_hit > 0 and 20 n_hit >= n_words), a row for each row of docs.

    Long items: both sides are winnowed with a guarantee of SPAN words, and fingerprints of the documents that a
    fixed-size filter doesn't rule out are extended to the windows that have them.  A kind of window is a row of a
    document or item however often it stands there: its fingerprint, two 64-bit hashes of all its words, and its places
    as runs.  So what is joined, on all three hashes, is linear in the words of either side, of texts of one word or
    phrase over and over too.  Short items: every gram of their lengths is looked up in the same way.  Texts are read once and
    never shuffled.  Equal items are one class until the end, so copies of an item don't multiply hits.

    Null and empty texts have no words.  Rows of one doc_id and text are judged alike; rows of one doc_id and different
    texts are judged apart.  Null ids are ids.  Items without words match nothing.  With empty tables nothing is hit.
    """
    spark = docs.sparkSession
    kinds = materialise(_benchmark_windows(items.select(F.col("text").cast("string"))).distinct())
    bits = spark.sparkContext.broadcast((bitmap_of(kinds.select("fp"), FILTER_BITS), bitmap_of(kinds.select("one"), FILTER_BITS)))
    short = sorted(r[0] for r in kinds.where(F.col("size") < SPAN).select("size").distinct().collect())  # SPAN - 1 numbers at most
    member = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, around = bits.value
        for batch in batches:
            ids = batch.column(0)
            for texts in tb.slices(batch.column(1)):
                w = tb.words(texts, tb.letter_words())
                parts = []
                for size in [*short, SPAN]:
                    found = windows(w, size)
                    hit = np.flatnonzero(in_bitmap(prints, tb.signed(found.print))) if len(found.start) else found.start
                    hit = hit[in_bitmap(around, tb.signed(found.one[hit]))] if len(hit) else hit
                    if len(hit):
                        parts.append((size, found.only(hit)))
                key = pa.array([tb.digest64(texts.bytes_of(i)) for i in range(len(texts))], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(texts.first, len(texts)), key, pa.array(w.counts(), pa.int64()), _hits(parts, w, len(texts))], names=["doc_id", "doc", "n_words", "hits"])

    seen = materialise(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(probe, f"doc_id long, doc long, n_words long, hits {_HITS}"))
    # rows of one id and text have the same hits, so one of them goes on
    hits = seen.where(F.size("hits") > 0).dropDuplicates(["doc_id", "doc"]).select("doc_id", "doc", F.explode("hits").alias("h")).select("doc_id", "doc", "h.*")
    by, on = ["doc_id", "doc"], ["size", "fp", "one", "two"]
    # a popular passage is in many documents: Spark splits that side of the joins
    found = materialise(hits.join(kinds.select(*on).distinct(), on, "left_semi"))
    spans = found.select(*by, "size", F.explode("runs").alias("run")).select(*by, (F.shiftright("run", 31)).cast("int").alias("start"), (F.shiftright("run", 31) + F.col("run").bitwiseAND(_RUN - 1) + F.col("size") - 1).cast("int").alias("stop"))
    # of spans that begin alike the longest counts, so what is gathered a document is bounded by its words
    cover = spans.groupBy(*by, "start").agg(F.max("stop").alias("stop")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to"))
    cover = cover.select(*by, F.aggregate("spans", zero, step)["n"].cast("long").alias("n_hit"))
    classes = member.mapInArrow(_classes, "item_id string, cls long")
    named = found.select(*by, *on).join(kinds, on).select(*by, "cls").distinct().join(classes, "cls").groupBy(*by).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"))
    judged = cover.join(named, [cover["doc_id"].eqNullSafe(named["doc_id"]), cover["doc"] == named["doc"]]).select(cover["doc_id"].alias("d"), cover["doc"].alias("t"), "n_hit", "n_items", "item_ids")
    out = seen.select("doc_id", "doc", "n_words").join(judged, [F.col("doc_id").eqNullSafe(F.col("d")), F.col("doc") == F.col("t")], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in tb.slices(batch.column(1)):
            w = tb.words(texts, tb.letter_words())
            cls = [tb.digest64(w.hash[w.ptr[i] : w.ptr[i + 1]].tobytes()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(cls, pa.int64())], names=["item_id", "cls"])
