"""Spelling variants: distinct words one edit apart, by a rare-first bigram prefix filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import Scratch, materialise

#: Code points and occurrences from which a string is a word, and how much oftener than a word its form stands.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: One in so many runs loses a code point, chosen by its checksum.
SLIP = 31
#: Bigrams of a word that are joined: an edit touches two of them at most.
RAREST = 3
#: Code points of the pieces that a side with an edit is cut into.
PIECE = 3
#: Code points of a long text that are looked at together, and distinct words that a task counts before it passes them on.
CHUNK, HELD = 1 << 20, 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where no run does."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def slipped(run: str, prefix: int) -> str:
    """The run without one code point if SLIP divides its checksum; prefix: checksum of the id and colon before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the words of all texts and how often they occur.  A task sums what it has read before it passes it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(body.as_py() or ""):
                    for word, n in Counter(_RUN.findall(piece.encode().lower().decode())).items():  # bytes lower A-Z only
                        if len(word) >= LEAST_LENGTH and len(word := slipped(word, prefix)) >= LEAST_LENGTH:
                            seen[word] += n
                if len(seen) >= HELD:
                    yield _counted(seen)
                    seen = Counter()
        if seen:
            yield _counted(seen)

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram among all, rare ones first.  There are as many as pairs of letters at most: 90 squared."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.col("word").substr(i, F.lit(2)))).alias("gram"))
    return {r.gram: i for i, r in enumerate(grams.groupBy("gram").count().orderBy("count", "gram").collect())}


def keys_of(word: str, ranks: dict[str, int]) -> list[set[str]]:
    """Where words one edit from this one look for it: as a word of their length or one longer, and as one shorter.

    Two such words share a bigram among the RAREST of either (order: rank, then place) that the edit has left whole.  So
    its places differ by one at most, counted from the start if the edit is behind it, from the end if before it, and
    the bigram with all text on its other side is equal.  The side that has the edit is cut into pieces of PIECE code
    points, and all but one of these are equal as well.  A key says where the bigram is and what is equal then.
    """
    n, found = len(word), []
    rarest = sorted(range(n - 1), key=lambda i: (ranks[word[i : i + 2]], i))[:RAREST]
    for longer in (0, 1):  # by so much is the word longer than those that it is to meet
        keys = set()
        for p in rarest:
            for side, equal, rest in ((0, word[: p + 2], word[p + 2 :]), (1, word[p:], word[:p])):
                size = len(rest) - longer
                for i in range(0, max(size, 0) + (size == 0), PIECE):
                    keys.add(f"{side} {n - longer} {i} {len(equal)} {equal}{rest[:i]}{rest[min(i + PIECE, size) + longer :]}")
        found.append(keys)
    return found


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, n_a, n_b: every two words that differ by exactly one inserted, deleted or replaced code point, once."""
    ranks = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 10_000):
                part = batch.slice(lo, 10_000)
                key, longer, at = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for role, keys in enumerate(keys_of(word, ranks.value)):
                        key += [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys]
                        longer += [role > 0] * len(keys)
                        at += [i] * len(keys)
                rows = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(longer, pa.bool_()), rows.column(0), rows.column(1)], names=["key", "longer", "word", "n"])

    rows = scratch.keep(words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long"))
    one = rows.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    two = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = one.join(two, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """Groups the spellings of words: of each word the oftenest near word, if that is much oftener, and where that leads.

    docs: doc_id and the text column.  Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased.  A
    run whose checksum with the id SLIP divides loses one code point.  Words are the distinct results of LEAST_LENGTH
    code points or more that occur LEAST_COUNT times or more.  Returns word, n (occurrences), n_near (words that differ
    by one inserted, deleted or replaced code point), form (the near word of largest n, of ties the smallest in
    code-point order, if it occurs FORM_TIMES as often at least; else null), form_n and root (where forms lead to).

    Candidates: bigrams are ordered by how many words hold them, each word is dealt by its three rarest with their
    places, and what meets is verified by edit distance in the join itself.  A form occurs ten times as often as its
    word, so chains are short, and following them doubles the step each round.

    Null texts have no runs; a null doc_id is the empty string before the colon.  Repeated rows count again.  Tables
    without words, empty ones too, give no rows.  Other columns, whatever their names, are not looked at.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(count_words(docs, text))
        pairs = scratch.keep(near_pairs(words, scratch))
        ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_other")).union(pairs.select("b", "a", "n_a"))
        best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("near")))
        near = ways.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        strong = -F.col("best.less") >= FORM_TIMES * F.col("n")
        judged = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
        )
        judged = scratch.keep(judged)
        roots = scratch.keep(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            moved = scratch.keep(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            roots = moved.select("word", "root")
            if moved.where("moved").isEmpty():
                break
        return materialise(judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
