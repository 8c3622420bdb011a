"""Document fingerprints by winnowing rolling hashes of character k-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm import textbatch as tb
from quorumlake.llm.shared import partitions

#: Code points of a gram, and grams of a window: texts sharing GRAM + WINDOW - 1 code points share a fingerprint.
GRAM = 16
WINDOW = 48
#: A short text's window is a WINDOWS-th of its grams and LEAST_WINDOW at least, so that it keeps a dozen hashes or two; what
#: a wider window keeps a narrower one keeps too, so a fingerprint is thinned to the wider window before it is compared.
WINDOWS, LEAST_WINDOW = 8, 8
#: Code points of results that are handed over at once.
BLOCK = 1 << 20
#: Ranges of documents for each shuffle partition.
RANGES = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Kept hashes and their places, an array of (hash, place) rows in order of place.

    Of every ``window`` consecutive grams the smallest hash is kept, the rightmost of equals; a text of few grams has a
    window of its own, see WINDOWS.  A text with fewer grams than that is one window, a shorter one than a gram is one
    gram of its own length, an empty one has no fingerprint.  Some ten arrays of 8 bytes a code point are held.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(code):
        return np.zeros((0, 2), dtype=np.uint32)
    gram = min(gram, len(code))
    h = (tb.mix(tb.roll(code + np.uint64(1), gram, _BASE)) >> np.uint64(32)).astype(np.uint64)
    place = np.arange(len(h), dtype=np.uint64)
    return _least(h << np.uint64(32) | (np.uint64(0xFFFFFFFF) - place), window_of(len(h), window))


def window_of(grams: int, window: int = WINDOW) -> int:
    """The window of a text of so many grams."""
    return min(window, max(LEAST_WINDOW, grams // WINDOWS), grams)


def _least(rank: np.ndarray, window: int) -> np.ndarray:
    """(hash, place) of the least of every window of ranks, a rank being a hash and then how far its place is from the end."""
    low = tb.sliding_min(rank, window)
    kept = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return np.stack([kept >> np.uint64(32), np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))], axis=1).astype(np.uint32)


def grams_of(n_chars: int, gram: int = GRAM) -> int:
    return max(n_chars - gram + 1, 1)


def thinned(print_: np.ndarray, grams: int, window: int) -> np.ndarray:
    """What a text of so many grams keeps with a wider window, from what it keeps with its own: the least of a wider window
    is the least of each narrower one in it that has its place."""
    if not len(print_) or window <= window_of(grams):
        return print_
    rank = np.full(grams, np.iinfo(np.uint64).max, dtype=np.uint64)
    place = print_[:, 1].astype(np.uint64)
    rank[print_[:, 1]] = print_[:, 0].astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - place)
    return _least(rank, min(window, grams))


def encoded(print_: np.ndarray) -> str:
    """16 hexadecimal digits for each kept gram: its hash, then its place."""
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Share of kept hashes that two fingerprints have in common (Jaccard, 0 to 1; two empty ones: 1).

    n_a, n_b: code points of the texts.  Both are compared by the wider window of the two, so a short text isn't held
    to be unlike a long one for being kept more densely.
    """
    window = max(window_of(grams_of(n_a)), window_of(grams_of(n_b)))
    a, b = thinned(a, grams_of(n_a), window), thinned(b, grams_of(n_b), window)
    x, y = np.unique(a[:, 0]), np.unique(b[:, 0])
    common = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - common
    return common / total if total else 1.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds fingerprint, an array of structs of hash and place, to each row; nulls count as empty.  No shuffle.

    A column named fingerprint in the input is replaced.  Rows stay as they are, repeated ones too.
    """
    keep = [c for c in docs.columns if c != "fingerprint"]
    at = keep.index(text)
    schema = docs.select(*keep).schema.add("fingerprint", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("place", T.LongType())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t.as_py() or "") for t in batch.column(at)]
            flat = np.concatenate([np.zeros((0, 2), dtype=np.uint32), *found]).astype(np.int64)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], names=["hash", "place"])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), items)], names=[*keep, "fingerprint"])

    return docs.select(*keep).mapInArrow(run, schema)


def with_neighbour(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and how like they and the next document's are.

    docs: doc_id and the text column.  The next document is that of the next smaller doc_id, after the last the first;
    a table of one has itself.  The edited text has its last third (rounded down) replaced by as much of the next
    document's beginning.  Returns doc_id, n_chars, edited (the text), fingerprint and edited_fingerprint (strings),
    near_edited and near_next, a row for each row of docs.

    Null texts count as empty.  A null doc_id comes after all others; rows of one id come in order of their texts.

    Documents are dealt out once, by ranges of doc_id, and read in order, so a task holds two texts.  The first document
    of each range goes to the range before it as well: one row for each range, found by an aggregate over ids alone.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = RANGES * max(2, partitions(spark))
    bounds = sorted({float(b) for b in source.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    # ranges count down as ids do: 0 holds the largest; a null id is in the last
    placed = source.withColumn("part", F.lit(0))
    if bounds:
        found = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="id", outputCol="range", handleInvalid="keep")
        rank = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(len(bounds) - F.col("range").cast("int"))
        placed = found.transform(source.withColumn("id", F.col("doc_id").cast("double"))).select("doc_id", "text", rank.alias("part"))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
    head: list[int | None] = [None] * (len(bounds) + 1)
    before: list[int | None] = [None] * (len(bounds) + 1)
    for i, r in enumerate(heads):
        head[r["part"]], before[r["part"]] = r["head"], heads[i - 1]["part"]
    own_of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("part") + 1)  # noqa: E731  an array that Spark folds to one constant
    lent = F.when(F.col("doc_id").eqNullSafe(own_of(head, "long")), own_of(before, "int"))
    own = placed.withColumn("lent", F.lit(0))
    borrowed = placed.withColumn("to", lent).where("to is not null").select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("lent"))
    rows = own.unionByName(borrowed).repartition(n // RANGES, "part").sortWithinPartitions(F.col("part"), F.col("lent"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, before, lent_in = 0, None, None
        for batch in batches:
            for doc_id, text, part, is_lent in zip(*(batch.column(i) for i in range(4)), strict=True):
                part, is_lent = part.as_py(), is_lent.as_py()
                if is_lent and lent_in == part:
                    continue  # rows of one id: the first of them is the next document
                if is_lent:
                    lent_in = part
                text = text.as_py()
                now = (doc_id.as_py(), text, winnow(text))
                if before is not None:
                    out.append(_judged(before, now))
                    size += len(text)
                before = None if is_lent else now
                if size > BLOCK:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return rows.select("doc_id", "text", "part", "lent").mapInArrow(run, schema)


def _judged(now: tuple, after: tuple) -> tuple:
    doc_id, text, own = now
    third = len(text) // 3
    edited = text[: len(text) - third] + after[1][:third]
    other = winnow(edited)
    return doc_id, len(text), edited, encoded(own), encoded(other), likeness(own, other, len(text), len(edited)), likeness(own, after[2], len(text), len(after[1]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
