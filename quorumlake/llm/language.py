"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm import textbatch as tb

#: Code points of an n-gram; a word is framed by one boundary on either side.
GRAM = 3
#: Documents of a language that the filters are learned from, on average: a bounded sample, chosen by a hash.
SAMPLE = 4000
#: N-grams of a language that its filter holds at most, the most frequent first.
VOCABULARY = 50_000
#: An n-gram is in a language's filter if its share there is that part of its largest share in any language.
RELATIVE = 0.5
#: And if the sample holds it that often.
LEAST = 3
#: Slots of the filters, each a bit for every language, and slots an n-gram has.
SLOTS = 1 << 21
PROBES = 3
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased words, the text of each, and which texts have letters at all."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) + 2 for c in codes], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
    ends = np.cumsum(sizes)
    for c, e in zip(codes, ends, strict=True):
        flat[e - 1 - len(c) : e - 1] = c
    letter = _is_letter()[flat]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    has = np.zeros(len(texts), dtype=bool)
    has[text_of[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a boundary after each word,
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    keep[:-1] |= first[1:]  # and one before the first
    flat, text_of, letter = np.where(letter, flat, 0)[keep].astype(np.uint64), text_of[keep], letter[keep]
    if len(flat) < GRAM:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), has
    h = tb.mix(tb.roll(flat + np.uint64(1), GRAM, _BASE))
    inner = letter[1 : len(h) + 1]
    return h[inner], text_of[1 : len(h) + 1][inner], has


@dataclass(frozen=True)
class LanguageFilters:
    """Slots of bits, one bit for each language: one lookup tells all languages that may hold an n-gram."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], slots: int = SLOTS) -> LanguageFilters:
        table = np.zeros((slots, (len(languages) + 7) // 8), dtype=np.uint8)
        fill = []
        for i, h in enumerate(members):
            at = np.unique(np.concatenate(_slots(h, slots)))
            table[at, i // 8] |= np.uint8(1 << i % 8)
            fill.append(len(at) / slots)
        return cls(languages, table, np.array(fill) ** PROBES)

    def votes(self, h: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
        """N-grams of each text in each language, without the false hits that a filter's fill lets expect."""
        found = self.slots[_slots(h, len(self.slots))[0]]
        for at in _slots(h, len(self.slots))[1:]:
            found = found & self.slots[at]
        counts = np.zeros((texts, 8 * self.slots.shape[1]))
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for plane in range(self.slots.shape[1]):
            seen = np.bincount(text_of * 256 + found[:, plane], minlength=texts * 256).reshape(texts, 256)
            counts[:, 8 * plane : 8 * plane + 8] = seen @ bits
        total = np.bincount(text_of, minlength=texts)[:, None]
        return np.maximum(0, (counts[:, : len(self.languages)] - total * self.false_rate) / (1 - self.false_rate))


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((h >> np.uint64(16 * i)) * _BASE >> np.uint64(20)) % np.uint64(slots) for i in range(PROBES)]


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageFilters | None:
    """Learns filters from rows where ``train`` is true and lang isn't null; None if there are none.

    About ``sample`` documents of each language are read, chosen by a hash of the text.  Their n-grams are counted in
    the tasks and summed by Spark; what comes to the driver is VOCABULARY hashes of a language at most.
    """
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            langs = batch.column(1).to_pylist()
            for i in range(0, len(langs), 200):
                h, text_of, _ = ngrams(batch.column(0).slice(i, 200).to_pylist())
                of = np.array([sorted(set(langs)).index(x) for x in langs[i : i + 200]])[text_of]
                for k, name in enumerate(sorted(set(langs))):
                    values, n = np.unique(h[of == k], return_counts=True)
                    by.setdefault(name, Counter()).update(dict(zip(values.tolist(), n.tolist(), strict=True)))
            for name, counts in by.items():
                keys = np.fromiter(counts.keys(), dtype=np.uint64, count=len(counts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), pa.array(tb.signed(keys)), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    counts = counts.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where((F.col("n") >= LEAST) & (F.col("share") >= RELATIVE * F.col("most")))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= VOCABULARY).select("lang", "gram").toArrow()
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    lang_of, gram = np.array(best["lang"].to_pylist(), dtype=object), best["gram"].to_numpy().view(np.uint64)
    return LanguageFilters.build(names, [gram[lang_of == x] for x in names])


def predict(docs: DataFrame, filters: LanguageFilters | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and coverage (n-grams that the language holds) to each row, from the text alone.

    The language with the most n-grams wins, the one with more training documents if two have as many; the score is its
    share of all votes.  A text that is null or has no letter is "und" with score 0, as are all texts without filters.
    The columns of the input stay, but for those named like new ones.  One narrow pass; the filters have a fixed size.
    """
    new = ("lang_pred", "score", "coverage")
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("coverage", "double")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            preds, scores, coverages = [], [], []
            for part in tb.slices(batch.column(at)):
                texts = [part.bytes_of(i).decode() for i in range(len(part))]
                h, text_of, has = ngrams(texts)
                if model is None:
                    preds += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    coverages += [0.0] * len(texts)
                    continue
                votes = model.votes(h, text_of, len(texts))
                best, total = votes.argmax(axis=1), votes.sum(axis=1)
                most = votes[np.arange(len(texts)), best]
                n = np.bincount(text_of, minlength=len(texts))
                preds += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
                scores += np.divide(most, total, out=np.zeros(len(texts)), where=total > 0).tolist()
                coverages += np.minimum(1, np.divide(most, n, out=np.zeros(len(texts)), where=n > 0)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(coverages, pa.float64())], names=[*keep, *new])

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of their id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Languages of all documents by filters learned from those with an id that aren't held out.

    docs: doc_id, text, lang.  Adds held_out, lang_pred, score and coverage.
    """
    filters = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return predict(docs, filters).withColumn("held_out", held_out(F.col("doc_id")))
