"""Token counts of texts by a public vocabulary, mostly without encoding anything.

Method: a whole-token shortcut.  The vocabulary is examined once a worker: no piece holds the word mark after another
character, so merges never cross the place before a word mark, and no piece holds a line feed, so merges never cross
one either.  A text therefore falls into pre-tokens that can be counted alone.  Those that equal a vocabulary piece and
encode to that one piece are proved offline and count 1; only the others are merged, once each while a bounded memo
holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pre-tokens that a worker remembers besides the proved ones.
MEMO = 500_000
#: Texts whose unknown pre-tokens are merged together.
TEXTS = 100

_counters: dict[str, WholeTokenCounter] = {}


class WholeTokenCounter:
    """Counts tokens as the library does: no begin, end or special tokens, no truncation."""

    def __init__(self, model_file: str, memo: int = MEMO):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces) or self.library.normalize("a  b\n c ") != f"{MARK}a{MARK}{MARK}b\n{MARK}c{MARK}":
            raise ValueError("this vocabulary merges across word marks or line feeds, or rewrites the text; its pre-tokens can't be counted alone")
        words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:]]
        #: Proved: these words encode alone as one token.
        self.whole: dict[str, int] = {w: 1 for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.most = memo
        self.whole[""] = 1  # a mark alone
        self.memo = self.whole.copy()

    def learn(self, words: set[str]) -> None:
        """Merges the pre-tokens that the memo lacks, all in one call of the library.

        A pre-token is a word with a mark before it, or a line feed and what follows it up to a blank; for the latter
        the library's own mark before a text is subtracted.
        """
        new = [w for w in words if w not in self.memo]
        for word, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            self.memo[word] = len(ids) - word.startswith("\n")

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > len(self.whole) + self.most:
            self.memo = self.whole.copy()
        parts = [self._pretokens(t) for t in texts]
        self.learn(set().union(*parts))
        known = self.memo.__getitem__
        return [sum(map(known, p)) for p in parts]

    @staticmethod
    def _pretokens(text: str) -> list[str]:
        """Keys of the memo whose counts add up to the text's."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")  # the library makes marks of blanks, so both are the same to it
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        # Runs of blanks belong to the word after them; the library puts one blank before a text.
        found = []
        for i, line in enumerate(text.split("\n")):
            head, *rest = re.findall(" +[^ ]*|^[^ ]*", line) or [""]
            if head.startswith(" ") and i:
                rest, head = [head, *rest], ""
            found.append(("\n" if i else "") + head)
            found += [x[1:] for x in rest]
        return found


def _counter(model_file: str) -> WholeTokenCounter:
    if model_file not in _counters:
        _counters[model_file] = WholeTokenCounter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit; the text column goes.

    Null and empty texts have 0 bytes and 0 tokens.  Rows stay as they are, repeated ones too; a column of the input
    that is named like a new one is replaced.  One narrow pass: no shuffle, and a task holds one Arrow batch.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in (text, *new)]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            texts = batch.column("__text")
            counts = pa.array([n for i in range(0, len(texts), TEXTS) for n in counter.counts([t or "" for t in texts[i : i + TEXTS].to_pylist()])], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes, counts, pc.greater(counts, limit)], names=[*keep, *new])

    return rows.mapInArrow(run, schema)
