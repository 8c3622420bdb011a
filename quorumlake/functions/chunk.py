"""Cutting texts into chunks fit for an embedding."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column

from quorumlake.functions.pieces import by_pieces

#: Least and most estimated tokens and most characters of a chunk.
LEAST_TOKENS, MOST_TOKENS, MOST_CHARS = 100, 5000, 12000
#: Fixed values of chunks by section: characters over which a section is cut, of its pieces, and of the shortest chunk kept.
LONG_SECTION, PIECE, SHORT_SECTION = 3000, 1200, 400

_MARKS, _NUMBERS, _SENTENCE = re.compile(r"[§()\[\].,:;]"), re.compile(r"[0-9]+"), re.compile(r"(?<=[.!?])\s+")
_ENDS = (re.compile(r"\.\n\s*\n"), re.compile(r"\.\n"))
_PARAGRAPH, _MARKED = re.compile(r"\n\s*\n"), re.compile(r"(?=(?:§|Section)\s*\d+)", re.IGNORECASE)
_LABEL = re.compile(r"(?:§|Section)\s*(\d+[\w\-]*)", re.IGNORECASE)
_SECTION = re.compile(r"(?=§\s*\d+|Section\s+\d+|Article\s+[IVXLCDM]+)", re.IGNORECASE)


def tokens(text: str) -> int:
    return math.ceil(math.ceil(len(text) / 3) + 0.1 * len(_MARKS.findall(text)) + 0.2 * len(_NUMBERS.findall(text)))


def _parts(text: str, at: str) -> list[str]:
    found = [x for x in text.split(at) if x.strip()]
    return [x if x.endswith(".") or i == len(found) - 1 else x + "." for i, x in enumerate(found)]


def _sections(text: str, most: int) -> list[str]:
    """Paragraphs if all are short, else lines if some are, else parts that begin with a section mark."""
    paragraphs = _parts(text, ".\n\n")
    if len(paragraphs) > 1 and max(map(len, paragraphs)) < most:
        return paragraphs
    lines = _parts(text, ".\n")
    if len(lines) > 1 and min(map(len, lines)) < 0.8 * most:
        return lines
    return [x for x in _SECTION.split(text) if x.strip()]


def _packed(section: str, most: int) -> list[str]:
    """Sentences in as few chunks as their order allows."""
    out, now = [], ""
    for sentence in filter(str.strip, _SENTENCE.split(section)):
        longer = f"{now} {sentence}" if now else sentence
        if now.strip() and (len(longer) > most or tokens(longer) > MOST_TOKENS):
            out.append(now.strip())
            longer = sentence
        now = longer
    return [*out, now.strip()] if now.strip() else out


def chunks_of(text: str | None, most: int) -> list[str]:
    """Sections, large ones packed from sentences, small ones joined to the chunk before; oversized ones go."""
    out: list[str] = []
    for section in _sections(text or "", most):
        small = len(section) <= most and tokens(section) <= MOST_TOKENS
        for chunk in [section.strip()] if small else _packed(section, most):
            if out and tokens(chunk) < LEAST_TOKENS:
                out[-1] += " " + chunk
            else:
                out.append(chunk)
    return [c for c in out if tokens(c) <= MOST_TOKENS and len(c) <= MOST_CHARS]


def chunks(text: Column, most: int = 2000) -> Column:
    """H12 as a column: an array of chunks, made in Arrow batches, as each depends on the ones before it."""
    return by_pieces("array<string>", pa.list_(pa.string()), lambda texts: [chunks_of(t, most) for t in texts])(text)


def _statute_parts(text: str) -> list[str]:
    """Parts that end in a stop and a blank line, else in a stop and a line's end, else paragraphs, else marked sections."""
    for end in _ENDS:
        found = [x for x in end.split(text) if x.strip()]
        if len(found) > 1:
            return [*(x if x.endswith(".") else x + "." for x in found[:-1]), found[-1]]
    found = _PARAGRAPH.split(text)
    return found if len(found) > 1 else _MARKED.split(text)


def _pieces(section: str) -> list[str]:
    """A long section by sentences: a piece is closed by the sentence that would make it longer than PIECE."""
    sentences = _SENTENCE.split(section)
    out, first, size = [], 0, len(sentences[0])
    for i, sentence in enumerate(sentences[1:], 1):
        if size and size + len(sentence) > PIECE:
            out.append(" ".join(sentences[first:i]).strip())
            first, size = i, len(sentence)
        else:
            size += len(sentence) + (size > 0)
    return [x for x in (*out, " ".join(sentences[first:]).strip()) if x]


def section_chunks_of(text: str | None) -> list[dict[str, object]]:
    """Chunks of some length, with their place among all parts and the number of the section that they name first."""
    parts = [p for x in _statute_parts(text or "") for p in ([x] if len(x) <= LONG_SECTION else _pieces(x))]
    kept = [(i, x.strip()) for i, x in enumerate(parts) if len(x.strip()) > SHORT_SECTION]
    return [{"chunk_index": i, "content": x, "section": m[1] if (m := _LABEL.search(x)) else None} for i, x in kept]


def section_chunks(text: Column) -> Column:
    """H13 as a column: an array of chunk_index, content and section."""
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("content", pa.string()), ("section", pa.string())]))
    return by_pieces("array<struct<chunk_index:int,content:string,section:string>>", kind, lambda texts: [section_chunks_of(t) for t in texts])(text)
