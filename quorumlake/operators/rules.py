"""Decisions on documents, rulesets and answers, as chains of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell what kind of answer a question wants, in this order, and the kind.
GUIDANCE = (("penalt|fine|violation", "enforcement"), ("permit|application|approval", "procedure"), ("how many|how much|number|size|diameter|height|distance", "quantity"), ("who|officer|board|department", "responsibility"))


def looks_like_html(content: Column) -> Column:
    """Begins like HTML or has more than three tags."""
    start = F.lower(F.ltrim(F.substring(content, 1, 200)))
    return start.startswith("<!doctype html") | start.startswith("<html") | (F.regexp_count(content, F.lit(r"(?i)</?(?:p|div|span|table|a|br|h[1-6]|ul|li)\b[^>]*>")) > 3)


def is_pdf(first: Column, content_type: Column, url: Column) -> Column:
    """By its first bytes, its declared type or its address."""
    no = F.lit(False)
    return F.coalesce(first.startswith("%PDF-"), no) | F.coalesce(F.lower(content_type).contains("application/pdf"), no) | F.coalesce(F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf"), no)


def statute_state(text_size: Column, has_original: Column, force: Column) -> Column:
    """Whether a statute's files are complete."""
    return F.when(force, "FORCE").when(text_size.isNull() | ~has_original, "MISSING").when(text_size < 200, "SMALL").otherwise("OK")


def update_reason(has_ruleset: Column, old_url: Column, url: Column, force: Column, reload: Column, age_days: Column) -> Column:
    """Why a ruleset is fetched again, null if it isn't."""
    return F.when(~has_ruleset, "no ruleset").when(~old_url.eqNullSafe(url), "url changed").when(force, "forced").when(reload, "reload").when(age_days > 30, "older than 30 days")


def relevance(text: Column, name: Column, kind: Column, others: Sequence[str]) -> Column:
    """Valid if the text names the entity or no other one, else invalid."""
    low, n, k = F.lower(text), F.lower(name), F.lower(kind)
    own = F.contains(low, n) | F.contains(low, F.concat(k, F.lit(" of "), n))
    other = F.lit(False)
    for o in others:
        other = other | F.contains(low, F.lit(o.lower()))
    return F.when(own, "valid").when(other, "invalid").otherwise("valid")


def refresh(n_questions: Column, changed: Column, newer: Column, age_days: Column) -> Column:
    """Whether an analysis is made again: skip without questions, run if they or the document changed, else if old."""
    return F.when(n_questions == 0, "skip").when(changed, "questions").when(newer, "document").when(age_days < 30, "skip").otherwise("stale")


def requeued(answer: Column, score: Column, below: float) -> Column:
    """An answer without a score, below a score, or that says nothing."""
    return F.coalesce(score < below, F.lit(True)) | (F.coalesce(answer, F.lit("")) == "") | answer.startswith("Not specified")


def guidance(question: Column) -> Column:
    """The first kind whose words the question holds."""
    out = F.lit("general")
    for words, kind in reversed(GUIDANCE):
        out = F.when(F.lower(question).rlike(words), F.lit(kind)).otherwise(out)
    return out


def robots_rules(text: Column) -> Column:
    """Paths that a robots file disallows for everyone; "/" alone is left out."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    step = lambda s, x: F.struct(
        F.when(x.rlike("(?i)^user-agent:"), x.rlike(r"(?i)^user-agent:\s*\*\s*$")).otherwise(s["on"]).alias("on"),
        F.when(s["on"] & x.rlike(r"(?i)^disallow:\s*/."), F.concat(s["paths"], F.array(F.regexp_extract(x, r"(?i)^disallow:\s*(\S+)", 1)))).otherwise(s["paths"]).alias("paths"),
    )
    return F.aggregate(lines, F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("paths")), step)["paths"]


def robots_allow(path: Column, rules: Column) -> Column:
    return ~F.exists(rules, lambda r: path.startswith(r))


def enhanced_question(question: Column, rules: Column) -> Column:
    """The question with the terms of each rule that has no conditions or one that the question holds.

    rules: array of structs of conditions and terms, arrays of strings.
    """
    applies = lambda r: (F.size(r["conditions"]) == 0) | F.exists(r["conditions"], lambda c: F.contains(F.lower(question), F.lower(c)))
    terms = F.flatten(F.transform(F.filter(rules, applies), lambda r: r["terms"]))
    return F.concat_ws(" ", question, F.array_join(terms, " "))


def form_parts(text: Column) -> dict[str, Column]:
    """Lines of a form by what they are: fields to fill in, fees, instructions, departments."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pick = lambda pattern: F.filter(lines, lambda x: x.rlike(pattern))
    return {"fields": pick("_{3,}|:\\s*$"), "fees": pick(r"(?i)\$\s*\d|\bfee\b"), "instructions": pick(r"(?i)\b(must|shall|submit|attach|please)\b"), "departments": pick(r"(?i)\b(department|board|office|clerk)\b")}


def model_json(text: Column, schema: str) -> Column:
    """What a model answered, without the fences around it; null where it doesn't fit the schema."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema)


def prompt(kind: Column, entity: Column, question: Column, chunks: Column) -> Column:
    """The request for one question."""
    label = F.when(kind == "policy", "policy").otherwise("statute")
    return F.concat(F.lit("Answer from the "), label, F.lit(" of "), entity, F.lit(".\nQuestion: "), question, F.lit("\nSources:\n"), F.array_join(chunks, "\n---\n"))


def grade_of(cell: Column, codes: dict[str, str]) -> Column:
    """The grade of a cell that begins with a code, the longest first, and then a dash or a blank or its end."""
    out = F.lit(None).cast("string")
    for code, name in sorted(codes.items(), key=lambda x: len(x[0])):
        out = F.when(cell.rlike(rf"^{code}(?:[-\s]|$)"), F.lit(name)).otherwise(out)
    return out


def ignored(df: DataFrame, condition: str | None) -> DataFrame:
    """Rows that a realm's own condition, written in SQL, doesn't leave out."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False))) if condition else df
