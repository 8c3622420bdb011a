"""Rewriting stored texts: what the pages of a host have in common is voted on first, then cut out of each of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import html, text, urls
from quorumlake.operators.pages import host_votes


def _test(selector: str):
    """Whether an element (its name and attributes) is what a selector of a header or footer names."""
    if selector.startswith("["):
        role = selector.split("'")[1]
        return lambda tag, attrs: (attrs.get("role") or "") == role
    if selector.startswith("#"):
        return lambda tag, attrs: attrs.get("id") == selector[1:]
    if selector.startswith("."):
        return lambda tag, attrs: selector[1:] in (attrs.get("class") or "").split()
    return lambda tag, attrs: tag == selector


class _Cut(html._Reader):
    """Reads a page without the elements that selectors name."""

    def __init__(self, selectors: list[str]) -> None:
        super().__init__()
        self.tests = [_test(s) for s in selectors if s]
        self.inside: str | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.inside is not None:
            self.depth += tag == self.inside and tag not in html.VOID
        elif tag not in html.VOID and any(t(tag, dict(attrs)) for t in self.tests):
            self.inside, self.depth = tag, 1
        else:
            super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.inside is None:
            super().handle_endtag(tag)
        elif tag == self.inside:
            self.depth -= 1
            if not self.depth:
                self.inside = None

    def handle_data(self, data: str) -> None:
        if self.inside is None:
            super().handle_data(data)


def text_without(page: str | None, selectors: list[str]) -> str:
    """H20 of a page without the elements that selectors name; one that isn't closed goes to the page's end."""
    reader = _Cut(selectors)
    reader.feed(page or "")
    reader.close()
    flat = lambda parts: re.sub(r"\s+", " ", "".join(parts)).strip()
    blocks = [(t, x) for t, parts in reader.blocks if (x := flat(parts))]
    return "\n\n".join(f"- {x}" if t == "li" else x for t, x in blocks) or flat(reader.every)


def cut_text(page: Column, header: Column, footer: Column) -> Column:
    """The readable text of a page without its header and footer, in Arrow batches."""

    @F.pandas_udf("string")
    def run(page: pd.Series, header: pd.Series, footer: pd.Series) -> pd.Series:
        return pd.Series([text_without(p, [x for x in (h, f) if isinstance(x, str)]) for p, h, f in zip(page, header, footer, strict=True)], dtype=object)

    return run(page, header, footer)


def rewritten(pages: DataFrame, stored: DataFrame, downloaded: Column, converted: Column) -> DataFrame:
    """The new text artifact of each page: without the header and footer of its host's templates.

    pages: page_id, url, html; stored: page_id, body (artifacts as they are).  The first pass votes for selectors by host
    (D18), summed before they are dealt; the second cuts each page by those that its host has voted for, two votes at
    least.  Votes are a row a host and zone, so no page is shuffled but for hosts too many to broadcast.

    Returns page_id, host, header, footer (selectors, null if none), body (H48), old_bytes, new_bytes, changed.  A page
    without html has an empty body; one without an artifact has null old_bytes.
    """
    active = host_votes(pages.select("url", "html")).where("active")
    chosen = active.groupBy("host").agg(*(F.max(F.when(F.col("zone") == z, F.col("selector"))).alias(z) for z in ("header", "footer")))
    rows = pages.select("page_id", "url", "html", urls.hostname(F.col("url")).alias("host")).join(chosen, "host", "left")
    body = text.artifact(F.col("url"), downloaded, converted, cut_text(F.col("html"), F.col("header"), F.col("footer")))
    out = rows.select("page_id", "host", "header", "footer", body.alias("body")).join(stored.select("page_id", F.col("body").alias("old")), "page_id", "left")
    size = lambda c: F.octet_length(F.col(c)).cast("long")
    return out.select("page_id", "host", "header", "footer", "body", size("old").alias("old_bytes"), size("body").alias("new_bytes"), (~F.col("old").eqNullSafe(F.col("body"))).alias("changed"))


def rewrite_report(rows: DataFrame) -> DataFrame:
    """By host: pages, those changed, those cut by a template, and bytes before and after."""
    cut = F.col("header").isNotNull() | F.col("footer").isNotNull()
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if("changed").alias("n_changed"), F.count_if(cut).alias("n_templates"), F.sum(F.coalesce("old_bytes", F.lit(0))).alias("old_bytes"), F.sum("new_bytes").alias("new_bytes"))
