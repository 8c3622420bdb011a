"""Crawled pages: zones of templates, votes of hosts, scores of domains, status and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import urls
from quorumlake.operators.keyword_hits import keyword_hits

#: Selectors of headers and footers, the likeliest first.
HEADERS = ("header", "[role='banner']", "#header", "#site-header", "#masthead", ".site-header", ".header", ".masthead", "#page-header", ".page-header")
FOOTERS = ("footer", "[role='contentinfo']", "#footer", "#site-footer", "#colophon", ".site-footer", ".footer", ".colophon", "#page-footer", ".page-footer")
#: What hits in a page's zones weigh, a general domain's bonus, and from when a page belongs to a domain.
ZONE_WEIGHTS = {"title": 2.0, "headers": 2.5, "url": 0.5, "body": 0.1}
BOARD_WEIGHTS = {"title": 3.0, "headers": 3.5, "url": 1.5, "body": 0.5}
GENERAL_BONUS, MATCH, PRODUCT_MATCH = 0.5, 4.0, 2.0


def _selector_pattern(selector: str) -> str:
    if selector.startswith("["):
        return rf"""(?i)role=["']{selector.split("'")[1]}["']"""
    if selector.startswith("#"):
        return rf"""(?i)\bid=["']{selector[1:]}["']"""
    if selector.startswith("."):
        return rf"""(?i)\bclass=["'](?:[^"']*\s)?{selector[1:]}(?:\s|["'])"""
    return rf"(?i)<{selector}[\s>]"


def zone_selector(html: Column, selectors: Sequence[str]) -> Column:
    """The first selector that the page has, null if none."""
    return F.coalesce(*(F.when(html.rlike(_selector_pattern(s)), F.lit(s)) for s in selectors))


def host_votes(pages: DataFrame) -> DataFrame:
    """How often each host's pages have each selector, and the active one: most votes, two at least, then name.

    pages: url, html.  Votes are summed in the tasks before they are shuffled, so a host of any size is a few rows.
    """
    zones = pages.select(urls.hostname(F.col("url")).alias("host"), F.explode(F.array(F.struct(F.lit("header").alias("zone"), zone_selector(F.col("html"), HEADERS).alias("selector")), F.struct(F.lit("footer").alias("zone"), zone_selector(F.col("html"), FOOTERS).alias("selector")))).alias("z"))
    votes = zones.select("host", "z.*").where("selector is not null").groupBy("host", "zone", "selector").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("host", "zone").orderBy(F.desc("votes"), "selector")
    return votes.withColumn("active", (F.row_number().over(best) == 1) & (F.col("votes") >= 2))


def keyword_tokens(text: Column) -> Column:
    """Words of four characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9-]+"), lambda w: F.length(w) >= 4))


def domain_keywords(domains: DataFrame) -> DataFrame:
    """domain_id, type, keyword from id, name, description and given keywords, each once."""
    text = F.concat_ws(" ", "domain_id", "name", "description", F.array_join("keywords", " "))
    return domains.select("domain_id", "type", F.explode(keyword_tokens(text)).alias("keyword"))


def domain_scores(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Scores of each page in each domain of which it has a keyword, ranked.

    pages: page_id, url, title, headers (one text), body.  All keywords are looked for in one pass over each page (see
    keyword_hits); what is found meets the (domain, keyword) table on the keyword, and nothing else is shuffled.
    """
    low = pages.select("page_id", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("url", "title", "headers")), F.lower(F.substring(F.coalesce("body", F.lit("")), 1, 3000)).alias("body"))
    met = keyword_hits(low, "page_id", list(ZONE_WEIGHTS), keywords).join(keywords, "keyword")
    sums = met.groupBy("page_id", "domain_id", "type").agg(F.count("*").alias("raw"), *(F.count_if(c).alias(f"{c}_hits") for c in ZONE_WEIGHTS))
    match = F.col("raw") + sum((F.col(f"{c}_hits") * w for c, w in ZONE_WEIGHTS.items()), F.lit(0.0))
    scored = sums.withColumn("match", F.round(match, 6)).withColumn("weighted", F.col("match") + F.when(F.col("type") == "general", GENERAL_BONUS).otherwise(0.0))
    order = Window.partitionBy("page_id").orderBy(F.desc("weighted"), F.desc("raw"), "domain_id")
    return scored.withColumn("rank", F.row_number().over(order))


def boards_score(url: Column, title: Column, headers: Column, body: Column, governing_body: str) -> Column:
    """Hits of a governing body's name, if it is a conservation body, by zone."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in governing_body.lower()).split() if w]
    if "conservation" not in governing_body.lower() or not words:
        return F.lit(0.0)
    pattern = F.lit(r"(?i)\b" + r"[\s/-]+".join(words) + r"\b")
    zones = {"title": title, "headers": headers, "url": url, "body": body}
    counts = {c: F.regexp_count(F.coalesce(x, F.lit("")), pattern) for c, x in zones.items()}
    total = sum(counts.values(), F.lit(0))
    return F.when(total > 0, 1 + sum((counts[c] * w for c, w in BOARD_WEIGHTS.items()), F.lit(0.0))).otherwise(0.0)


def page_status(seed: Column, priority: Column, is_index: Column, best: Column, threshold: float = MATCH) -> Column:
    """Related for seeds and priority pages, unrelated without a match, else index or related."""
    return F.when(seed, "related").when(F.coalesce(best, F.lit(0.0)) < threshold, F.when(priority, "related").otherwise("unrelated")).when(is_index, "index").otherwise("related")


def links_of(pages: DataFrame, place: bool = False) -> DataFrame:
    """page_id, url, text of the links of each page: resolved against its address, by match form, the first text.

    pages: page_id, url, html.  With place also pos, where a link first stands.  Plain anchors are found by an expression, so no page leaves the JVM.
    """
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"'#][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("pos", "tag"))
    rows = rows.select("page_id", "base", "pos", F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']([^\"']*)", 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace("tag", "(?s)<[^>]*>", " "), r"\s+", " ")).alias("text"))
    root = F.regexp_extract("base", "^([^:]+://[^/?#]*)", 1)
    full = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href"))).otherwise(F.concat(root, F.lit("/"), F.col("href")))
    rows = rows.select("page_id", "pos", "text", urls.match_form(full).alias("url"))
    first = [F.min("pos").alias("pos")] if place else []
    return rows.groupBy("page_id", "url").agg(F.min_by("text", F.struct(F.col("text") == "", F.col("pos"))).alias("text"), *first)


def link_reason(url: Column, host: Column, hosts: Sequence[str], visited: Column) -> Column:
    """Why a link isn't followed, the first reason that holds, null if it is."""
    own = urls.registrable(urls.hostname(url)).isin(*hosts) | (urls.hostname(url) == host)
    return F.when(visited, "visited").when(urls.skipped(url), "pattern").when(urls.hostname(url) == "", "bad-url").when(~own, "host")
