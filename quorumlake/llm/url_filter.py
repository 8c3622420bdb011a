"""URL filters: rules on hosts and paths, and components of redirects that carry blocks to aliases.

DataFrame functions only: no Python code runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import connected_components, materialise

#: (verdict, host, path) of each rule; a rule fits its host and all subdomains and paths that begin with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule and verdict: the longest rule (host and path together) that fits, null if none does."""
    table = F.array(*(F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit("." + h).alias("below"), F.lit(p).alias("path")) for v, h, p in rules))
    return F.array_max(F.filter(table, lambda r: ((host == r["host"]) | host.endswith(r["below"])) & path.startswith(r["path"])))


def resource(url: Column) -> Column:
    """The address without its fragment, host lower-cased: what two urls must share to be one resource."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.when(bare.contains("://"), F.concat(F.regexp_extract(bare, r"(?s)^(.*?://)", 1), host_of(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)))


def _absolute(target: Column, url: Column, scheme: Column, root: Column, folder: Column) -> Column:
    """A link target seen from a page: absolute, without a scheme, from the root, a query alone, or relative."""
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # mailto: and the like are no pages
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_replace(url, r"(?s)[?#].*$", ""), target))
        .otherwise(F.concat(root, folder, target))
    )


def _straight(url: Column) -> Column:
    """The address with . and .. in its path resolved; .. above the root is dropped."""
    head, tail = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    parts = F.split(F.concat(path_of(url), F.when(path_of(url).rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(x)))
    walked = F.concat(head, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), tail)
    return F.when(url.contains("/."), walked).otherwise(url)


def _given(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions read as it is; withColumn() would let Spark copy its expression into each."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges a, b between resources that a page's canonical link or redirect (meta refresh) declares equivalent."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*(?:[\"'][^\"'>]*\b)?canonical\b[^>]*>"), F.lit(0)), F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0)))
    found = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(tags).alias("tag"))
    href = F.nullif(F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.lit(""))
    after = F.nullif(F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*'?\"?([^\"'\s>]+)", 1), F.lit(""))
    found = _given(found, "target", F.replace(F.coalesce(href, after), F.lit("&amp;"), F.lit("&")))
    found = _given(found, "scheme", F.regexp_extract("url", r"(?s)^(.*?:)//", 1))
    found = _given(found, "root", F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1))
    found = _given(found, "folder", F.coalesce(F.nullif(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    found = _given(found, "to", _absolute(*(F.col(c) for c in ("target", "url", "scheme", "root", "folder"))))
    found = _given(found, "straight", _straight(F.col("to")))
    return found.select(resource(F.col("url")).alias("a"), resource(F.col("straight")).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts on pages: their own rule's, else their aliases'.

    pages: page_id, url, html.  redirects: further edges, columns from_url and to_url (of a crawler's log, say).
    Returns page_id, host, path, rule, verdict, a row for each row of pages.

    Resources that redirects or canonical links join are aliases, over any number of steps.  A page without a rule of
    its own is allowed if a rule explicitly allows one of its aliases, else blocked if a rule blocks one, else allowed.
    Targets that aren't pages themselves count as aliases and carry their own rules.

    A null url or one without :// has empty host and path, no rule and no aliases, and is allowed.  A null html has no
    links.  Repeated rows are judged alike.  A resource that a third of all pages point to is a star, whose rows are
    reduced to minima before they are shuffled.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages.select(F.col("url").cast("string"), F.col("html").cast("string")))
    if redirects is not None:
        edges = edges.union(redirects.select(resource(F.col("from_url")).alias("a"), resource(F.col("to_url")).alias("b")).where("a <> b"))
    edges = materialise(edges)
    allowed = F.lit("allow")
    if edges.isEmpty():
        return own.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", allowed).alias("verdict"))
    groups = materialise(connected_components(edges))
    verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    judged = groups.withColumn("v", verdict).groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    spread = groups.join(judged, "component").select("node", F.when(F.coalesce("allowed", F.lit(False)), F.lit("allow")).when(F.coalesce("blocked", F.lit(False)), F.lit("block")).alias("theirs"))
    out = own.withColumn("key", resource(F.col("url"))).join(spread, F.col("key") == F.col("node"), "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "theirs", allowed).alias("verdict"))
