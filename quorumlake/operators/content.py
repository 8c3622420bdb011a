"""Content of crawled pages apart from their templates, sections behind anchors, and the jobs that clean and scan a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import html as pages_html
from quorumlake.functions import urls, zones
from quorumlake.operators import pages

#: What the shape of a selector is worth.
SHAPES = (
    (r"^#moduleContent$", 5),
    (r"^#page$", 4),
    (r"mainContentContainer", 4),
    (r"^#", 2),
    (r"(?i)(^|\s|>)main([.#:>\s]|$)", 8),
    (r"(?i)(^|\s|>)[^>]*\b(content|freeform|entry|page-content|main-content)\b", 4),
    (r"(?i)(^|\s|>)article([.#:>\s]|$)|(^|\s|>)section([.#:>\s]|$)", 2),
    (r"(?i)(^|\s|>)header([.#:>\s]|$)|(^|\s|>)nav([.#:>\s]|$)", -12),
    (r"(?i)breadcrumbs?|breadcrumb|menu|translation|social|footer", -8),
)
#: Fixed value: what a selector of a main block has.
_MAIN = r"(?i)(^|\s|>)main([.#:>\s]|$)|#main\b|freeform-main|#entry\b|#post\b|main-content|page-content|\bcontent\b"
#: Characters a block needs; up to where a title is near its start, and in a main block still in place.
LEAST, FIRST_PASS, NEAR, FAR = 120, 150, 320, 3000
#: Below which likeness to the main page a block is content: the titled one, others, others with a title.
TITLED, OTHER, OTHER_TITLED = 0.9, 0.6, 0.85
#: Stands for the area between two comments.
COMMENTS = "__comment_content_area__"
#: Fixed value: the comments that a content area stands between.
_AREA = r"(?is)<!--\s*/?\s*[\w-]*\s*Content Area Starts?\s*-->(.*?)<!--\s*/?\s*[\w-]*\s*Content Area Ends?\s*-->"


def shape(selector: Column) -> Column:
    return sum((F.when(selector.rlike(p), n).otherwise(0) for p, n in SHAPES), F.lit(0))


def comment_area(html: Column) -> Column:
    """What stands between the comments that mark a content area, null if nothing does."""
    return F.nullif(F.regexp_replace(F.regexp_extract(html, _AREA, 1), r"^\s+|\s+$", ""), F.lit(""))


def _placed(block: Column) -> Column:
    place = block["place"]
    return (place >= 0) & ((place <= NEAR) | (block["selector"].rlike(_MAIN) & (place <= FAR)))


def ranked_selectors(blocks: Column) -> Column:
    """of the blocks of a page (zones.titled_blocks) structs of -score and selector, the best one first."""

    def option(score: Column, selector: Column) -> Column:
        return F.struct((-score).alias("worth"), selector.alias("selector"))

    def scored(x: Column) -> Column:
        base = shape(x["selector"]) + F.greatest(F.lit(0), F.lit(300) - x["place"])
        up, aside = x["up"], x["aside"]
        ok = up.isNotNull() & _placed(up)
        wide = F.when(ok & (up["chars"] >= LEAST), option(base + 3 + shape(up["selector"]) - shape(x["selector"]), up["selector"]))
        beside = F.when(ok & (up["chars"] < LEAST) & (aside["chars"] >= LEAST), option(base + 1 + shape(aside["selector"]), aside["selector"]))
        return F.array(option(base, x["selector"]), wide, beside)

    fit = F.filter(blocks, lambda x: (x["chars"] >= LEAST) & _placed(x))
    return F.array_sort(F.array_compact(F.flatten(F.transform(fit, scored))))


def content_selectors(docs: DataFrame) -> DataFrame:
    """A selector of each page's content (column selector), null if none can be told.

    docs: html, home (the main page of its host, may be null), needle (see statutes.title_needle).  The block that the
    title's needle leads to is taken unless the main page has much the same there and the needle isn't near its start;
    then the first known selector whose block is unlike the main page's.  Without such a block comments may mark one.
    A page is judged with what its row has, so nothing is shuffled.  Null pages have no selector.
    """
    found = docs.withColumn("__met", zones.compared_blocks("home", "html", F.get(ranked_selectors(zones.titled_blocks("html", "needle")), 0)["selector"], "needle"))
    first, met = F.col("__met.first"), F.col("__met.blocks")
    near = lambda place: place.between(0, NEAR)
    long = lambda x, n: (x["home"] >= n) & (x["page"] >= n)
    own = F.get(F.filter(met, lambda x, i: (i == 0) & (x["selector"] == first)), 0)
    others = F.filter(met, lambda x: x["selector"].isin(*zones.CONTENTS))
    first_pass = F.get(F.filter(others, lambda x: long(x, FIRST_PASS) & (x["alike"] < OTHER)), 0)["selector"]
    second_pass = F.get(F.filter(others, lambda x: long(x, LEAST) & near(x["home_place"]) & (x["alike"] < OTHER_TITLED)), 0)["selector"]
    good = own.isNull() | ~long(own, LEAST) | (own["alike"] < TITLED) | near(own["place"])
    marked = F.when(F.coalesce(comment_area(F.col("html")), comment_area(F.col("home"))).isNotNull(), COMMENTS)
    chosen = F.when(F.col("needle").isNull(), None).when(first.isNull(), marked).when(good, first).otherwise(F.coalesce(first_pass, second_pass, first))
    return found.withColumn("selector", chosen).drop("__met")


def block_html(html: Column, selector: Column) -> Column:
    """Source of the content that a selector or COMMENTS names, null if the page lacks it."""
    return F.when(selector == COMMENTS, comment_area(html)).otherwise(zones.block_source(html, selector))


def content_text(html: Column, selector: Column) -> Column:
    """Text of that content, null if there is none."""
    source = block_html(html, selector)
    return F.when(source.isNotNull(), F.nullif(F.regexp_replace(pages_html.html_text(source), r"^\s+|\s+$", ""), F.lit("")))


#: Words of icon fonts, and how a municipality is named.
ICONS = ("arrow_back", "arrow_forward", "chevron_right", "chevron_left", "add_alert", "help_center", "material-icons")
PLACES = (r"(?i)(?:Village|Town|City)\s+of\s+[A-Za-z\s\-]+", r"(?i)[A-Za-z][A-Za-z\s\-]{0,80}\s+(?:Village|Town|City)\b")


def anchored_text(html: Column, anchor: Column) -> Column:
    """Text of the section behind an anchor, else of the page: without icons, and without what stands above a
    municipality's name near the top, if enough follows."""
    section = zones.section_text(html, anchor)
    text = F.regexp_replace(section["text"], "chevron_right", "\n")
    for icon in ICONS:
        text = F.regexp_replace(text, rf"(?i)\b{icon}\b", "")

    def below_name(all_: Column) -> Column:
        rest = []
        for pattern in PLACES:
            name = F.regexp_extract(all_, pattern, 0)
            at = F.when(name != "", F.position(name, all_) - 1)
            tail = F.regexp_replace(F.substring(all_, at + 1, F.length(all_)), r"^\s+|\s+$", "")
            rest.append(F.when((at > 50) & (at <= 1200) & (F.length(tail) > 200), tail))
        return F.coalesce(*rest, all_)

    bare = F.regexp_replace(F.regexp_replace(html, r"(?i)</?\s*(h[1-6]|p|li|div|section|article|br|tr|td|th)\b[^>]*>", "\n"), "<[^>]*>", " ")
    plain = pages_html.once(pages_html.normal_text(pages_html.once(text, below_name)), lambda t: F.when(t == "", pages_html.normal_text(bare)).otherwise(t))
    return F.concat(F.when(section["found"], F.concat(F.lit("[Extracted from anchor #"), anchor, F.lit("]\n\n"))).otherwise(""), plain)


def _prefixes(url: Column, lengths: Column) -> Column:
    """The beginnings of a url, of the given lengths, behind its host: a prefix join is then one on equality."""
    start = F.greatest(F.length(F.regexp_extract(url, "^[^:]+://[^/?#]*", 0)), F.lit(1))
    return F.transform(F.filter(lengths, lambda n: (n >= start) & (n <= F.length(url))), lambda n: F.substring(url, F.lit(1), n))


def _with_lengths(rows: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """rows with the lengths that prefixes have, which are as many as the longest address has characters at most."""
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.length(column))).alias("lengths"))
    return rows.crossJoin(F.broadcast(lengths))  # one row


def _root(url: Column) -> Column:
    return urls.path(url).isin("", "/")


def compact_menu(menu: DataFrame, related: DataFrame) -> DataFrame:
    """Menu links of each entity, folders without related pages as wildcards, and no link that a wildcard covers.

    menu, related: entity_id, url in match form.  A folder becomes a wildcard if a menu link stands below it and no
    related page begins with it; roots stay as they are.
    """
    menu = menu.select("entity_id", "url").distinct()
    plain = menu.where(~F.endswith("url", F.lit("*")) & ~_root(F.col("url")))
    slashes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("url"), F.lit(1))), lambda i: F.when(F.substring(F.col("url"), i, F.lit(1)) == "/", i))
    below = plain.select("entity_id", F.explode(_prefixes(F.col("url"), F.array_compact(slashes))).alias("prefix")).select("entity_id", F.regexp_replace("prefix", "/$", "").alias("url")).distinct()
    used = _with_lengths(related, below, "url").select("entity_id", F.explode(_prefixes(F.col("url"), F.col("lengths"))).alias("url")).distinct()
    made = plain.join(below, ["entity_id", "url"], "left_semi").join(used, ["entity_id", "url"], "left_anti").withColumn("url", F.concat("url", F.lit("*")))
    cards = menu.where(F.endswith("url", F.lit("*"))).union(made).distinct()
    begins = cards.select("entity_id", F.expr("left(url, length(url) - 1)").alias("prefix"))
    covered = _with_lengths(plain, begins, "prefix").withColumn("prefix", F.explode(_prefixes(F.col("url"), F.col("lengths")))).join(begins, ["entity_id", "prefix"], "left_semi").select("entity_id", "url")
    return menu.where(~F.endswith("url", F.lit("*"))).join(covered.distinct(), ["entity_id", "url"], "left_anti").union(cards)


def cleanup(history: DataFrame, menu: DataFrame, hosts: DataFrame) -> DataFrame:
    """Why each record of a crawl's history is removed, the first reason that holds, null if it stays.

    history: entity_id, url, status, position; menu: entity_id, url as compact_menu() gives them; hosts: entity_id, host.
    Unrelated pages become menu links (see moved_links), so later records of the same address go as such.
    """
    rows = history.withColumn("url", urls.match_form(F.col("url"))).withColumn("host", urls.hostname(F.col("url")))
    some = hosts.select("entity_id").distinct().withColumn("has_hosts", F.lit(True))
    rows = rows.join(hosts.select("entity_id", "host", F.lit(True).alias("allowed")).distinct(), ["entity_id", "host"], "left").join(some, "entity_id", "left")
    listed = menu.where(~F.endswith("url", F.lit("*"))).select("entity_id", "url").distinct()
    cards = menu.where(F.endswith("url", F.lit("*"))).select("entity_id", F.expr("left(url, length(url) - 1)").alias("prefix")).distinct()
    addresses = rows.select("entity_id", "url").distinct()
    carded = _with_lengths(addresses.where(~_root(F.col("url"))), cards, "prefix").withColumn("prefix", F.explode(_prefixes(F.col("url"), F.col("lengths")))).join(cards, ["entity_id", "prefix"], "left_semi").select("entity_id", "url")
    in_menu = listed.union(carded).distinct().withColumn("in_menu", F.lit(True))
    first = rows.where("status = 'unrelated'").groupBy("entity_id", "url").agg(F.min("position").alias("moved"))
    rows = rows.join(in_menu, ["entity_id", "url"], "left").join(first, ["entity_id", "url"], "left")
    reason = (
        F.when(F.col("has_hosts") & F.col("allowed").isNull(), "outside allowed hostnames")
        .when(urls.skipped(F.col("url")), "skipped pattern")
        .when(F.col("in_menu") | (F.col("moved") < F.col("position")), "menu link")
        .when(F.col("status") == "unrelated", "unrelated")
    )
    return rows.withColumn("reason", reason).drop("has_hosts", "allowed", "in_menu", "moved", "host")


def moved_links(cleaned: DataFrame) -> DataFrame:
    """Menu links that a cleanup adds."""
    return cleaned.where("reason = 'unrelated'").select("entity_id", "url").distinct()


def scanned(mains: DataFrame, cached: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id, secondary (the page to compare the main page with), menu (links of both, sorted) and selector.

    mains: entity_id, url, html, one row for an entity; cached: url in match form, html, needle; records: entity_id, url
    that the entity has by itself.  The secondary page is the first link of the main page on its host that is neither
    such a record nor skipped.
    """
    own = records.select("entity_id", urls.match_form(F.col("url")).alias("url")).distinct()
    links = pages.links_of(mains.withColumnRenamed("entity_id", "page_id"), place=True).withColumnRenamed("page_id", "entity_id")
    links = links.join(mains.select("entity_id", urls.hostname(F.col("url")).alias("host")), "entity_id").where(urls.hostname(F.col("url")) == F.col("host")).join(own, ["entity_id", "url"], "left_anti")
    second = links.where(~urls.skipped(F.col("url"))).groupBy("entity_id").agg(F.min_by("url", "pos").alias("url"))
    pair = second.join(cached.select("url", "html", "needle"), "url", "left").join(mains.select("entity_id", F.col("html").alias("home")), "entity_id")
    there = pages.links_of(pair.select(F.col("entity_id").alias("page_id"), "url", "html")).select(F.col("page_id").alias("entity_id"), "url")
    menu = links.join(there, ["entity_id", "url"], "left_semi").groupBy("entity_id").agg(F.sort_array(F.collect_set("url")).alias("menu"))
    told = content_selectors(pair).select("entity_id", F.col("url").alias("secondary"), "selector")
    rows = mains.select("entity_id").join(told, "entity_id", "left").join(menu, "entity_id", "left")
    return rows.select("entity_id", "secondary", F.coalesce("menu", F.array().cast("array<string>")).alias("menu"), "selector")


def side_links(docs: DataFrame) -> DataFrame:
    """Links of a page's menus that aren't its main ones.  docs: page_id, url, html; see pages.links_of."""
    return pages.links_of(docs.withColumn("html", zones.side_menus("html")))
