"""Queries on contents of pages apart from their templates, anchored sections, and cleaning and scanning a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import zones
from quorumlake.operators import content
from quorumlake.plans.registry import Registry
from quorumlake.sources import tables as t

R = Registry()


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return t.spread(t.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("k", F.col("p_partkey").cast("string"))


@R.add("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '#body' WHEN 1 THEN 'main:nth-of-type(1)' WHEN 2 THEN '#story' WHEN 3 THEN '__comment_content_area__' WHEN 4 THEN NULL WHEN 5 THEN '.entry-content' ELSE 'div:nth-of-type(1)' END AS selector,
  CASE p_size % 7 WHEN 3 THEN 'Noise ' || p_partkey || ' is bad' WHEN 4 THEN NULL WHEN 5 THEN rtrim(repeat('other' || p_partkey || ' ', 40)) ELSE rtrim('Noise law ' || p_partkey || ' ' || repeat('text' || p_partkey || ' ', 60)) END AS text FROM part""", common=False)
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by title, by place, beside a heading, by comments, none, unlike the main page, around a section."""
    n = F.col("p_size") % 7
    body = F.concat(F.lit("Noise law "), "k", F.lit(" "), F.repeat(F.concat(F.lit("text"), "k", F.lit(" ")), F.lit(60)))
    same = F.concat(F.repeat(F.lit("menu "), F.lit(80)), F.lit("noise law"))
    top = '<div class="top">' + "town " * 80 + "</div>"
    tag = lambda open_, x, close: F.concat(F.lit(open_), x if not isinstance(x, str) else F.lit(x), F.lit(close))
    page = (
        F.when(n == 0, tag(top + '<div id="body">', body, "</div>"))
        .when(n == 1, tag("<nav>x</nav><main>", body, "</main><footer>y</footer>"))
        .when(n == 2, tag(top + '<div id="crumbs">You are here &gt; Noise law</div><div id="story">', body, "</div>"))
        .when(n == 3, tag("<div>x</div><!-- Center Content Area Starts -->", F.concat(F.lit("<p>Noise "), "k", F.lit(" is bad</p>")), "<!-- Center Content Area Ends -->"))
        .when(n == 4, "<p>nothing</p>")
        .when(n == 5, F.concat(tag('<div id="freeform-main">', same, '</div><div class="entry-content">'), F.repeat(F.concat(F.lit("other"), "k", F.lit(" ")), F.lit(40)), F.lit("</div>")))
        .otherwise(tag('<body><div><section class="text x">', body, "</section></div></body>"))
    )
    home = F.when(n == 5, tag('<div id="freeform-main">', same, '</div><div class="entry-content">' + "first words of all " * 12 + "</div>")).when(n == 0, tag('<div id="body">', "welcome to our town " * 12, "</div>"))
    docs = _parts(spark, d).select("p_partkey", page.alias("html"), home.alias("home"), F.when(n != 4, F.when(n == 3, "quiet").otherwise("noise law")).alias("needle"))
    return content.content_selectors(docs).select("p_partkey", "selector", content.content_text(F.col("html"), F.col("selector")).alias("text"))


@R.add("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'main' WHEN 1 THEN '[role=''main'']' WHEN 2 THEN 'article' END AS selector, 'Top' || chr(10) || chr(10) || p_partkey AS text, 'https://a.org/b' || p_partkey AS link FROM part""", common=False)
def quick_contents(spark: SparkSession, d: str) -> DataFrame:
    """What one page tells of its content; the page without header and footer; links of lesser menus."""
    n, long = F.col("p_size") % 4, F.repeat(F.lit("ab "), F.lit(110))
    article = F.concat(F.lit("<article>"), long, F.lit("</article>"))
    page = F.when(n == 0, F.concat(F.lit("<main>"), long, F.lit("</main>"))).when(n == 1, F.concat(F.lit("<main>short</main><div role='main'>"), long, F.lit("</div>"))).when(n == 2, article).otherwise(F.concat(article, article))
    framed = F.concat(F.lit('<div class="x site-header"><p>head</p></div><h1>Top</h1><p>'), "k", F.lit('</p><footer id="f"><p>foot</p></footer>'))
    menus = F.concat(F.lit('<header><nav><a href="/a">1</a></nav></header><nav id="main-menu"><a href="/c">2</a></nav><nav class="side"><a href="/b'), "k", F.lit('">3</a></nav>'))
    rows = _parts(spark, d).select("p_partkey", zones.quick_selector(page).alias("selector"), content.content_text(F.concat(F.lit("<div id='all'>"), zones.without_zones(framed, F.lit(".site-header"), F.lit("footer")), F.lit("</div>")), F.lit("#all")).alias("text"))
    links = content.side_links(_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("https://a.org/").alias("url"), menus.alias("html")))
    return rows.join(links.select(F.col("page_id").alias("p_partkey"), F.col("url").alias("link")), "p_partkey")


@R.add("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '[Extracted from anchor #s1]' || chr(10) || chr(10) || '§ 12-3 Noise ' || p_partkey || chr(10) || chr(10) || 'A. No horns.'
  WHEN 1 THEN 'Town of Athens' || chr(10) || chr(10) || rtrim(repeat('law ' || p_partkey || ' ', 60)) WHEN 2 THEN 'noise: Loud sound ' || p_partkey || chr(10) || chr(10) || '- one' ELSE 'loose ' || p_partkey END AS text FROM part""", common=False)
def anchored_texts(spark: SparkSession, d: str) -> DataFrame:
    """A section with its list items, a page cut at its town, a definition without icons, a page without blocks."""
    n = F.col("p_size") % 4
    page = (
        F.when(n == 0, F.concat(F.lit('<h4 id="s1" class="contentTitle">§ 12-3 Noise '), "k", F.lit('</h4><div class="litem"><a alt="12-3A">A.</a><p>A. No horns.</p></div><h4 class="contentTitle">§ 12-4 Dogs</h4><div class="litem"><p>Other</p></div>')))
        .when(n == 1, F.concat(F.lit("<p>" + "menu entry " * 8 + "</p><p>Town of Athens</p><p>"), F.repeat(F.concat(F.lit("law "), "k", F.lit(" ")), F.lit(60)), F.lit("</p>")))
        .when(n == 2, F.concat(F.lit('<section class="definition"><dfn class="term">noise</dfn><span class="deftext">Loud sound '), "k", F.lit("</span></section><li>one arrow_back</li><script>x()</script>")))
        .otherwise(F.concat(F.lit("<div>loose "), "k", F.lit("</div>")))
    )
    return _parts(spark, d).select("p_partkey", content.anchored_text(page, F.when(n == 0, "s1").when(n == 1, "nowhere")).alias("text"))


@R.add("""SELECT p_partkey, j AS position, CASE WHEN j = 0 THEN 'outside allowed hostnames' WHEN j = 1 THEN 'skipped pattern' WHEN j IN (2, 3) THEN 'menu link' WHEN j = 4 THEN 'unrelated' WHEN j = 5 THEN 'menu link' WHEN j = 6 THEN NULL END AS reason,
  'https://a.org/,https://a.org/used,https://a.org/used/x,https://a.org/walks*' AS menu FROM part, range(8) AS r(j) WHERE j < 7""", common=False)
def crawl_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Each part as an entity with seven records; walks become a wildcard, used has a related page below it."""
    base = _parts(spark, d).select(F.col("p_partkey").alias("entity_id"))
    menu = base.select("entity_id", F.explode(F.array(*map(F.lit, ("https://a.org/", "https://a.org/walks", "https://a.org/walks/one", "https://a.org/used", "https://a.org/used/x")))).alias("url"))
    told = (("https://b.org/x", "related"), ("https://a.org/calendar", "related"), ("https://a.org/walks/two", "related_"), ("https://a.org/used/x", "error"), ("https://a.org/dull", "unrelated"), ("https://a.org/dull/", "related_"), ("https://a.org/used/y", "related"))
    rows = base.select("entity_id", F.posexplode(F.array(*(F.struct(F.lit(u).alias("url"), F.lit(s).alias("status")) for u, s in told))).alias("position", "x")).select("entity_id", "position", "x.*")
    small = content.compact_menu(menu, rows.where("status = 'related'").select("entity_id", "url"))
    listed = small.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("url")), ",").alias("menu"))
    done = content.cleanup(rows, small, base.select("entity_id", F.lit("a.org").alias("host")))
    return done.join(listed, "entity_id").select(F.col("entity_id").alias("p_partkey"), F.col("position").cast("long").alias("position"), "reason", "menu")


@R.add("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'https://t' || p_partkey || '.org/second' END AS secondary, CASE WHEN p_size % 3 = 1 THEN 'https://t' || p_partkey || '.org/both' ELSE '' END AS menu, CASE WHEN p_size % 3 = 1 THEN '#law' END AS selector FROM part""", common=False)
def crawl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Main pages without own links, with a cached secondary page, and without it in the cache."""
    n, host = F.col("p_size") % 3, F.concat(F.lit("https://t"), "k", F.lit(".org"))
    links = F.when(n == 0, '<a href="https://x.org/a">x</a>').otherwise('<a href="/login">l</a><a href="/own">o</a><a href="/second">s</a><a href="/both">b</a><a href="/alone">c</a>')
    rows = _parts(spark, d).select(F.col("p_partkey").alias("entity_id"), host.alias("url"), links.alias("html"), n.alias("n"))
    html = F.concat(F.lit('<a href="/both">b</a><a href="https://x.org/a">x</a><div>' + "town " * 80 + '</div><div id="law">Noise law '), F.repeat(F.lit("words "), F.lit(40)), F.lit("</div>"))
    cached = rows.where("n = 1").select(F.concat("url", F.lit("/second")).alias("url"), html.alias("html"), F.lit("noise law").alias("needle"))
    done = content.scanned(rows.drop("n"), cached, rows.select("entity_id", F.concat("url", F.lit("/own")).alias("url")))
    return done.select(F.col("entity_id").alias("p_partkey"), "secondary", F.array_join("menu", ",").alias("menu"), "selector")
