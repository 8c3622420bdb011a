"""Queries on sections of statutes, their numbers, titles and needles, and clean pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import chunk, html, statutes
from quorumlake.operators import ordinances
from quorumlake.plans.registry import Registry
from quorumlake.sources import tables as t

R = Registry()


@R.add("""SELECT p_partkey, 0 AS chunk_index, 'Section ' || p_size || '-A' || repeat(' word', p_size * 4) || '.' AS content, p_size || '-A' AS section FROM part WHERE 11 + length(p_size::VARCHAR) + p_size * 20 > 400
UNION ALL SELECT p_partkey, 1, 'No label' || repeat(' x', 200), NULL FROM part""", common=False)
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Two sections of each text, of which the first is left out where it is short."""
    size = F.col("p_size")
    told = F.concat(F.lit("Section "), size, F.lit("-A"), F.repeat(F.lit(" word"), size * 4), F.lit(".\n \nNo label"), F.repeat(F.lit(" x"), F.lit(200)), F.lit("\n"))
    return t.spread(t.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.inline(chunk.section_chunks(told)))


@R.add("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Title ' || p_partkey WHEN 1 THEN 'Big ' || p_partkey WHEN 2 THEN 'Small' ELSE repeat('t', 100) END AS title, CASE p_size % 4 WHEN 0 THEN 'Body' WHEN 1 THEN 'Small' || chr(10) || chr(10) || 'Big ' || p_partkey WHEN 2 THEN 'Small' ELSE 'loose' END AS text FROM part""", common=False)
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """Title of the page, of its first main heading, of a lesser one; pages without blocks."""
    n, k = F.col("p_size") % 4, F.col("p_partkey")
    page = F.when(n == 0, F.concat(F.lit("<title>Title "), k, F.lit("</title><script>no()</script><p>Body</p>"))).when(n == 1, F.concat(F.lit("<h2>Small</h2><h1>Big "), k, F.lit("</h1>"))).when(n == 2, "<h2>Small</h2>").otherwise(F.concat(F.lit("<title>"), F.repeat(F.lit("t"), F.lit(120)), F.lit("</title><div>loose</div>")))
    return t.spread(t.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", html.clean_html(page).alias("x")).select("p_partkey", "x.*")


@R.add("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '§ 12-' || p_partkey WHEN 1 THEN 'Ch 7' WHEN 2 THEN '§ ' || p_partkey WHEN 3 THEN '§ 9-1' END AS number, CASE p_size % 5 WHEN 0 THEN 'Noise' WHEN 1 THEN 'Trees' WHEN 2 THEN 'Definitions' WHEN 3 THEN 'Permits' END AS title FROM part""", common=False)
def statute_titles(spark: SparkSession, d: str) -> DataFrame:
    """From a description in two forms, from elements, from a full title, from nothing."""
    n, k = F.col("p_size") % 5, F.col("p_partkey")
    meta = lambda x: F.concat(F.lit('<meta property="og:description" content="'), x, F.lit('">'))
    page = (
        F.when(n == 0, meta(F.concat(F.lit("§12-"), k, F.lit(" [Amended 2001] Noise; loud music."))))
        .when(n == 1, meta(F.lit("Ch 7 Trees; what may be cut.")))
        .when(n == 2, F.concat(meta(F.lit("Welcome")), F.lit('<span class="x titleNumber">&sect; '), k, F.lit('</span> <b class="titleTitle">Article 4 - <i>Definitions</i>.</b>')))
        .when(n == 3, '<div data-full-title="Section 9-1 - Permits.">x</div>')
    )
    return t.spread(t.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", statutes.number_and_title(page).alias("x")).select("p_partkey", "x.*")


@R.add("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'noise ' || p_partkey WHEN 1 THEN 'tree law' WHEN 2 THEN 'town of athens' WHEN 3 THEN NULL WHEN 4 THEN 'athens rules' ELSE 'leash laws' END AS needle FROM part""", common=False)
def title_needles(spark: SparkSession, d: str) -> DataFrame:
    """The part of a title that tells what and not where."""
    n = F.col("p_size") % 6
    title = (
        F.when(n == 0, F.concat(F.lit("Town of Athens, NY | Noise  "), "p_partkey")).when(n == 1, "New York - Tree law").when(n == 2, "Town of Athens,New York - NY").when(n == 3, "abc").when(n == 4, " Athens rules, N.Y.").otherwise("Leash laws,NY")
    )
    return t.table(spark, d, "part").select("p_partkey", statutes.title_needle(title, F.lit("Athens"), F.lit("Town"), F.lit("NY"), ordinances.STATES).alias("needle"))
