"""Citations against markers, sources and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions import text as T

MARKER = r"(?i)\[\^(cite_[a-z0-9][a-z0-9_-]{0,63})\](?!:)"
DEFINITION = r"(?i)\[\^cite_[a-z0-9_-]+\]:"


def markers(body: Column) -> Column:
    """Distinct ids of the inline markers of a body, in order; definitions are none. Null bodies have none."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(body, F.lit(MARKER), 1)), F.array().cast("array<string>"))


def citations_of(articles: DataFrame) -> DataFrame:
    """(article_id, n, id, source_id, url, heading, quote, note): one row a citation, numbered from 1 in order."""
    c = articles.select(F.col("id").alias("article_id"), F.posexplode("citations").alias("pos", "c"))
    return c.select(
        "article_id", (F.col("pos") + 1).alias("n"), F.col("c.id").alias("id"), F.col("c.sourceId").alias("source_id"), F.col("c.locator.url").alias("url"), F.col("c.locator.heading").alias("heading"),
        F.col("c.quote").alias("quote"), F.col("c.note").alias("note"),
    )


def marker_audit(bodies: DataFrame, citations: DataFrame) -> DataFrame:
    """bodies(article_id, body), citations(article_id, id) -> (article_id, cite_id, problem), both ways.

    Ids are compared as written. A body that defines footnotes itself has the problem 'defines footnotes' besides.
    """
    inline = bodies.select("article_id", F.explode(markers(F.col("body"))).alias("cite_id"), F.lit(True).alias("in_body"))
    listed = citations.select("article_id", F.col("id").alias("cite_id"), F.lit(True).alias("in_list")).distinct()
    both = inline.join(listed, ["article_id", "cite_id"], "full_outer")
    one = both.where("in_body is null or in_list is null").select("article_id", "cite_id", F.when(F.col("in_body").isNull(), "not in the body").otherwise("unknown citation").alias("problem"))
    defined = bodies.where(F.col("body").rlike(DEFINITION)).select("article_id", F.lit(None).cast("string").alias("cite_id"), F.lit("defines footnotes").alias("problem"))
    return one.unionByName(defined)


def orphan_citations(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, id, source_id, problem): citations of sources that don't exist or are not the article's; repeated ids."""
    c = citations_of(articles).join(articles.select(F.col("id").alias("article_id"), "sourceIds"), "article_id")
    outside = c.where(~F.coalesce(F.array_contains("sourceIds", F.col("source_id")), F.lit(False))).select("article_id", "id", "source_id", F.lit("source outside the article").alias("problem"))
    missing = c.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("article_id", "id", "source_id", F.lit("unknown source").alias("problem"))
    twice = c.groupBy("article_id", "id").agg(F.count("*").alias("k"), F.min("source_id").alias("source_id")).where("k > 1").select("article_id", "id", "source_id", F.lit("duplicate id").alias("problem"))
    return outside.unionByName(missing).unionByName(twice)


def missing_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, source_id) of source ids that no record has."""
    ids = articles.select(F.col("id").alias("article_id"), F.explode("sourceIds").alias("source_id")).distinct()
    return ids.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("article_id", "source_id")


def source_label(title: Column, url: Column, last: Column) -> Column:
    """Title, else canonical URL, else locator (in EPUB the id)."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(url, F.lit("")), last)


def footnote(cite_id: Column, label: Column, url: Column, heading: Column, quote: Column) -> Column:
    """Markdown footnote definition: [^id]: [label](url), heading — “quote”."""
    text = T.escape_markdown(label)
    linked = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))).otherwise(text)
    place = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(", "), T.escape_markdown(heading))).otherwise("")
    said = F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit(" — “"), T.escape_markdown(quote), F.lit("”"))).otherwise("")
    return F.concat(F.lit("[^"), cite_id, F.lit("]: "), linked, place, said)


def list_item(n: Column, cite_id: Column, label: Column, url: Column, heading: Column, quote: Column, xml: bool = False) -> Column:
    """One item of the HTML or EPUB list of sources."""
    esc = T.escape_xml if xml else T.escape_html
    linked = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit('<a href="'), esc(url), F.lit('">'), esc(label), F.lit("</a>"))).otherwise(esc(label))
    place = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(", "), esc(heading))).otherwise("")
    said = F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit("<blockquote>"), esc(quote), F.lit("</blockquote>"))).otherwise("")
    return F.concat(F.lit('<li id="'), esc(cite_id) if xml else cite_id, F.lit('"><span>['), n.cast("string"), F.lit("] "), linked, place, F.lit("</span>"), said, F.lit("</li>"))


def cited(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with their source's label parts; citations of unknown sources are left out (orphan_citations has them)."""
    s = sources.select(F.col("id").alias("source_id"), F.col("title").alias("s_title"), F.col("origin.canonicalUrl").alias("s_url"), F.col("origin.locator").alias("s_locator")).distinct()
    return citations_of(articles).join(s, "source_id")


def footnotes(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, definitions): the footnote lines of each article that cites, in order."""
    c = cited(articles, sources)
    line = footnote(F.col("id"), source_label(F.col("s_title"), F.col("s_url"), F.col("s_locator")), F.col("s_url"), F.col("heading"), F.col("quote"))
    return c.groupBy("article_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("definitions"))


def citation_section(articles: DataFrame, sources: DataFrame, xml: bool = False) -> DataFrame:
    """(article_id, section): the HTML (or EPUB) section of sources of each article that cites."""
    c = cited(articles, sources)
    last = F.col("source_id") if xml else F.col("s_locator")
    item = list_item(F.col("n"), F.col("id"), source_label(F.col("s_title"), F.col("s_url"), last), F.col("s_url"), F.col("heading"), F.col("quote"), xml)
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"]), "")
    kind = ' epub:type="bibliography"' if xml else ""
    return c.groupBy("article_id").agg(F.concat(F.lit(f'<section class="article-citations"{kind}><h2>Sources</h2><ol>'), items, F.lit("</ol></section>")).alias("section"))


def replace_markers(body: Column, citations: Column, xml: bool = False) -> Column:
    """Each marker of a listed citation as a numbered superscript."""
    before, after = ('<sup><a epub:type="noteref" href="#', '">[') if xml else ('<sup class="article-citation"><a href="#', '">[')
    numbered = F.transform(citations, lambda c, i: F.struct(c["id"].alias("id"), (i + 1).cast("string").alias("n")))
    one = lambda acc, c: F.replace(acc, F.concat(F.lit("[^"), c["id"], F.lit("]")), F.concat(F.lit(before), c["id"], F.lit(after), c["n"], F.lit("]</a></sup>")))
    return F.coalesce(F.aggregate(numbered, body, one), body)


def quotes_in_sources(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes(article_id, id, source_id, quote), sources(source_id, text) -> the quotes with found: whether their source holds them, white space aside."""
    j = quotes.join(sources, "source_id", "left")
    return j.select("article_id", "id", "source_id", F.coalesce(F.contains(T.normalize_text(F.col("text")), T.normalize_text(F.col("quote"))), F.lit(False)).alias("found"))
