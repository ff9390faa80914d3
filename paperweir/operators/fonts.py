"""Font style of a source by a weighted vote over samples of its paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions import text as T

# Font families and words in their names that tell the style.
SANS = r"^(?:sans-serif|ui-sans-serif|system-ui)$|(?:^|[\s-])(?:sans|grotesk|grotesque)(?:[\s-]|$)|^(?:arial|helvetica|inter|roboto|verdana|tahoma|trebuchet ms|segoe ui|calibri|avenir|futura)$"
SERIF = r"^(?:serif|ui-serif)$|(?:^|[\s-])serif(?:[\s-]|$)|^(?:georgia|cambria|charter|garamond|baskerville|palatino|times|times new roman|merriweather|literata|lora)$"


def classify(families: Column) -> Column:
    """sans-serif or serif by the first family in a list that tells, else null."""
    each = F.transform(F.split(families, ","), lambda f: F.lower(F.regexp_replace(F.trim(f), "^['\"]|['\"]$", "")))
    styles = F.transform(F.filter(each, lambda f: f != ""), lambda f: F.when(f.rlike(SANS), "sans-serif").when(f.rlike(SERIF), "serif"))
    return F.try_element_at(F.array_compact(styles), F.lit(1))


def vote(samples: DataFrame) -> DataFrame:
    """samples(id, fontFamily, textLength) -> (id, style): each sample weighs its length, 1000 at most; ties and silence are serif."""
    weight = F.least(F.coalesce("textLength", F.lit(0)), F.lit(1000))
    s = samples.select("id", classify(F.col("fontFamily")).alias("style"), weight.alias("w"))
    g = s.groupBy("id").agg(F.sum(F.when(F.col("style") == "sans-serif", F.col("w")).otherwise(0)).alias("sans"), F.sum(F.when(F.col("style") == "serif", F.col("w")).otherwise(0)).alias("serif"))
    return g.select("id", F.when(F.col("sans") > F.col("serif"), "sans-serif").otherwise("serif").alias("style"))


def paragraphs(html: Column) -> Column:
    """Normalised texts of the paragraphs of cleaned HTML, empty ones left out."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    plain = F.transform(inner, lambda p: T.normalize_text(unescape(F.regexp_replace(p, "<[^>]*>", ""))))
    return F.filter(plain, lambda p: p != "")


def unescape(c: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def top_paragraphs(html: Column, n: int = 12, least: int = 80) -> Column:
    """The n longest paragraphs of at least so many characters, longest first, ties in order."""
    placed = F.filter(F.transform(paragraphs(html), lambda p, i: F.struct((-F.length(p)).alias("l"), i.alias("i"), p.alias("p"))), lambda s: s["l"] <= -least)
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda s: s["p"])


def opening(html: Column) -> Column:
    """The first three paragraphs with text, joined."""
    return F.array_join(F.slice(paragraphs(html), 1, 3), " ")


def repeats_opening(description: Column, html: Column) -> Column:
    """Whether a description only repeats how the article opens."""
    d, o = T.comparison_text(F.coalesce(description, F.lit(""))), T.comparison_text(opening(html))
    return (d != "") & ((o == d) | o.startswith(F.concat(d, F.lit(" "))))


def expected_paragraphs(visible: DataFrame, expected: DataFrame) -> DataFrame:
    """visible(id, text), expected(id, text) -> visible paragraphs of 40 characters or more that hold the first 160 of an expected one.

    The containment is tested within a page only, an equi-join on id; pages without a hit keep all their paragraphs.
    """
    v = visible.where(F.length("text") >= 40)
    e = expected.groupBy("id").agg(F.collect_set(F.substring("text", 1, 160)).alias("prefixes"))
    marked = v.join(e, "id", "left").withColumn("hit", F.coalesce(F.exists("prefixes", lambda p: F.contains(F.col("text"), p)), F.lit(False)))
    any_hit = marked.groupBy("id").agg(F.bool_or("hit").alias("any"))
    return marked.join(any_hit, "id").where(F.col("hit") | ~F.col("any")).select("id", "text")


# Where paragraphs are taken from when none holds an expected beginning, the narrowest first.
SCOPES = ("article p", '[role="article"] p', "main p", '[role="main"] p', "body p")


def rendered_samples(paragraphs: DataFrame, expected: DataFrame, most: int = 20) -> DataFrame:
    """paragraphs(id, text, fontFamily, scopes array<string>), expected(id, text) -> (id, fontFamily, textLength): the samples of a page.

    Paragraphs of 40 characters or more that hold the first 160 of an expected one; where a page has none, those in the
    first scope that has any. The longest ones count, most a page.
    """
    v = paragraphs.where(F.length("text") >= 40)
    e = expected.groupBy("id").agg(F.collect_set(F.substring("text", 1, 160)).alias("prefixes"))
    hit = F.coalesce(F.exists("prefixes", lambda p: F.contains(F.col("text"), p)), F.lit(False))
    # the rank of a paragraph: 0 where it is expected, else the place of its narrowest scope
    places = F.transform(F.array(*map(F.lit, SCOPES)), lambda s, i: F.when(F.array_contains("scopes", s), i + 1))
    ranked = v.join(e, "id", "left").withColumn("rank", F.when(hit, F.lit(0)).otherwise(F.array_min(F.array_compact(places)))).where("rank is not null")
    page = Window.partitionBy("id")
    best = ranked.withColumn("least", F.min("rank").over(page)).where("rank = least")
    length = F.length("text")
    return best.withColumn("k", F.row_number().over(page.orderBy(length.desc(), "text", "fontFamily"))).where(F.col("k") <= most).select("id", "fontFamily", length.alias("textLength"))
