"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.llm import abuse, graph, mainbody, mixing, mojibake, names, neardup, residue, sitelines, tokenids
from paperweir.llm.common import sites_of_sources
from paperweir.session import materialise, spread, table


def _site_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The bodies of pages and the lines of those whose source has a site."""
    bodies = table(spark, d, "web_articles").select(F.col("sourceId").alias("id"), "body", "date")
    sites = sites_of_sources(table(spark, d, "sources")).select(F.col("source_id").alias("id"), F.col("host").alias("site"))
    return bodies, sitelines.placed_lines(spread(bodies), sites)


def _linked_names(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "sources").select(F.explode("authors").alias("spelling"))
    bylines = table(spark, d, "web_articles").where("author <> ''").select(F.col("author").alias("spelling"))
    return names.link_names(authors.unionByName(bylines))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs_of_spellings(_linked_names(spark, d))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity and the number of spellings linked to it."""
    linked = _linked_names(spark, d)
    return linked.join(linked.groupBy("entity").agg((F.count("*") - 1).alias("n_links")), "entity").select("spelling", "entity", "n_links")


#: The two collections of near-duplicates: three words in a row at 0.6, three characters in a row at 0.7.
P3_KINDS = {"sourceText": neardup.Shingling("words", 3, 60, 0.6, 3), "title": neardup.Shingling("characters", 3, 20, 0.7, 5)}


def _p3(spark: SparkSession, d: str) -> dict[str, neardup.NearDuplicates]:
    texts = spread(table(spark, d, "web_articles").select(F.col("sourceId").alias("id"), F.col("sourceText").alias("text")))
    titles = table(spark, d, "sources").select("id", F.col("title").alias("text")).where("text is not null").distinct()
    return {k: neardup.near_duplicates(df, P3_KINDS[k]) for k, df in (("sourceText", texts), ("title", titles))}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = [n.pairs().select(F.lit(k).alias("field_name"), "id_a", "id_b") for k, n in _p3(spark, d).items()]
    return found[0].unionByName(found[1])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record that counts, the least id of its group, and the number of other texts its own is linked to."""
    out = []
    for k, n in _p3(spark, d).items():
        least = n.members.groupBy("class").agg(F.min("id").alias("first"))
        group = graph.components(n.members.select(F.col("class").alias("v")), n.links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
        named = group.join(least, F.col("v") == F.col("class")).select("class", "component", "first")
        head = named.groupBy("component").agg(F.min("first").alias("group_id"))
        ends = n.links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
        rows = n.members.join(named.join(head, "component").select("class", "group_id"), "class").join(ends, "class", "left")
        out.append(rows.select(F.lit(k).alias("field_name"), "id", "group_id", F.coalesce("n", F.lit(0)).alias("n_links")))
    return out[0].unionByName(out[1])


#: The views of a page, the fullest first.
P4_VIEWS = ["rawHtml", "readableContentHtml", "cleanedHtml"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "web_articles").select(F.col("sourceId").alias("id"), *P4_VIEWS))
    sites = sites_of_sources(table(spark, d, "sources")).select(F.col("source_id").alias("id"), F.col("host").alias("site"))
    return mainbody.main_blocks(pages, P4_VIEWS, sites).select(F.col("id").alias("source_id"), F.col("view").alias("field_name"), "block_no")


def _p5(spark: SparkSession, d: str) -> mojibake.Repair:
    w = spread(table(spark, d, "web_articles").select("sourceId", "rawHtml", "title"))
    fields = [w.select(F.col("sourceId").alias("id"), F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("rawHtml", "title")]
    return mojibake.Repair(fields[0].unionByName(fields[1]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).found().withColumnRenamed("id", "source_id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled value with the hash and length of its restored text and the number of words read anew."""
    r = _p5(spark, d).restored()
    return r.select(F.col("id").alias("source_id"), "field_name", "n_words", F.length("restored").alias("n_chars"), F.sha2("restored", 256).alias("restored_hash"))


def p5_chains(spark: SparkSession, d: str) -> DataFrame:
    """What was read as what: words and bytes saved by chain of encodings."""
    return _p5(spark, d).garbled.groupBy("chain").agg(F.count("*").alias("n_words"), F.sum("gain").alias("bytes_saved"))


def _p6(spark: SparkSession, d: str) -> residue.Residue:
    return residue.Residue(spread(table(spark, d, "web_articles").select(F.col("sourceId").alias("id"), F.col("sourceText").alias("text"), "body", F.col("cleanedHtml").alias("html"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).found().withColumnRenamed("id", "source_id")


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).templates()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, lines = _site_lines(spark, d)
    return sitelines.standing_lines(lines).select(F.col("id").alias("source_id"), F.col("line_no").cast("int").alias("line_no"))


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    """The standing lines of each site by bodies, with distinct texts and dates: those of one republished article are of one date."""
    _, lines = _site_lines(spark, d)
    s = sitelines.line_statistics(lines).where((F.col("n_bodies") >= 4) & (F.col("n_bodies") >= 0.2 * F.col("site_bodies")))
    return s.groupBy("site").agg(F.count("*").alias("n_lines"), F.sum("n_bodies").alias("n_bodies"), F.sum("n_clusters").alias("n_clusters"), F.sum("n_dates").alias("n_dates"))


def p7_clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    bodies, lines = _site_lines(spark, d)
    clean = sitelines.cut_standing_lines(bodies.where("body is not null").join(lines.select("id"), "id", "left_semi"), lines)
    return clean.select(F.col("id").alias("source_id"), F.sha2("clean_body", 256).alias("clean_hash"), F.length("clean_body").alias("n_chars"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenids.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document decoded from its ids again: its length and hash, null texts as empty ones."""
    back = tokenids.decode_corpus(tokenids.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text"))))
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the sources with a target, with their number of tokens; counted once and kept."""
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text")).join(table(spark, d, "mix_targets").select("source"), "source", "left_semi")
    return materialise(tokenids.count_tokens(documents, carry="source"), "sized")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.report(mixing.mix(_sized(spark, d), targets), targets)


def _p10(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return abuse.score_documents(spread(documents), abuse.train(documents, table(spark, d, "abuse_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).where("abusive").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d)


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_p10(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p5_chains": p5_chains,
    "p6_found": p6_found,
    "p6_templates": p6_templates,
    "p7_found": p7_found,
    "p7_lines": p7_lines,
    "p7_clean_bodies": p7_clean_bodies,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_source_rates": p10_source_rates,
}

_HOST = r"regexp_replace(regexp_extract(lower(trim(origin.canonicalUrl)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^(www|m|amp)\.', '')"
_LINES = rf"""
with src as (select distinct id, nullif({_HOST}, '') as host from sources where id is not null),
docs as (select w."sourceId" as source_id, s.host, w.body, w.date from web_articles w join src s on s.id = w."sourceId" where w.body is not null and s.host is not null),
lines as (select source_id, host, body, date, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select *, string_split(body, chr(10)) as l from docs)),
normal as (select source_id, host, body, date, line_no, line, regexp_replace(lower(trim(regexp_replace(line, '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))), '\p{{Nd}}+', '0', 'g') as n from lines),
counted as (select host, n, count(distinct source_id) as k from normal where length(regexp_replace(n, '[^\p{{L}}]', '', 'g')) >= 10 group by host, n),
total as (select host, count(*) as k from docs group by host),
standing as (select c.host, c.n from counted c join total t using (host) where c.k >= 4 and c.k >= 0.2 * t.k)
"""
SQL = {
    "p7_found": _LINES + "select source_id, cast(line_no as integer) as line_no from normal join standing using (host, n)",
    "p7_lines": _LINES
    + """select host as site, count(*) as n_lines, cast(sum(bodies) as bigint) as n_bodies, cast(sum(clusters) as bigint) as n_clusters, cast(sum(dates) as bigint) as n_dates from
(select host, n, count(distinct source_id) as bodies, count(distinct body) as clusters, count(distinct date) as dates from normal join standing using (host, n) group by host, n) group by host""",
    "p7_clean_bodies": _LINES
    + """select source_id, sha256(coalesce(clean, '')) as clean_hash, cast(length(coalesce(clean, '')) as integer) as n_chars from docs left join
(select source_id, string_agg(line, chr(10) order by line_no) as clean from normal anti join standing using (host, n) group by source_id) using (source_id)""",
    "p8_round_trip": "select doc_id, length(coalesce(text, '')) as n_chars, sha256(coalesce(text, '')) as text_hash from documents",
}
