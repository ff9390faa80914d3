"""Lines repeated across one site's documents: find them and cut them from each document.

Documents are read once to hashes of their lines; what is shuffled and kept are line numbers and hashes. Documents with
the same text are collapsed first to clusters, so that a line is counted once a cluster, weighted by the bodies it
stands for; distinct clusters and publication dates are counted beside it, which tells standing lines from republished
articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.session import materialise

# White space as str.split() has it.
_SPACE = r"[\x09-\x0d\x1c-\x20\x85   -     　]+"


def normal_line(line: Column) -> Column:
    """Trimmed, white space runs one space, lower case, each run of digits 0."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))), r"(?U)\d+", "0")


def _counted(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^\p{L}]", ""))


def _lines(body: Column) -> Column:
    """array<struct<line_no, key>> of the lines with enough letters; key is a 96 bit hash of the normal form."""
    numbered = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), normal_line(x).alias("normal")))
    kept = F.filter(numbered, lambda x: _counted(x["normal"]) >= 10)
    return F.transform(kept, lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["normal"]).alias("h"), F.hash(x["normal"]).alias("g")))


def read_lines(documents: DataFrame) -> DataFrame:
    """documents(id, body, date) -> (id, date, body_key, lines): hashes alone, in one pass over the bodies.

    Null bodies are left out; an empty body is a body without lines.
    """
    key = F.struct(F.xxhash64("body").alias("h"), F.hash("body").alias("g"), F.length("body").alias("l"))
    return materialise(documents.where("body is not null").select("id", "date", key.alias("body_key"), _lines(F.col("body")).alias("lines")), "lines")


def line_statistics(lines: DataFrame) -> DataFrame:
    """lines(id, site, date, body_key, lines) -> (site, h, g, n_bodies, n_clusters, n_dates, site_bodies) of every line.

    n_bodies counts bodies, n_clusters distinct ones, n_dates distinct dates, a null one not. Rows without a site don't
    count. A line is counted over clusters, so that copies move once.
    """
    each, counted = _counted_lines(lines)
    dated = each.select("site", "h", "g", F.explode("dates").alias("date")).distinct().groupBy("site", "h", "g").agg(F.count("*").alias("n_dates"))
    on = ["site", "h", "g"]
    return counted.join(dated, on, "left").select(*on, "n_bodies", "n_clusters", F.coalesce("n_dates", F.lit(0)).alias("n_dates"), "site_bodies")


def _counted_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each line of each cluster of equal bodies, lines with their bodies and clusters and the bodies of their site)."""
    bodies = lines.where("site is not null")
    keys = F.array_distinct(F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))
    cluster = bodies.groupBy("site", "body_key").agg(F.count("*").alias("n"), F.collect_set("date").alias("dates"), F.first(keys).alias("keys"))
    each = cluster.select("site", "n", "dates", F.explode("keys").alias("l")).select("site", "n", "dates", "l.h", "l.g")
    counted = each.groupBy("site", "h", "g").agg(F.sum("n").alias("n_bodies"), F.count("*").alias("n_clusters"))
    return each, counted.join(bodies.groupBy("site").agg(F.count("*").alias("site_bodies")), "site")


def placed_lines(documents: DataFrame, sites: DataFrame) -> DataFrame:
    """The lines of documents(id, body, date) with the site of sites(id, site), for documents that have one."""
    return read_lines(documents).join(sites.where("site is not null"), "id")


def standing_lines(lines: DataFrame, min_bodies: int = 4, min_share: float = 0.2) -> DataFrame:
    """(id, line_no) of every standing line of every document of placed_lines, lines numbered from 1 at line feeds.

    A line stands where it occurs in at least min_bodies bodies of its site and in at least min_share of the site's
    non-null bodies.
    """
    each = lines.where("site is not null").select("id", "site", F.inline("lines"))
    standing = _counted_lines(lines)[1].where((F.col("n_bodies") >= min_bodies) & (F.col("n_bodies") >= min_share * F.col("site_bodies")))
    return each.join(standing, ["site", "h", "g"], "left_semi").select("id", "line_no")


def cut_standing_lines(documents: DataFrame, lines: DataFrame, min_bodies: int = 4, min_share: float = 0.2) -> DataFrame:
    """documents with clean_body: body without its standing lines, other lines as they were. Null bodies stay null."""
    cut = standing_lines(lines, min_bodies, min_share).groupBy("id").agg(F.collect_set("line_no").alias("_cut"))
    numbered = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), x["n"]))
    return documents.join(cut, "id", "left").withColumn("clean_body", F.array_join(F.transform(kept, lambda x: x["t"]), "\n")).drop("_cut")
