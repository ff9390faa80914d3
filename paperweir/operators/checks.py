"""Schema rules and invariants of records as arrays of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.schemas import FORMATS, KINDS, MODES

HASH = "^sha256:[a-f0-9]{64}$"


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule of null values counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def _stored(c: Column) -> Column:
    return c["contentHash"].rlike(HASH) & c["textHash"].rlike(HASH) & T.is_safe_path(c["path"]) & (c["byteLength"] >= 0)


def source_rules() -> dict[str, Column]:
    c = F.col
    return {
        "schemaVersion": c("schemaVersion") == 1,
        "id": T.is_record_id(c("id"), "src"),
        "kind": c("kind").isin(*KINDS),
        "capturedAt": F.try_to_timestamp(c("capturedAt")).isNotNull(),
        "publishedAt": c("publishedAt").isNull() | (F.length("publishedAt") >= 4),
        "locator": F.length("origin.locator") > 0,
        "canonicalUrl": (c("kind") != "url") | c("origin.canonicalUrl").isNotNull(),
        "content": _stored(c("content")) & (c("content.path") == T.source_content_path(c("id"))),
        "authors": c("authors").isNull() | (F.size("authors") == F.size(F.array_distinct("authors"))),
    }


def article_rules() -> dict[str, Column]:
    c = F.col
    archive = c("mode") == "archive"
    n_citations = F.coalesce(F.size("citations"), F.lit(0))
    return {
        "schemaVersion": c("schemaVersion") == 1,
        "id": T.is_record_id(c("id"), "art"),
        "mode": c("mode").isin(*MODES),
        "title": ~T.is_blank(c("title")),
        "slug": T.is_safe_slug(c("slug")),
        "sources": F.size("sourceIds") >= 1,
        "unique sources": F.size("sourceIds") == F.size(F.array_distinct("sourceIds")),
        "body": _stored(c("body")),
        "body path": c("body.path") == T.article_content_path(c("mode"), c("id")),
        "archive": ~archive | (c("archiveVerification").isNotNull() & c("generatedBy").isNull() & (F.size("sourceIds") == 1)),
        "derived": archive | (c("archiveVerification").isNull() & c("generatedBy").isNotNull() & (n_citations >= 1)),
        "citation ids": F.coalesce(F.forall("citations", lambda x: T.is_citation_id(x["id"])), F.lit(True)),
        "unique citations": F.coalesce(F.size(F.array_distinct(F.col("citations.id"))) == n_citations, F.lit(True)),
    }


def export_rules() -> dict[str, Column]:
    c = F.col
    return {
        "schemaVersion": c("schemaVersion") == 1,
        "id": T.is_record_id(c("id"), "exp"),
        "articleId": T.is_record_id(c("articleId"), "art"),
        "format": c("format").isin(*FORMATS),
        "destination": c("destination.type").isNotNull(),
        "artifact": c("artifact").isNull() | (c("artifact.contentHash").rlike(HASH) & T.is_safe_path(c("artifact.path"))),
        "delivered": (c("status") != "delivered") | (c("destination.type") != "kindle") | (c("delivery.confirmedAt").isNotNull() & c("delivery.confirmationMethod").isNotNull() & c("delivery.deliveredAt").isNotNull()),
    }


def check(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, violations) of every record."""
    return records.select("id", violations(rules).alias("violations"))


def accept(records: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their violations)."""
    v = records.withColumn("violations", violations(rules))
    return v.where(F.size("violations") == 0).drop("violations"), v.where(F.size("violations") > 0)


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(id, n) of ids that several differing records have; rows repeated in full count once."""
    return records.select("id", F.xxhash64(*[F.col(c) for c in records.columns]).alias("h")).distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def used_slugs(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of candidates(slug) whose slug an article has."""
    return candidates.join(articles.select("slug"), "slug", "left_semi")
