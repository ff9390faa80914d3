"""The library: records from drafts, slugs, listing, integrity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.operators.ingest import visible_text
from paperweir.schemas import CITATION, GENERATED_BY, MODES


def distinct_records(records: DataFrame) -> DataFrame:
    """Rows repeated in full once; records with the same id otherwise stay and are found by the checks."""
    return records.distinct()


def stored_text(path: Column, content: Column, text_hash: Column, media: str = "text/markdown") -> Column:
    return F.struct(path.alias("path"), F.lit(media).alias("mediaType"), T.versioned_sha256(content).alias("contentHash"), text_hash.alias("textHash"), T.byte_length(content).alias("byteLength"))


def source_records(drafts: DataFrame, captured_at: str) -> DataFrame:
    """Accepted drafts -> source records with their content beside them. Ids depend on the content alone."""
    good = drafts.where("rejected is null")
    sid = T.content_id("src", F.col("kind"), F.col("locator"), F.col("contentHash"))
    raw_path = F.concat_ws("/", F.lit("sources"), F.col("id"), F.lit("raw"), T.raw_capture_name(F.col("rawMediaType")))
    raw = F.when(F.col("rawContent").isNotNull(), F.struct(raw_path.alias("path"), F.col("rawMediaType").alias("mediaType"), T.versioned_sha256(F.col("rawContent")).alias("contentHash"), T.byte_length(F.col("rawContent")).alias("byteLength")))
    return good.withColumn("id", sid).select(
        F.lit(1).alias("schemaVersion"), "id", "kind", "title", "description", F.when(F.trim("author") != "", F.array("author")).alias("authors"), F.lit(None).cast("string").alias("language"), "publishedAt",
        F.lit(captured_at).alias("capturedAt"), F.struct(F.col("locator"), F.col("canonicalUrl")).alias("origin"), stored_text(T.source_content_path(F.col("id")), F.col("content"), F.col("textHash")).alias("content"),
        raw.alias("rawCapture"), F.struct(F.col("adapter")).alias("capture"), F.col("content").alias("contentText"),
    )


def archive_records(sources: DataFrame, created_at: str) -> DataFrame:
    """Source records -> archive articles, one each, slugs not yet chosen apart."""
    aid = T.content_id("art", F.col("id"), F.lit("archive"))
    return sources.withColumn("aid", aid).select(
        F.lit(1).alias("schemaVersion"), F.col("aid").alias("id"), F.lit("archive").alias("mode"), "title", T.slugify(F.col("title")).alias("slug"), "description", "authors", "language",
        F.array("id").alias("sourceIds"), F.struct(T.article_content_path(F.lit("archive"), F.col("aid")).alias("path"), F.col("content.mediaType"), F.col("content.contentHash"), F.col("content.textHash"), F.col("content.byteLength")).alias("body"),
        F.lit(created_at).alias("createdAt"), F.struct(F.col("id").alias("sourceId"), F.col("content.textHash").alias("sourceTextHash")).alias("archiveVerification"),
    )


def generated_records(drafts: DataFrame, created_at: str) -> DataFrame:
    """Accepted drafts (mode, title, slug, description, body, sourceIds, citations, generatedBy) -> article records with the body beside them.

    The id depends on the content, so a draft saved again is the same article; the title is trimmed, sources are named once
    each in order, a null slug is made of the title and not yet chosen apart.
    """
    title = T.trim_all(F.col("title"))
    aid = T.content_id("art", F.col("mode"), title, F.array_join("sourceIds", "\x1f"), F.sha2("body", 256))
    rows = drafts.withColumn("aid", aid)
    body = stored_text(T.article_content_path(F.col("mode"), F.col("aid")), F.col("body"), T.versioned_sha256(visible_text(F.col("body"))))
    # structs by the names of their fields, whichever a draft has
    named = lambda c, kind: (F.from_json(F.to_json(c), kind) if c in drafts.columns else F.lit(None).cast(kind)).alias(c)
    return rows.select(
        F.lit(1).alias("schemaVersion"), F.col("aid").alias("id"), "mode", title.alias("title"), F.coalesce(F.col("slug") if "slug" in drafts.columns else F.lit(None), T.slugify(title)).alias("slug"), (F.col("description") if "description" in drafts.columns else F.lit(None)).cast("string").alias("description"),
        F.array_distinct("sourceIds").alias("sourceIds"), body.alias("body"), named("citations", f"array<{CITATION}>"), F.lit(created_at).alias("createdAt"), F.lit(None).cast("struct<sourceId:string,sourceTextHash:string,verifiedAt:string>").alias("archiveVerification"), named("generatedBy", GENERATED_BY), F.col("body").alias("contentText"),
    )


def _free_slugs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slugs of one stem in the order of saving; the smallest free suffix from 2 on."""
    taken: set[str] = set()
    next_free: dict[str, int] = {}
    out = []
    for base in pdf.sort_values(["createdAt", "id"])["base"]:
        slug, n = base, next_free.get(base, 2)
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        next_free[base] = n
        taken.add(slug)
        out.append(slug)
    return pdf.sort_values(["createdAt", "id"]).assign(slug=out)[["id", "slug"]]


def choose_slugs(articles: DataFrame) -> DataFrame:
    """articles(id, base, createdAt) -> (id, slug): a taken base gets the smallest free suffix, in order of saving.

    Where no base looks like another one with a number, the suffix is the place among equal bases: a window with its
    partial sort by (base, createdAt), no Python. Only stems where bases interact (x and x-2) are resolved one by one, by
    one task a stem, since each choice depends on all before; a title that very many articles share makes that task long.
    """
    from pyspark.sql import Window

    stem = F.regexp_replace("base", r"(?:-[0-9]+)+$", "")
    keyed = articles.select("id", "base", "createdAt", stem.alias("stem"))
    mixed = keyed.groupBy("stem").agg((F.count_distinct("base") > 1).alias("mixed"))
    marked = keyed.join(mixed, "stem")
    n = F.row_number().over(Window.partitionBy("base").orderBy("createdAt", "id"))
    plain = marked.where(~F.col("mixed")).select("id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("slug"))
    hard = marked.where("mixed").groupBy("stem").applyInPandas(lambda pdf: _free_slugs(pdf), "id string, slug string")
    return plain.unionByName(hard)


def list_articles(articles: DataFrame, limit: int = 20) -> DataFrame:
    """The newest articles, 1 to 50: createdAt descending as text, then mode in library order, then id."""
    a = articles.select("id", "mode", "title", "slug", "createdAt").distinct()
    rank = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode"))
    return a.orderBy(F.col("createdAt").desc_nulls_last(), rank, F.col("id")).limit(max(1, min(50, limit)))


def list_line(a: DataFrame) -> DataFrame:
    """One text row an article: id, mode padded, title."""
    return a.select("id", F.concat_ws("  ", F.col("id"), F.rpad("mode", 9, " "), F.col("title")).alias("line"))


def articles_with_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, pos, source_id, ...): each article's sources in order; ids without a source have found = false."""
    ids = articles.select(F.col("id").alias("article_id"), F.posexplode("sourceIds").alias("pos", "source_id"))
    s = sources.select(F.col("id").alias("source_id"), "title", F.col("origin.canonicalUrl").alias("canonicalUrl"), F.col("origin.locator").alias("locator"), "authors", "publishedAt").withColumn("found", F.lit(True))
    return ids.join(s, "source_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def source_facts(joined: DataFrame) -> DataFrame:
    """Per article, in source order without repeats: authors, published dates, URLs, the first URL."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "authors", "publishedAt", "canonicalUrl")))
    g = joined.groupBy("article_id").agg(rows.alias("r"))
    some = lambda c: F.array_distinct(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull() & (x != "")))
    return g.select(
        "article_id", F.array_distinct(F.flatten(F.filter(F.col("r.authors"), lambda x: x.isNotNull()))).alias("authors"), some("publishedAt").alias("published"),
        F.filter(F.col("r.canonicalUrl"), lambda x: x.isNotNull() & (x != "")).alias("urls"), F.try_element_at(F.filter(F.col("r.canonicalUrl"), lambda x: x.isNotNull() & (x != "")), F.lit(1)).alias("canonicalUrl"),
    )


def archive_fidelity(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, source_id, reason) of archives whose text hash, verification or source disagree; reason null where all hold."""
    a = articles.where("mode = 'archive'").select(F.col("id").alias("article_id"), F.col("sourceIds")[0].alias("source_id"), F.col("body.textHash").alias("body_hash"), F.col("archiveVerification.sourceId").alias("v_id"), F.col("archiveVerification.sourceTextHash").alias("v_hash"))
    s = sources.select(F.col("id").alias("source_id"), F.col("content.textHash").alias("source_hash")).distinct()
    reason = (
        F.when(F.col("source_hash").isNull(), "unknown source")
        .when(~F.col("v_id").eqNullSafe(F.col("source_id")), "verification names another source")
        .when(~F.col("v_hash").eqNullSafe(F.col("source_hash")) | ~F.col("body_hash").eqNullSafe(F.col("source_hash")), "text hash mismatch")
    )
    return a.join(s, "source_id", "left").select("article_id", "source_id", reason.alias("reason"))


def stored_text_integrity(stored: DataFrame) -> DataFrame:
    """stored(id, content, stored struct) -> (id, reason): the first of content hash, text hash and byte length that differs, null where none."""
    s = F.col("stored")
    reason = (
        F.when(~T.versioned_sha256(F.col("content")).eqNullSafe(s["contentHash"]), "content hash mismatch")
        .when(~T.versioned_sha256(visible_text(F.col("content"))).eqNullSafe(s["textHash"]), "text hash mismatch")
        .when(~T.byte_length(F.col("content")).eqNullSafe(s["byteLength"]), "byte length mismatch")
    )
    return stored.select("id", reason.alias("reason"))


def fidelity_status(articles: DataFrame, rendered: DataFrame, key: str = "slug") -> DataFrame:
    """articles(key, expected) and rendered(key, text) -> (key, status, reason, characters): skip without a hash, fail without a page or match.

    One row a row of articles; key names one article each, the slug only where slugs are unique.
    """
    r = rendered.select(key, T.normalize_text(F.col("text")).alias("t"), F.lit(True).alias("has"))
    j = articles.select(key, "expected").join(r, key, "left")
    status = F.when(F.col("expected").isNull(), "skip").when(F.col("has").isNull(), "fail").when(F.sha2("t", 256) == F.col("expected"), "pass").otherwise("fail")
    reason = F.when(F.col("expected").isNull(), "no source text hash").when(F.col("has").isNull(), "missing page").when(F.sha2("t", 256) != F.col("expected"), "text hash mismatch")
    return j.select(key, status.alias("status"), reason.alias("reason"), F.when(status == "pass", F.length("t")).alias("characters"))
