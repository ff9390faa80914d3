"""The library as one object: ingest, save generated articles, load with verification, export, list, show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.operators import checks, citations, export, ingest, library, vault
from paperweir.schemas import ARTICLE, EXPORT, SOURCE
from paperweir.session import materialise
from paperweir.sources import readers, writers


class Library:
    """Tables sources, articles, exports, contents (id, body) and artifacts (id, artifact) under one folder.

    Articles are partitioned by mode. now is the time that new records carry, so that a run can be repeated with the same
    result. A folder inside a Git working tree is refused unless allow_git.
    """

    SCHEMAS = {"sources": SOURCE, "articles": ARTICLE, "exports": EXPORT, "contents": "id string, body string", "artifacts": "id string, artifact binary"}

    def __init__(self, spark: SparkSession, root: str, now: str, allow_git: bool = False):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        local = self.root.removeprefix("file://")
        if not allow_git and "://" not in local and writers.inside_git_tree(local):
            raise ValueError(f"a library inside a Git working tree: {local}")

    def table(self, name: str) -> DataFrame:
        """A table of the library; one that nothing was saved to is empty."""
        path = f"{self.root}/{name}"
        if not writers.exists(self.spark, path):
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(path)

    def ingest(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """inputs(kind, value, label) -> (archive articles saved, rejected drafts). Content captured before is not captured twice."""
        drafts = materialise(ingest.ingest(inputs), "drafts")
        src = library.source_records(drafts, self.now).dropDuplicates(["id"])
        src = materialise(src.join(self.table("sources").select("id"), "id", "left_anti"), "sources")
        arch = library.archive_records(src, self.now)
        arch = materialise(self._with_free_slugs(arch), "articles")
        writers.append_new(src.drop("contentText"), f"{self.root}/sources")
        writers.append_new(arch, f"{self.root}/articles", "mode")
        own = src.select("id", F.col("contentText").alias("body"))
        body = own.withColumnRenamed("id", "sid").join(arch.select("id", F.col("sourceIds")[0].alias("sid")), "sid").select("id", "body")
        writers.append_new(own.unionByName(body), f"{self.root}/contents")
        return arch, drafts.where("rejected is not null")

    def _with_free_slugs(self, records: DataFrame) -> DataFrame:
        """Records with slugs that no article has: the stored ones count as saved before all others."""
        base = records.select("id", F.col("slug").alias("base"), "createdAt")
        stored = self.table("articles").select("id", F.col("slug").alias("base"), F.lit("").alias("createdAt"))
        return records.drop("slug").join(library.choose_slugs(stored.unionByName(base)), "id")

    def save_generated(self, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """drafts(id, mode, title, body, sourceIds, citations array<struct<id, sourceId, quote>>) -> (articles saved, rejected with reasons).

        A draft needs a title, a source that exists, safe Markdown, and citations that are the body's markers, each once
        and of its own sources; a slug of its own, where it has one, must be safe and not taken. description, slug and
        generatedBy may be columns. An article that is stored already is not stored twice; of equal drafts one is.
        """
        drafts = materialise(drafts, "generated")
        listed = F.col("citations.id")
        known = self.table("sources").select("id")
        lost = drafts.select(F.col("id").alias("d"), F.explode("sourceIds").alias("id")).join(known, "id", "left_anti").groupBy(F.col("d").alias("id")).agg(F.first("id").alias("lost"))
        marks = citations.markers(F.col("body"))
        none = F.array().cast("array<string>")
        bad_id = F.filter(listed, lambda x: ~T.is_citation_id(x))
        outside = F.filter(F.col("citations.sourceId"), lambda x: ~F.array_contains(F.col("sourceIds"), x))
        reasons = F.array_compact(
            F.array(
                F.when(T.is_blank(F.col("title")), "title is required"),
                F.when(F.coalesce(F.size("sourceIds"), F.lit(0)) < 1, "at least one source is required"),
                F.when(~F.coalesce(F.col("mode").isin("digest", "synthesis"), F.lit(False)), "mode must be digest or synthesis"),
                F.when(F.col("lost").isNotNull(), F.concat(F.lit("unknown source "), F.col("lost"))),
                F.when(T.is_blank(F.col("body")), "empty body").when(~T.is_safe_markdown(F.col("body")), "unsafe raw HTML"),
                F.when(F.col("body").rlike(citations.DEFINITION), "body defines footnotes"),
                F.when(F.size(bad_id) > 0, "invalid citation id"),
                F.when(F.size(listed) > F.size(F.array_distinct(listed)), "duplicate citation id"),
                F.when(F.size(F.array_except(F.coalesce(listed, none), marks)) > 0, "body does not reference a citation"),
                F.when(F.size(F.array_except(marks, F.coalesce(listed, none))) > 0, "body references an unknown citation"),
                F.when(F.size(outside) > 0, "citation of a source outside the article"),
            )
        )
        judged = drafts.join(lost, "id", "left").withColumn("reasons", reasons).drop("lost")
        if "slug" in drafts.columns:
            taken = self.table("articles").select("slug").distinct().withColumn("taken", F.lit(True))
            first = drafts.where("slug is not null").groupBy("slug").agg(F.min("id").alias("first"))
            judged = judged.join(taken, "slug", "left").join(first, "slug", "left")
            own = F.array_compact(F.array(F.when(~T.is_safe_slug(F.col("slug")), "unsafe slug"), F.when(F.col("taken") | (F.col("first") != F.col("id")), "slug is taken")))
            judged = judged.withColumn("reasons", F.concat("reasons", own)).drop("taken", "first")
        judged = materialise(judged, "judged")
        records = library.generated_records(judged.where(F.size("reasons") == 0), self.now).dropDuplicates(["id"]).join(self.table("articles").select("id"), "id", "left_anti")
        records = materialise(self._with_free_slugs(records), "generated-records")
        broken = checks.check(records, checks.article_rules()).where(F.size("violations") > 0).limit(3).collect()
        if broken:
            raise ValueError(f"records break rules: {[(r.id, r.violations) for r in broken]}")
        writers.append_new(records.drop("contentText"), f"{self.root}/articles", "mode")
        writers.append_new(records.select("id", F.col("contentText").alias("body")), f"{self.root}/contents")
        return records.drop("contentText"), judged.where(F.size("reasons") > 0)

    def load(self, record_id: str) -> DataFrame:
        """The source or article of an id with its content; what is stored must have the hashes and length of its record."""
        record = self.show(record_id)
        stored = record.select("id", F.col("content" if record_id.startswith("src_") else "body").alias("stored")).join(self.table("contents").where(F.col("id") == record_id), "id", "left")
        judged = library.stored_text_integrity(stored.select("id", F.col("body").alias("content"), "stored")).first()
        if judged is None:
            raise KeyError(f"no record {record_id}")
        if judged.reason:
            raise ValueError(f"{record_id}: {judged.reason}")
        return record.join(self.table("contents").select("id", F.col("body").alias("contentText")), "id")

    def verify(self) -> DataFrame:
        """(id, reason) of every stored source and article whose content does not have its record's hashes and length."""
        stored = self.table("sources").select("id", F.col("content").alias("stored")).unionByName(self.table("articles").select("id", F.col("body").alias("stored")))
        j = stored.join(self.table("contents").select("id", F.col("body").alias("content")), "id", "left")
        return library.stored_text_integrity(j).where("reason is not null")

    def export(self, fmt: str, assets: DataFrame | None = None) -> DataFrame:
        """(id, artifact) of all articles with content, in markdown, html or epub; printed pages need a browser and are not made.

        assets(target, mediaType, contents): images that packages embed. The artifact of an archive in HTML is null where
        its visible text is not that which was archived.
        """
        a, s, b = self.table("articles"), self.table("sources"), self.table("contents")
        if fmt == "markdown":
            return export.markdown_export(a, b, s)
        if fmt == "html":
            return export.faithful(a, export.html_export(a, b, s)).select("id", "artifact")
        if fmt == "epub":
            return export.epub_export(a, b, s, assets=assets).select("id", F.col("epub").alias("artifact"))
        raise ValueError(f"Unsupported export format: {fmt}")

    def publish(self, fmt: str, assets: DataFrame | None = None) -> DataFrame:
        """Exports every article and stores artifacts with their export records; those stored before stay. Returns the new records."""
        made = materialise(self.export(fmt, assets).where("artifact is not null").select("id", F.col("artifact").cast("binary").alias("artifact")), "artifacts")
        records = export.export_records(made, fmt, self.now)
        records = materialise(records.join(self.table("exports").select("id"), "id", "left_anti"), "exports")
        writers.append_new(made.withColumnRenamed("id", "articleId").join(records.select("id", "articleId"), "articleId").select("id", "artifact"), f"{self.root}/artifacts")
        writers.append_new(records, f"{self.root}/exports")
        return records

    def deliver_to_vault(self, folder: str, vault_name: str, inbox: str, template: str = "{{title}}", assets: DataFrame | None = None, tags: tuple[str, ...] = (), overwrite: bool = False) -> DataFrame:
        """Notes and images of all articles into a vault, all or none, and their export records. Conflicts are refused unless overwrite."""
        a, s = self.table("articles"), self.table("sources")
        assets = assets if assets is not None else self.spark.createDataFrame([], "target string, mediaType string, contents binary")
        facts = library.source_facts(library.articles_with_sources(a, s)).withColumnRenamed("authors", "sourceAuthors").withColumnRenamed("article_id", "id")
        notes = export.markdown_export(a, self.table("contents"), s, with_metadata=False).withColumnRenamed("artifact", "body")
        planned = materialise(vault.plan_notes(a.join(facts, "id").join(notes.select("id"), "id", "left_semi"), notes, assets, inbox, template, tags), "notes")
        existing = readers.read_tree(self.spark, folder)
        write = writers.VaultWrite(materialise(vault.changes(planned.select("path", "contents"), existing, overwrite), "changes"), folder).apply()
        try:
            records = materialise(vault.delivered(planned, vault_name, inbox, self.now).join(self.table("exports").select("id"), "id", "left_anti"), "delivered")
            writers.append_new(records, f"{self.root}/exports")
        except Exception:
            write.rollback()
            raise
        write.commit()
        return records

    def list(self, limit: int = 20) -> DataFrame:
        return library.list_articles(self.table("articles"), limit)

    def show(self, record_id: str) -> DataFrame:
        name = {"src": "sources", "art": "articles", "exp": "exports"}.get(record_id[:3])
        if name is None:
            raise ValueError(f"Invalid record ID: {record_id}")
        return self.table(name).where(F.col("id") == record_id)
