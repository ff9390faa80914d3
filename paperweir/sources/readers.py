"""Scans: manifests, stored tables, captured pages, files, assets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.operators.vault import parse_frontmatter
from paperweir.schemas import ARTICLE, EXPORT, SOURCE


def read_manifests(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Record manifests of a library directory: sources, articles (all modes) or exports; a fixed schema, so nothing is inferred."""
    schema, glob = {"sources": (SOURCE, "*/manifest.json"), "articles": (ARTICLE, "*/*/manifest.json"), "exports": (EXPORT, "*/*/manifest.json")}[kind]
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/{kind}/{glob}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; articles are partitioned by mode, so a filter on mode prunes."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, path: str, glob: str = "*.{md,markdown,txt}") -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, contents) of the files under a folder that all executors share, paths relative to it; hidden files are left out."""
    root = os.path.realpath(folder.removeprefix("file://"))
    if not any(not f.startswith(".") for _, _, files in os.walk(root) for f in files):
        return spark.createDataFrame([], "path string, contents binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    return files.select(F.url_decode(F.regexp_replace(F.substring(F.regexp_replace("path", "^file:/+", "/"), len(root) + 2, 1 << 30), r"\+", "%2B")).alias("path"), F.col("content").alias("contents"))


def read_markdown(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    """(slug, text) of Markdown files, one row each, by slug; slugs None or empty for all.

    The slug is that of the frontmatter, else the file's stem; a file with an unsafe one is left out.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(article_slug(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1), F.col("value")).alias("slug"), F.col("value").alias("text")).where(T.is_safe_slug(F.col("slug")))
    return (files.where(F.col("slug").isin(*slugs)) if slugs else files).orderBy("slug")


def article_slug(stem: Column, text: Column) -> Column:
    """The slug that the frontmatter of a text states, else the stem of its file."""
    return F.coalesce(F.nullif(F.try_element_at(parse_frontmatter(text), F.lit("slug")), F.lit("")), stem)


def page_list(texts: DataFrame) -> DataFrame:
    """texts(slug, text) -> (slug, title): what a list of pages shows; a text without a title shows its slug."""
    return texts.select("slug", F.coalesce(F.nullif(F.try_element_at(parse_frontmatter(F.col("text")), F.lit("title")), F.lit("")), F.col("slug")).alias("title"))


def find_record(records: DataFrame, record_id: str) -> DataFrame:
    """The record of an id; the filter reaches the scan."""
    return records.where(F.col("id") == record_id)


def read_assets(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(target, mediaType, contents) of image files by extension, up to max_bytes."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    # File extensions of images.
    types = {".avif": "image/avif", ".bmp": "image/bmp", ".gif": "image/gif", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".svg": "image/svg+xml", ".webp": "image/webp"}
    media = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[ext]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("target"), media.alias("mediaType"), F.col("content").alias("contents")).where("mediaType is not null")
