"""Notes for a vault: names, frontmatter, assets, and the plan of changes."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from paperweir.functions import markdown
from paperweir.functions import text as T
from paperweir.functions.url import asset_stem, encode_path

VARIABLES = ("title", "slug", "id", "mode", "date")
RESERVED = ("articleId", "mode", "title", "slug", "canonicalUrl", "sourceIds", "sourceUrls", "authors", "createdAt", "publishedAt", "generatedBy", "tags")
MAX_ASSET_BYTES = 20 * 1024 * 1024


def unknown_variables(template: str) -> list[str]:
    return [v for v in re.findall(r"\{\{\s*([^{}]+?)\s*\}\}", template) if v not in VARIABLES]


def note_name(template: str) -> Column:
    """File name of a note over article columns; the template is checked at once."""
    if bad := unknown_variables(template):
        raise ValueError(f"Unsupported note template variable: {bad[0]}")
    if re.search(r"\{\{|\}\}", re.sub(r"\{\{\s*[^{}]+?\s*\}\}", "", template)):
        raise ValueError("Malformed note naming template")
    values = {v: F.col(v) for v in ("title", "slug", "id", "mode")} | {"date": F.substring("createdAt", 1, 10)}
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([^{}]+?)\s*\}\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
        at = m.end()
    return T.sanitize_filename(F.concat(*parts, F.lit(template[at:])))


def json_string(c: Column) -> Column:
    """A JSON scalar of a string column."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def json_array(c: Column) -> Column:
    return F.to_json(c)


def frontmatter(articles: DataFrame, tags: tuple[str, ...] = (), custom: dict[str, str] | None = None, id_key: str = "articleId") -> DataFrame:
    """articles with authors, published, urls, canonicalUrl of their sources -> (id, frontmatter): fixed key order, absent values left out.

    custom maps further keys to JSON texts; reserved keys are refused.
    """
    if clash := [k for k in custom or {} if k in RESERVED or k == id_key]:
        raise ValueError(f"Custom frontmatter cannot replace reserved property {clash[0]}")
    kept = list(dict.fromkeys(t for tag in tags if (t := tag.strip().lstrip("#"))))
    line = lambda k, v: F.concat(F.lit(f'"{k}": '), v)
    some = lambda c: F.when(F.size(c) > 0, json_array(F.col(c)))
    published = F.when(F.size("published") == 1, json_string(F.col("published")[0])).when(F.size("published") > 1, json_array(F.col("published")))
    by = F.when(F.col("generatedBy").isNotNull(), json_string(F.concat_ws("/", "generatedBy.provider", "generatedBy.model")))
    lines = [F.lit(f'"{k}": {v}') for k, v in (custom or {}).items()] + [
        line(id_key, json_string(F.col("id"))), line("mode", json_string(F.col("mode"))), line("title", json_string(F.col("title"))), line("slug", json_string(F.col("slug"))),
        F.when(F.col("canonicalUrl").isNotNull(), line("canonicalUrl", json_string(F.col("canonicalUrl")))), line("sourceIds", json_array(F.col("sourceIds"))), line("sourceUrls", some("urls")),
        line("authors", some("allAuthors")), line("createdAt", json_string(F.col("createdAt"))), line("publishedAt", published), line("generatedBy", by),
        F.lit('"tags": ' + str(kept).replace("'", '"').replace(", ", ",")) if kept else F.lit(None).cast("string"),
    ]
    with_authors = articles.withColumn("allAuthors", F.coalesce("authors", "sourceAuthors", F.array().cast("array<string>")))
    return with_authors.select("id", F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n\n")).alias("frontmatter"))


def parse_frontmatter(md: Column) -> Column:
    """map<string,string> of a document's frontmatter: JSON strings unquoted, other values as written; later keys win; empty without frontmatter."""
    lines = F.split(md, "\n")
    end = F.array_position(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "---")
    inner = F.when((lines[0] == "---") & (end > 0), F.slice(lines, F.lit(2), (end - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    pairs = F.filter(inner, lambda s: F.contains(s, F.lit(":")))
    value = lambda s: F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s)))
    plain = lambda v: F.coalesce(F.when(v.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")), v)
    entries = F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), plain(value(s)).alias("value")))
    # the last value of a key stands
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


_REFS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("target", StringType()))


@F.pandas_udf(_REFS)
def image_references(md: pd.Series) -> pd.Series:
    """Images outside code: offsets and targets in order. Null texts have none."""
    return md.map(lambda x: [] if x is None else [{"start": a, "end": b, "target": t} for a, b, t in markdown.image_references(x)])


def number_assets(references: DataFrame) -> DataFrame:
    """references(article_id, start, target) -> (article_id, target, n): distinct targets numbered by first appearance."""
    first = references.groupBy("article_id", "target").agg(F.min("start").alias("first"))
    return first.select("article_id", "target", F.dense_rank().over(Window.partitionBy("article_id").orderBy("first", "target")).alias("n"))


def plan_assets(references: DataFrame, assets: DataFrame, slugs: DataFrame, folder: str = "attachments") -> DataFrame:
    """Numbered targets with fetched assets(target, mediaType, contents) -> export name, vault path, and why one is refused.

    Assets with an article_id are those of that article alone, as local files are.
    """
    ext = T.image_extension(F.col("mediaType"))
    on = ["article_id", "target"] if "article_id" in assets.columns else ["target"]
    j = number_assets(references).join(assets.select(*on, "mediaType", F.octet_length("contents").alias("bytes")), on, "left").join(slugs, "article_id")
    name = F.concat(F.lpad(F.col("n").cast("string"), 3, "0"), F.lit("-"), asset_stem(F.col("target")), ext)
    reason = F.when(F.col("mediaType").isNull(), "not fetched").when(ext.isNull(), "unsupported media type").when(F.col("bytes") > MAX_ASSET_BYTES, "too large")
    return j.select("article_id", "target", "n", name.alias("export_name"), F.concat_ws("/", F.lit(folder), "slug", name).alias("vault_path"), reason.alias("rejected"))


@F.pandas_udf(StringType())
def splice(md: pd.Series, targets: pd.Series) -> pd.Series:
    """Text with its image targets replaced; targets maps target to new path, others stay."""

    def one(text, table):
        if text is None:
            return None
        table, out, at = dict(table) if table is not None else {}, [], 0
        for a, b, t in markdown.image_references(text):
            out += [text[at:a], table.get(t, t)]
            at = b
        return "".join(out) + text[at:]

    return pd.Series([one(x, t) for x, t in zip(md, targets, strict=True)])


@F.pandas_udf(StringType())
def _resolved(folder: pd.Series, target: pd.Series) -> pd.Series:
    """The file that a local target names, from the folder of its document."""
    path = lambda t: unquote(urlsplit(t).path if t.startswith("file:") else t)
    return pd.Series([None if f is None or t is None else posixpath.normpath(posixpath.join(f, path(t))) for f, t in zip(folder, target, strict=True)])


def local_assets(references: DataFrame, articles: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """references(article_id, target), files(path, mediaType, contents) -> (article_id, target, mediaType, contents, rejected): images in local files.

    Only an article with exactly one file source of an absolute path may show local images, found from that file's folder.
    Targets on the web take no part.
    """
    local = references.select("article_id", "target").distinct().where(F.col("target").rlike("^file:") | ~F.col("target").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"))
    own = articles.select(F.col("id").alias("article_id"), F.explode("sourceIds").alias("sid")).distinct()
    from_files = sources.where((F.col("kind") == "file") & F.startswith("origin.locator", F.lit("/"))).select(F.col("id").alias("sid"), F.regexp_replace("origin.locator", "/[^/]*$", "").alias("folder")).distinct()
    place = own.join(from_files, "sid").groupBy("article_id").agg(F.count("*").alias("n"), F.first("folder").alias("folder"))
    j = local.join(place, "article_id", "left").withColumn("path", F.when(F.col("n") == 1, _resolved(F.coalesce("folder", F.lit("/")), "target")))
    found = j.join(files.select("path", "mediaType", "contents"), "path", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) != 1, "needs exactly one file source").when(F.col("contents").isNull(), "no such image file")
    return found.select("article_id", "target", "mediaType", "contents", reason.alias("rejected"))


def rewrite_images(bodies: DataFrame, planned: DataFrame, attachments: str = "attachments", inbox: str = "") -> DataFrame:
    """bodies(article_id, body), planned assets -> (article_id, body) with links to the vault's files, from the notes' folder."""
    way = posixpath.relpath(attachments, inbox or ".")
    link = F.concat(F.lit(way), F.substring("vault_path", len(attachments) + 1, 1 << 30))
    good = planned.where("rejected is null").groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("target", encode_path(link)))).alias("targets"))
    return bodies.join(good, "article_id", "left").select("article_id", splice(F.col("body"), F.col("targets")).alias("body"))


def diff(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """planned(path, contents), existing(path, contents) -> (path, status): missing, unchanged or conflict. Files of no plan are left alone."""
    e = existing.select("path", F.sha2(F.col("contents").cast("binary"), 256).alias("old"))
    p = planned.select("path", F.sha2(F.col("contents").cast("binary"), 256).alias("new"))
    status = F.when(F.col("old").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("conflict")
    return p.join(e, "path", "left").select("path", status.alias("status"))


def changes(planned: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """The planned files to write; conflicts are refused unless overwrite."""
    d = diff(planned, existing)
    if not overwrite and (bad := d.where("status = 'conflict'").select("path").limit(5).collect()):
        raise FileExistsError(f"export would overwrite {', '.join(r.path for r in bad)}")
    return planned.join(d.where("status <> 'unchanged'").select("path"), "path", "left_semi")


def plan_notes(articles: DataFrame, bodies: DataFrame, assets: DataFrame, inbox: str, template: str, tags: tuple[str, ...] = (), attachments: str = "attachments", custom: dict[str, str] | None = None) -> DataFrame:
    """The files of a vault export: (article_id, path, contents binary) of each article's note and images.

    articles with the facts of their sources (authors, published, urls, canonicalUrl), bodies(id, body) rendered Markdown,
    assets(target, mediaType, contents). Links to images that are taken up point to their files in the vault.
    """
    own = bodies.select(F.col("id").alias("article_id"), "body")
    refs = own.select("article_id", F.explode(image_references(F.col("body"))).alias("r")).select("article_id", "r.start", "r.target")
    planned = plan_assets(refs, assets, articles.select(F.col("id").alias("article_id"), "slug").distinct(), attachments)
    name = articles.select(F.col("id").alias("article_id"), F.concat_ws("/", F.lit(inbox), F.concat(note_name(template), F.lit(".md"))).alias("path"))
    front = frontmatter(articles, tags, custom).withColumnRenamed("id", "article_id")
    notes = rewrite_images(own, planned, attachments, inbox).join(name, "article_id").join(front, "article_id").select("article_id", "path", F.concat("frontmatter", "body").cast("binary").alias("contents"))
    on = ["article_id", "target"] if "article_id" in assets.columns else ["target"]
    images = planned.where("rejected is null").join(assets.select(*on, "contents"), on).select("article_id", F.col("vault_path").alias("path"), "contents")
    return notes.unionByName(images)


def delivered(planned: DataFrame, vault_name: str, inbox: str, at: str) -> DataFrame:
    """Export records of the notes of a vault export that was written."""
    notes = planned.where(F.startswith("path", F.lit(f"{inbox}/")) & F.endswith("path", F.lit(".md")))
    eid = T.content_id("exp", F.col("article_id"), F.lit("vault"), F.sha2("contents", 256))
    return notes.withColumn("eid", eid).select(
        F.lit(1).alias("schemaVersion"), F.col("eid").alias("id"), F.col("article_id").alias("articleId"), F.lit("markdown").alias("format"),
        F.struct(F.lit("obsidian").alias("type"), F.lit(vault_name).alias("vaultName"), F.col("path").alias("notePath")).alias("destination"), F.lit("delivered").alias("status"),
        F.struct(F.concat_ws("/", T.export_directory(F.col("article_id"), F.col("eid")), F.lit("article.md")).alias("path"), F.lit("text/markdown").alias("mediaType"), F.concat(F.lit("sha256:"), F.sha2("contents", 256)).alias("contentHash"), F.octet_length("contents").cast("long").alias("byteLength")).alias("artifact"),
        F.lit(at).alias("createdAt"), F.struct(F.lit(at).alias("attemptedAt"), F.lit(at).alias("deliveredAt")).alias("delivery"),
    )
