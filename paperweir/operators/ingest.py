"""Capturing: URLs, pasted text, Markdown and files to drafts. Bad records are not raised but carry a reason in rejected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperweir.functions import articles, markdown
from paperweir.functions import text as T
from paperweir.functions.url import is_http_url
from paperweir.schemas import DRAFT
from paperweir.session import spread

EXTRACTED = "input_url string, source_url string, title string, author string, date string, description string, body string, source_text string, cleaned_html string, readable_html string, raw_html string"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for url, page in zip(pdf["url"], pdf["html"], strict=True):
            found = articles.extract(url or "", page) if isinstance(page, str) and page.strip() else None
            rows.append({**vars(found), "raw_html": page} if found else {"input_url": url, "raw_html": page})
        # object columns with None: a column that is missing throughout must not become one of numbers
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in EXTRACTED.replace(" string", "").split(", ")})


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> one row a page with everything extraction derives, computed in one pass.

    Pages without text, null and blank pages keep their URL and raw HTML and have nulls otherwise.
    """
    return spread(pages.select("url", "html")).mapInPandas(_extract, EXTRACTED)


@F.pandas_udf(StringType())
def visible_text(md: pd.Series) -> pd.Series:
    """Visible text of Markdown, normalised."""
    return md.map(lambda x: None if x is None else markdown.visible_text(x))


def _draft(df: DataFrame, **columns) -> DataFrame:
    names = DRAFT.replace(" string", "").split(", ")
    return df.select(*[(columns[n] if n in columns else F.lit(None)).cast("string").alias(n) for n in names])


def ingest_text(rows: DataFrame) -> DataFrame:
    """rows(text, label) -> drafts. Native expressions alone. Blank text is rejected; a null label is 'Pasted text'."""
    text, label = F.col("text"), F.coalesce("label", F.lit("Pasted text"))
    content = T.plain_text_to_markdown(text)
    return _draft(
        rows, kind=F.lit("text"), locator=label, title=label, content=content, mediaType=F.lit("text/markdown"), contentHash=T.versioned_sha256(content), textHash=T.text_hash(text),
        rawContent=text, rawMediaType=F.lit("text/plain"), adapter=F.lit("text"), rejected=F.when(T.is_blank(text), "Cannot ingest empty text content"),
    )


def _markdown_reason(md):
    return F.when(T.is_blank(md), "Cannot ingest empty markdown content").when(~T.is_safe_markdown(md), "Markdown contains unsafe raw HTML")


def ingest_markdown(rows: DataFrame) -> DataFrame:
    """rows(markdown, label) -> drafts; the body stays byte-exact, no raw capture is kept. Blank or unsafe Markdown is rejected."""
    md, label = F.col("markdown"), F.coalesce("label", F.lit("Pasted Markdown"))
    return _draft(
        rows, kind=F.lit("markdown"), locator=label, title=label, content=md, mediaType=F.lit("text/markdown"), contentHash=T.versioned_sha256(md),
        textHash=T.versioned_sha256(visible_text(md)), adapter=F.lit("markdown"), rejected=_markdown_reason(md),
    )


def ingest_files(files: DataFrame) -> DataFrame:
    """files(path, content binary) -> drafts of .md, .markdown and .txt files. Other types, invalid UTF-8 and NULs are rejected."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    is_md, is_txt = ext.isin(".md", ".markdown"), ext == ".txt"
    body = F.when(is_md, text).otherwise(T.plain_text_to_markdown(text))
    reason = (
        F.when(~is_md & ~is_txt, F.concat(F.lit("Unsupported source file type: "), F.coalesce(F.nullif(ext, F.lit("")), F.lit("(none)"))))
        .when(text.isNull(), F.concat(F.lit("Source file is not valid UTF-8 text: "), F.col("path")))
        .when(text.contains("\0"), F.concat(F.lit("Source file appears to be binary: "), F.col("path")))
        .when(T.is_blank(text), F.concat(F.lit("Cannot ingest empty "), F.when(is_md, "markdown").otherwise("text"), F.lit(" content")))
        .when(is_md & ~T.is_safe_markdown(text), "Markdown contains unsafe raw HTML")
    )
    return _draft(
        files, kind=F.lit("file"), locator=F.col("path"), title=stem, content=body, mediaType=F.lit("text/markdown"), contentHash=T.versioned_sha256(body),
        textHash=F.when(is_md, T.versioned_sha256(visible_text(text))).otherwise(T.text_hash(text)), rawContent=F.when(is_txt, text), rawMediaType=F.when(is_txt, "text/plain"),
        adapter=F.when(is_md, "markdown-file").otherwise("text-file"), rejected=reason,
    )


def ingest_urls(pages: DataFrame) -> DataFrame:
    """pages(url, html, status, contentType) of a crawl -> drafts. Bad URLs, responses and content types, and pages without an article, are rejected."""
    kind = F.lower(F.trim(F.substring_index("contentType", ";", 1)))
    reason = (
        F.when(~is_http_url(F.col("url")), F.concat(F.lit("Invalid article URL: "), F.coalesce("url", F.lit(""))))
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(True)), F.concat(F.lit("HTTP "), F.col("status")))
        .when(F.coalesce(kind, F.lit("")).isin("", "text/html", "application/xhtml+xml"), F.lit(None))
        .otherwise(F.concat(F.lit("Unsupported content type: "), kind))
    )
    judged = pages.select("url", "html", reason.alias("reason"))
    good = extract_pages(judged.where("reason is null"))
    kept = _draft(
        good, kind=F.lit("url"), locator=F.col("input_url"), title=F.col("title"), author=F.col("author"), description=F.nullif("description", F.lit("")), publishedAt=F.nullif("date", F.lit("")),
        canonicalUrl=F.col("source_url"), content=F.col("body"), mediaType=F.lit("text/markdown"), contentHash=T.versioned_sha256(F.col("body")), textHash=T.versioned_sha256(F.col("source_text")),
        rawContent=F.col("raw_html"), rawMediaType=F.lit("text/html"), adapter=F.lit("url"), rejected=F.when(F.col("body").isNull(), "Could not extract article content"),
    )
    bad = _draft(judged.where("reason is not null"), kind=F.lit("url"), locator=F.col("url"), rawContent=F.col("html"), rawMediaType=F.lit("text/html"), adapter=F.lit("url"), rejected=F.col("reason"))
    return kept.unionByName(bad)


def ingest(inputs: DataFrame) -> DataFrame:
    """inputs(kind, value, label) -> drafts by kind: text, markdown, url (value the page, label its URL). Unknown kinds are rejected."""
    of = lambda k: inputs.where(F.col("kind") == k)
    known = ingest_text(of("text").select(F.col("value").alias("text"), "label")).unionByName(ingest_markdown(of("markdown").select(F.col("value").alias("markdown"), "label")))
    pages = of("url").select(F.col("label").alias("url"), F.col("value").alias("html"), F.lit(200).alias("status"), F.lit("text/html").alias("contentType"))
    other = inputs.where(~F.coalesce(F.col("kind").isin("text", "markdown", "url"), F.lit(False)))
    unknown = _draft(other, kind=F.col("kind"), locator=F.col("label"), rejected=F.concat(F.lit("Unsupported source kind: "), F.coalesce("kind", F.lit("(none)"))))
    return known.unionByName(ingest_urls(pages)).unionByName(unknown)
