"""Text functions as native column expressions; Unicode normalisation alone runs in Python, vectorised."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as ECMAScript's \s has it; the same text works in Java and RE2.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_EDGE = rf"^{WS}+|{WS}+$"


def normalize_text(c: Column) -> Column:
    """White space runs become one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(trim_all(c) == "", F.lit(True))


def versioned_sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def text_hash(c: Column) -> Column:
    """Hash of the normalised visible text of plain text."""
    return versioned_sha256(normalize_text(c))


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def plain_text_to_markdown(c: Column) -> Column:
    """Plain text as Markdown that shows it: line ends unified, three entities, punctuation escaped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return F.regexp_replace(c, r"([\\`*_\[\]{}()#+\-.!|])", r"\\$1")


def _entities(c: Column, quote: str) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def escape_html(c: Column) -> Column:
    return _entities(c, "&#39;")


def escape_xml(c: Column) -> Column:
    return _entities(c, "&apos;")


def escape_markdown(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, r"([\\`*_\[\]])", r"\\$1"), WS + "+", " "))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def comparison_text(c: Column) -> Column:
    """For comparing wording: compatibility form, lower case, punctuation and symbols as spaces."""
    return normalize_text(F.regexp_replace(F.lower(nfkc(c)), r"[\p{P}\p{S}]+", " "))


def slugify(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, 80 characters at most, 'article' where nothing is left."""
    s = F.lower(F.regexp_replace(nfkd(c), r"[\x{0300}-\x{036f}]", ""))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 80), F.lit("")), F.when(c.isNotNull(), "article"))


def is_safe_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(c) <= 100)


def is_byline(c: Column) -> Column:
    t = normalize_text(c)
    return (F.length(t) <= 240) & t.rlike(r"(?iu)^by\s+\p{L}")


def is_safe_markdown(c: Column) -> Column:
    """No forbidden tags, event handlers or script URLs in raw HTML."""
    # The patterns of unsafe HTML.
    return ~(
        c.rlike(r"(?iu)<\s*/?\s*(script|style|iframe|object|embed|form|input|button|svg|canvas|link|meta)\b")
        | c.rlike(r"(?iu)\son[a-z]+\s*=")
        | c.rlike(r"(?iu)(?:href|src)\s*=\s*[\"']?\s*javascript:")
    )


def format_bytes(c: Column) -> Column:
    """B up to 1023, then KiB and MiB with one decimal."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.format_string("%.1f KiB", c / 1024))
        .otherwise(F.format_string("%.1f MiB", c / (1024 * 1024)))
    )


def redact_email(c: Column) -> Column:
    """First character, three to eight stars, the domain after the last @."""
    domain = F.substring_index(c, "@", -1)
    local = F.substring(c, F.lit(1), F.length(c) - F.length(domain) - 1)
    stars = F.repeat(F.lit("*"), F.least(F.greatest(F.length(local) - 1, F.lit(3)), F.lit(8)))
    return F.when(~c.contains("@") | (F.length(local) <= 0), F.lit("[redacted]")).otherwise(F.concat(F.substring(local, 1, 1), stars, F.lit("@"), domain))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+$") & ~c.rlike(r"[\r\n]")


def is_device_address(c: Column, domain: str = "kindle.com") -> Column:
    """An address of the domain that reading devices receive at; null is none."""
    return F.coalesce(is_email(c) & F.endswith(F.lower(c), F.lit(f"@{domain}")), F.lit(False))


def safe_subject(c: Column, product: str) -> Column:
    """Mail subject: the product's name and the title, control characters as spaces, 200 characters at most."""
    return F.substring(F.concat(F.lit(f"{product}: "), trim_all(F.regexp_replace(c, r"[\x00-\x1f]+", " "))), 1, 200)


def safe_filename(slug: Column, extension: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(slug, "(?i)[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(s, F.lit("")), F.lit("article")), F.lit(f".{extension}"))


def sanitize_filename(c: Column) -> Column:
    """A file name for any title; null where nothing usable is left."""
    s = F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1f]", "-")
    s = trim_all(F.regexp_replace(F.regexp_replace(s, WS + "+", " "), r"[. ]+$", ""))
    return F.when(~s.isin("", ".", ".."), s)


def record_id(prefix: str, entropy: Column) -> Column:
    """Record id of given entropy (such as a UUID or a hash); null where fewer than 16 characters are left."""
    e = F.regexp_replace(F.lower(entropy), "[^a-z0-9]", "")
    return F.when(F.length(e) >= 16, F.concat(F.lit(f"{prefix}_"), F.substring(e, 1, 64)))


def content_id(prefix: str, *parts: Column) -> Column:
    """A record id that depends on the content alone, so that retried tasks give the same."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32))


def is_record_id(c: Column, prefix: str = "src|art|cite|exp") -> Column:
    return c.rlike(f"^(?:{prefix})_[a-z0-9]{{16,64}}$")


def is_citation_id(c: Column) -> Column:
    return c.rlike("^cite_[a-z0-9][a-z0-9_-]{0,63}$")


def modified_timestamp(c: Column) -> Column:
    """ISO time without fractions, from an ISO string."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fence_for(code: Column) -> Column:
    """Backticks that enclose a text: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def source_content_path(source_id: Column) -> Column:
    return F.concat_ws("/", F.lit("sources"), source_id, F.lit("content.md"))


def article_content_path(mode: Column, article_id: Column) -> Column:
    return F.concat_ws("/", F.lit("articles"), mode, article_id, F.lit("content.md"))


def export_directory(article_id: Column, export_id: Column) -> Column:
    return F.concat_ws("/", F.lit("exports"), article_id, export_id)


def is_safe_path(c: Column) -> Column:
    """Relative, no backslash, no empty, . or .. part, no drive."""
    return ~c.contains("\\") & ~c.rlike("^[A-Za-z]:") & ~F.exists(F.split(c, "/"), lambda s: s.isin("", ".", ".."))


def raw_capture_name(media_type: Column) -> Column:
    return F.when(media_type == "text/html", "source.html").when(media_type == "text/plain", "source.txt").otherwise("source.bin")


def argument_kind(value: Column) -> Column:
    return F.when(value.rlike("(?i)^https?://"), "url").otherwise("file")


# Media types of images and their file extensions.
IMAGE_EXTENSIONS = {
    "image/avif": ".avif", "image/bmp": ".bmp", "image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png",
    "image/svg+xml": ".svg", "image/webp": ".webp",
}
# Name and media type of an artifact by format.
ARTIFACTS = {"markdown": ("article.md", "text/markdown"), "html": ("article.html", "text/html"), "pdf": ("article.pdf", "application/pdf"), "epub": ("article.epub", "application/epub+zip")}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def image_extension(media_type: Column) -> Column:
    """Null for media types that are not supported."""
    return lookup(IMAGE_EXTENSIONS, F.lower(media_type))


def image_scale(c: Column) -> Column:
    """The whole number from 1 to 100 that a text states, else null."""
    n = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return F.when(n.between(1, 100), n)
