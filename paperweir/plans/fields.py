"""Queries of field functions, capture and records that library.py leaves out, each over whole tables, and the SQL that checks them.

Where a rule needs faults that the tables don't hold, every row is altered by a rule on its id, alike in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.functions import url as U
from paperweir.operators import checks, export, fonts, ingest, library
from paperweir.plans.library import _ESC_HTML, _MD_SQL, NOW, WS, _articles, _exports, _plain_sql, _sources, query
from paperweir.session import table
from paperweir.sources import readers


def _k(n: int, c: str = "id") -> Column:
    """0 to n - 1 by the last character of an id."""
    return F.ascii(F.right(F.col(c), F.lit(1))) % n


def _ksql(n: int, c: str = "id") -> str:
    return f"ascii(right({c}, 1)) % {n}"


# --- predicates and small functions


@query("select distinct id, regexp_matches(id, '^(src|art|cite|exp)_[a-z0-9]{16,64}$') as valid, 'art_' || substr(regexp_replace(lower(id || ':' || kind), '[^a-z0-9]', '', 'g'), 1, 64) as made from sources")
def record_ids(s, d):
    return _sources(s, d).select("id", T.is_record_id(F.col("id")).alias("valid"), T.record_id("art", F.concat_ws(":", "id", "kind")).alias("made")).distinct()


@query("select a.id as article_id, c.id as cite_id, regexp_matches(c.id, '^cite_[a-z0-9][a-z0-9_-]{0,63}$') as valid from (select distinct id, citations from articles) a, unnest(a.citations) t(c)")
def citation_ids(s, d):
    return _articles(s, d).select(F.col("id").alias("article_id"), F.explode("citations").alias("c")).select("article_id", F.col("c.id").alias("cite_id"), T.is_citation_id(F.col("c.id")).alias("valid"))


@query(f"""select id, p as path, not contains(p, '\\') and not regexp_matches(p, '^[A-Za-z]:') and len(list_filter(string_split(p, '/'), lambda x: x in ('', '.', '..'))) = 0 as safe from
(select id, case {_ksql(5)} when 0 then '/' || p when 1 then replace(p, 'exports', '..') when 2 then 'C:' || p when 3 then replace(p, '/', '\\') else p end as p from (select distinct id, artifact.path as p from exports))""")
def safe_paths(s, d):
    """Paths of artifacts, four in five altered."""
    p, k = F.col("artifact.path"), _k(5)
    altered = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.replace(p, F.lit("exports"), F.lit(".."))).when(k == 2, F.concat(F.lit("C:"), p)).when(k == 3, F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(p)
    return _exports(s, d).select("id", altered.alias("path")).select("id", "path", T.is_safe_path(F.col("path")).alias("safe"))


@query("select distinct id, case when regexp_matches(origin.locator, '(?i)^https?://') then 'url' else 'file' end as kind from sources")
def argument_kinds(s, d):
    return _sources(s, d).select("id", T.argument_kind(F.col("origin.locator")).alias("kind")).distinct()


@query("""select doc_id, t as stated, case when regexp_matches(t, '^[0-9]+$') and try_cast(t as integer) between 1 and 100 then try_cast(t as integer) end as scale from
(select doc_id, case doc_id % 4 when 0 then cast(doc_id % 130 as varchar) when 1 then '-' || doc_id when 2 then doc_id || '%' else cast(n_chars as varchar) end as t from documents)""")
def image_scales(s, d):
    n = F.col("doc_id")
    stated = F.when(n % 4 == 0, (n % 130).cast("string")).when(n % 4 == 1, F.concat(F.lit("-"), n)).when(n % 4 == 2, F.concat(n.cast("string"), F.lit("%"))).otherwise(F.col("n_chars").cast("string"))
    return table(s, d, "documents").select("doc_id", stated.alias("stated")).select("doc_id", "stated", T.image_scale(F.col("stated")).alias("scale"))


@query("""select distinct id, case lower(t) when 'image/avif' then '.avif' when 'image/bmp' then '.bmp' when 'image/gif' then '.gif' when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'image/svg+xml' then '.svg' when 'image/webp' then '.webp' end as extension
from (select id, case """ + _ksql(6) + """ when 0 then 'image/PNG' when 1 then 'image/jpeg' when 2 then 'image/svg+xml' when 3 then 'image/tiff' when 4 then 'image/webp' else artifact.mediaType end as t from exports)""")
def media_extensions(s, d):
    k = _k(6)
    media = F.when(k == 0, "image/PNG").when(k == 1, "image/jpeg").when(k == 2, "image/svg+xml").when(k == 3, "image/tiff").when(k == 4, "image/webp").otherwise(F.col("artifact.mediaType"))
    return _exports(s, d).select("id", T.image_extension(media).alias("extension")).distinct()


@query("select doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)) as fence from documents where text is not null")
def code_fences(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.fence_for(F.col("text")).alias("fence"))


@query(r"""select distinct id, regexp_matches(a, '^[^\s@]+@[^\s@]+$') as email, regexp_matches(a, '^[^\s@]+@[^\s@]+$') and ends_with(lower(a), '@kindle.com') as device from
(select id, case """ + _ksql(4) + """ when 0 then slug || '@Kindle.com' when 1 then slug || '@mail.example' when 2 then slug else slug || ' x@kindle.com' end as a from articles)""")
def device_addresses(s, d):
    k = _k(4)
    a = F.when(k == 0, F.concat("slug", F.lit("@Kindle.com"))).when(k == 1, F.concat("slug", F.lit("@mail.example"))).when(k == 2, F.col("slug")).otherwise(F.concat("slug", F.lit(" x@kindle.com")))
    return _articles(s, d).select("id", T.is_email(a).alias("email"), T.is_device_address(a).alias("device")).distinct()


@query("""select id, u as url, regexp_matches(u, '(?i)^https?://') and not contains(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), '@') and h <> '' and h <> 'localhost' and not ends_with(h, '.localhost')
and not (regexp_matches(h, '^[0-9.]+$') and (starts_with(h, '10.') or starts_with(h, '192.168.') or starts_with(h, '127.'))) as public from
(select id, u, lower(regexp_extract(u, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as h from (select "sourceId" as id, case """ + _ksql(7, '"sourceId"') + """
when 0 then 'http://10.0.0.8/a.png' when 1 then 'https://user:pw@img.example/a.png' when 2 then 'https://img.localhost/a.png' when 3 then 'ftp://img.example/a.png' when 4 then 'https://8.8.8.8/a.png' when 5 then 'http://192.168.7.1/x' else 'https://img.example/' || "sourceId" || '.png' end as u from web_articles))""")
def public_image_urls(s, d):
    k = _k(7, "sourceId")
    u = F.when(k == 0, "http://10.0.0.8/a.png").when(k == 1, "https://user:pw@img.example/a.png").when(k == 2, "https://img.localhost/a.png").when(k == 3, "ftp://img.example/a.png").when(k == 4, "https://8.8.8.8/a.png").when(k == 5, "http://192.168.7.1/x").otherwise(F.concat(F.lit("https://img.example/"), "sourceId", F.lit(".png")))
    return table(s, d, "web_articles").select(F.col("sourceId").alias("id"), u.alias("url")).select("id", "url", U.is_public_image_url(F.col("url")).alias("public"))


@query("""select distinct id, array_to_string(list_transform(string_split('notes/' || slug || ' (' || mode || ')/a b', '/'), lambda x: replace(replace(url_encode(x), '%28', '('), '%29', ')')), '/') as encoded from articles""")
def encoded_paths(s, d):
    return _articles(s, d).select("id", U.encode_path(F.concat(F.lit("notes/"), "slug", F.lit(" ("), "mode", F.lit(")/a b"))).alias("encoded")).distinct()


@query("select distinct id, id || '  ' || rpad(mode, 9, ' ') || '  ' || title as line from articles where title is not null")
def list_lines(s, d):
    return library.list_line(_articles(s, d).where("title is not null")).distinct()


@query(f"select id, {_ESC_HTML.replace('&#39;', '&apos;').format(c='title')} as xml from (select distinct id, title from sources)")
def xml_titles(s, d):
    return _sources(s, d).select("id", T.escape_xml(F.col("title")).alias("xml")).distinct()


# --- capture

_SAFE_MD = """not (regexp_matches(text, '(?i)<\\s*/?\\s*(script|style|iframe|object|embed|form|input|button|svg|canvas|link|meta)\\b') or regexp_matches(text, '(?i)\\son[a-z]+\\s*=') or regexp_matches(text, '(?i)(?:href|src)\\s*=\\s*["'']?\\s*javascript:'))"""


@query(f"select doc_id, 'sha256:' || sha256(text) as content_hash, strlen(text) as n_bytes from documents where text is not null and {_plain_sql('text')} <> '' and {_SAFE_MD}")
def markdown_drafts(s, d):
    """Documents captured as Markdown: the body of those accepted stays as it is."""
    drafts = ingest.ingest_markdown(table(s, d, "documents").select(F.col("text").alias("markdown"), F.col("doc_id").cast("string").alias("label")))
    return drafts.where("rejected is null").select(F.col("locator").cast("long").alias("doc_id"), F.col("contentHash").alias("content_hash"), T.byte_length(F.col("content")).alias("n_bytes"))


@query(f"""select reason, count(*) as n from (select case when e = 'json' then 'Unsupported source file type: .json' when nul then 'Source file appears to be binary: ' || p when {_plain_sql('text')} = '' then 'Cannot ingest empty ' || case when e = 'txt' then 'text' else 'markdown' end || ' content'
when e = 'md' and not ({_SAFE_MD}) then 'Markdown contains unsafe raw HTML' else 'accepted' end as reason from
(select *, '/in/' || doc_id || '.' || e as p, doc_id % 50 = 7 as nul from (select doc_id, text, case doc_id % 5 when 0 then 'json' when 1 then 'txt' else 'md' end as e from documents where text is not null))) group by reason""")
def file_drafts(s, d):
    """Documents as files of several types, some with a NUL: why they are rejected."""
    e = F.when(F.col("doc_id") % 5 == 0, "json").when(F.col("doc_id") % 5 == 1, "txt").otherwise("md")
    text = F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    files = table(s, d, "documents").where("text is not null").select(F.concat(F.lit("/in/"), "doc_id", F.lit("."), e).alias("path"), text.cast("binary").alias("content"))
    return ingest.ingest_files(files).groupBy(F.coalesce("rejected", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""select kind, reason, count(*) as n from (select case doc_id % 3 when 0 then 'text' when 1 then 'markdown' else 'fax' end as kind, case when doc_id % 3 = 2 then 'Unsupported source kind: fax'
when {_plain_sql("coalesce(text, '')")} = '' then 'Cannot ingest empty ' || case doc_id % 3 when 0 then 'text' else 'markdown' end || ' content' when doc_id % 3 = 1 and not ({_SAFE_MD}) then 'Markdown contains unsafe raw HTML' else 'accepted' end as reason from documents) group by 1, 2""")
def capture_dispatch(s, d):
    """Documents as inputs of several kinds, one of which is unknown."""
    kind = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "markdown").otherwise("fax")
    inputs = table(s, d, "documents").select(kind.alias("kind"), F.col("text").alias("value"), F.lit("x").alias("label"))
    return ingest.ingest(inputs).groupBy("kind", F.coalesce("rejected", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""select reason, count(*) as n from (select case """ + _ksql(6, '"sourceId"') + """ when 0 then 'HTTP 404' when 1 then 'Unsupported content type: application/pdf' when 2 then 'Invalid article URL: mailto:x' else 'fetched' end as reason from web_articles where "rawHtml" is not null) group by reason""")
def fetch_rejections(s, d):
    """Pages as a crawl would bring them, half of them with a bad status, type or URL."""
    k = _k(6, "sourceId")
    pages = table(s, d, "web_articles").where("rawHtml is not null").select(
        F.when(k == 2, "mailto:x").otherwise(F.concat(F.lit("https://e.test/"), "sourceId")).alias("url"), F.col("rawHtml").alias("html"), F.when(k == 0, 404).otherwise(200).alias("status"),
        F.when(k == 1, "application/pdf").otherwise("text/HTML; charset=utf-8").alias("contentType"),
    )
    bad = F.col("rejected").rlike("^(HTTP|Unsupported|Invalid)")
    return ingest.ingest_urls(pages).groupBy(F.when(bad, F.col("rejected")).otherwise("fetched").alias("reason")).agg(F.count("*").alias("n"))


@query("""select distinct id, case """ + _ksql(4) + """ when 0 then 'content hash mismatch' when 1 then 'byte length mismatch' when 2 then 'text hash mismatch' end as reason from sources where title is not null""")
def stored_integrity(s, d):
    """Titles as stored texts, three in four altered in store: the first thing that differs."""
    t, k = F.col("title"), _k(4)
    stored = F.struct(F.when(k == 0, "sha256:0").otherwise(T.versioned_sha256(t)).alias("contentHash"), F.when(k == 2, "sha256:0").otherwise(T.versioned_sha256(ingest.visible_text(t))).alias("textHash"), (T.byte_length(t) + F.when(k == 1, 1).otherwise(0)).alias("byteLength"))
    return library.stored_text_integrity(_sources(s, d).where("title is not null").select("id", t.alias("content"), stored.alias("stored"))).distinct()


# --- generated articles, plain notes

_DERIVED = """a as (select id, any_value(mode) as mode, any_value(title) as title, any_value("sourceIds") as sids, any_value(citations) as citations from articles where mode <> 'archive' and title is not null group by id),
b as (select *, 'Notes' || array_to_string(list_transform(citations, lambda c: ' and [^' || c.id || ']'), '') as body from a)"""


@query(f"""with {_DERIVED} select id as draft_id, 'art_' || substr(sha256(mode || chr(31) || regexp_replace(title, '^{WS}+|{WS}+$', '', 'g') || chr(31) || array_to_string(sids, chr(31)) || chr(31) || sha256(body)), 1, 32) as id,
regexp_replace(title, '^{WS}+|{WS}+$', '', 'g') as title, cast(len(list_distinct(sids)) as integer) as n_sources, 'sha256:' || sha256(body) as content_hash, strlen(body) as n_bytes from b""")
def generated_articles(s, d):
    """Derived articles written anew from drafts that cite their sources: identity, hashes and sizes of the records."""
    a = _articles(s, d).where("mode <> 'archive' and title is not null").dropDuplicates(["id"])
    body = F.concat(F.lit("Notes"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit(" and [^"), c["id"], F.lit("]"))), ""))
    drafts = a.select(F.col("id").alias("draft_id"), "mode", "title", "sourceIds", "citations", body.alias("body"))
    made = library.generated_records(drafts, NOW)
    ids = drafts.select("draft_id", T.content_id("art", F.col("mode"), T.trim_all(F.col("title")), F.array_join("sourceIds", "\x1f"), F.sha2("body", 256)).alias("id"))
    return ids.join(made.dropDuplicates(["id"]), "id").select("draft_id", "id", "title", F.size("sourceIds").alias("n_sources"), F.col("body.contentHash").alias("content_hash"), F.col("body.byteLength").alias("n_bytes"))


def _plain_notes(s, d) -> DataFrame:
    w = table(s, d, "web_articles").where("body is not null")
    return w.select(F.col("sourceId").alias("id"), "title", F.concat(F.lit("note-"), F.regexp_replace("sourceId", "[^a-z0-9]+", "-")).alias("slug"), F.col("sourceUrl").alias("source"), "author", "date", "description", "body")


_JSON = "case when coalesce({c}, '') <> '' then '{c}: ' || to_json({c}) || chr(10) else '' end"
_NOTES_SQL = """n as (select "sourceId" as id, title, 'note-' || regexp_replace("sourceId", '[^a-z0-9]+', '-', 'g') as slug, "sourceUrl" as source, author, date, description, body from web_articles where body is not null)"""


@query(f"with {_NOTES_SQL} select id, sha256('---' || chr(10) || {' || '.join(_JSON.format(c=c) for c in ('title', 'slug', 'source', 'author', 'date', 'description'))} || '---' || chr(10) || chr(10) || body || chr(10)) as hash from n")
def plain_notes(s, d):
    """Pages as plain notes: the fields that have a value as JSON scalars, then the body."""
    return export.short_article(_plain_notes(s, d)).select("id", F.sha2("artifact", 256).alias("hash"))


@query(f"with {_NOTES_SQL} select id, slug, case when coalesce(title, '') <> '' then title else slug end as title from n")
def note_pages(s, d):
    """Slug and title of plain notes as read back from their frontmatter."""
    notes = export.short_article(_plain_notes(s, d))
    texts = notes.select("id", readers.article_slug(F.lit("stem"), F.col("artifact")).alias("slug"), F.col("artifact").alias("text"))
    return texts.join(readers.page_list(texts.select(F.col("id").alias("slug"), "text")).withColumnRenamed("slug", "id"), "id").select("id", "slug", F.when(F.col("title") == F.col("id"), F.col("slug")).otherwise(F.col("title")).alias("title"))


# --- fonts

_SAMPLES = """p as (select id, l[pos] as text, pos from (select "sourceId" as id, list_filter(list_transform(regexp_extract_all("cleanedHtml", '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: """ + _plain_sql("""replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&')""") + """), lambda x: x <> '') as l from web_articles), unnest(range(1, len(l) + 1)) t(pos))"""


@query(f"""with {_SAMPLES}, s as (select id, text, case when length(text) % 2 = 0 then 'main p' else 'body p' end as scope, case length(text) % 3 when 0 then 'Inter' else 'Georgia' end as font from p where length(text) >= 40),
r as (select *, case scope when 'main p' then 3 else 5 end as rank from s), b as (select *, min(rank) over (partition by id) as least from r)
select id, font as "fontFamily", length(text) as "textLength", k from (select *, row_number() over (partition by id order by length(text) desc, text, font) as k from b where rank = least) where k <= 20""")
def rendered_samples(s, d):
    """Samples of a page's paragraphs where none is expected: those in the narrowest scope that has any, the longest twenty."""
    p = table(s, d, "web_articles").select(F.col("sourceId").alias("id"), F.explode(fonts.paragraphs(F.col("cleanedHtml"))).alias("text"))
    n = F.length("text")
    placed = p.select("id", "text", F.when(n % 3 == 0, "Inter").otherwise("Georgia").alias("fontFamily"), F.array(F.when(n % 2 == 0, "main p").otherwise("body p")).alias("scopes"))
    from pyspark.sql import Window

    got = fonts.rendered_samples(placed, s.createDataFrame([], "id string, text string"))
    return got.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("textLength"), "fontFamily")).cast("long"))


# --- rules over altered records


def altered_articles(a: DataFrame) -> DataFrame:
    """Articles, six in eight with one fault each."""
    k = _k(8)
    return a.withColumns({
        "slug": F.when(k == 0, F.concat("slug", F.lit("_X"))).otherwise(F.col("slug")),
        "title": F.when(k == 1, F.lit(" ")).otherwise(F.col("title")),
        "sourceIds": F.when(k == 2, F.concat("sourceIds", "sourceIds")).when(k == 5, F.array().cast("array<string>")).when(k == 6, F.concat("sourceIds", F.array(F.lit("src_gone")))).otherwise(F.col("sourceIds")),
        "archiveVerification": F.when(k != 3, F.col("archiveVerification")),
        "generatedBy": F.when(k != 3, F.col("generatedBy")),
        "body": F.when(k == 4, F.col("body").withField("path", F.lit("../x"))).otherwise(F.col("body")),
    })


ALTERED = f"""altered as (select * replace (case when {_ksql(8)} = 0 then slug || '_X' else slug end as slug, case when {_ksql(8)} = 1 then ' ' else title end as title,
case {_ksql(8)} when 2 then list_concat("sourceIds", "sourceIds") when 5 then [] when 6 then list_append("sourceIds", 'src_gone') else "sourceIds" end as "sourceIds",
case when {_ksql(8)} <> 3 then "archiveVerification" end as "archiveVerification", case when {_ksql(8)} <> 3 then "generatedBy" end as "generatedBy",
case when {_ksql(8)} = 4 then struct_update(body, path := '../x') else body end as body) from (select * from articles group by all))"""


@query(
    f"""with {ALTERED}, v as (
select 'slug' as rule from altered where not coalesce(regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') and length(slug) <= 100, false)
union all select 'title' from altered where coalesce({_plain_sql('title')}, '') = ''
union all select 'sources' from altered where not coalesce(len("sourceIds") >= 1, false)
union all select 'unique sources' from altered where not coalesce(len("sourceIds") = len(list_distinct("sourceIds")), false)
union all select 'archive' from altered where mode = 'archive' and not ("archiveVerification" is not null and "generatedBy" is null and len("sourceIds") = 1)
union all select 'derived' from altered where mode <> 'archive' and not ("archiveVerification" is null and "generatedBy" is not null and coalesce(len(citations), 0) >= 1)
union all select 'body path' from altered where not coalesce(body.path = 'articles/' || mode || '/' || id || '/content.md', false))
select rule, count(*) as n from v group by rule"""
)
def article_violations(s, d):
    """Rules that altered articles break, with how many break each."""
    rules = {k: v for k, v in checks.article_rules().items() if k in ("slug", "title", "sources", "unique sources", "archive", "derived", "body path")}
    return checks.check(altered_articles(_articles(s, d)), rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def altered_sources(a: DataFrame) -> DataFrame:
    """Sources, seven in eight with one fault each."""
    k = _k(8)
    return a.withColumns({
        "kind": F.when(k == 0, F.lit("fax")).otherwise(F.col("kind")),
        "capturedAt": F.when(k == 1, F.lit("soon")).otherwise(F.col("capturedAt")),
        "publishedAt": F.when(k == 2, F.lit("x")).otherwise(F.col("publishedAt")),
        "origin": F.when(k == 3, F.col("origin").withField("locator", F.lit(""))).when(k == 4, F.col("origin").withField("canonicalUrl", F.lit(None).cast("string"))).otherwise(F.col("origin")),
        "content": F.when(k == 5, F.col("content").withField("contentHash", F.lit("sha256:x"))).otherwise(F.col("content")),
        "authors": F.when(k == 6, F.concat("authors", "authors")).otherwise(F.col("authors")),
    })


def altered_exports(a: DataFrame) -> DataFrame:
    """Exports, four in five with one fault each."""
    k = _k(5)
    return a.withColumns({
        "format": F.when(k == 0, F.lit("docx")).otherwise(F.col("format")),
        "destination": F.when(k == 1, F.col("destination").withField("type", F.lit(None).cast("string"))).when(k == 3, F.col("destination").withField("type", F.lit("kindle"))).otherwise(F.col("destination")),
        "artifact": F.when(k == 2, F.col("artifact").withField("path", F.lit("/x"))).otherwise(F.col("artifact")),
        "status": F.when(k == 3, F.lit("delivered")).otherwise(F.col("status")),
        "delivery": F.when(k != 3, F.col("delivery")),
    })


_HASHED = "regexp_matches({c}.contentHash, '^sha256:[a-f0-9]{{64}}$')"
_SAFE = "(not contains({p}, '\\') and not regexp_matches({p}, '^[A-Za-z]:') and len(list_filter(string_split({p}, '/'), lambda x: x in ('', '.', '..'))) = 0)"
_TEXT = _HASHED + " and regexp_matches({c}.textHash, '^sha256:[a-f0-9]{{64}}$') and " + _SAFE.replace("{p}", "{c}.path") + " and {c}.byteLength >= 0"
_RULES = {
    "source": {
        "schemaVersion": '"schemaVersion" = 1', "id": "regexp_matches(id, '^src_[a-z0-9]{16,64}$')", "kind": "kind in ('url', 'text', 'markdown', 'file')", "capturedAt": 'try_cast("capturedAt" as timestamptz) is not null',
        "publishedAt": '"publishedAt" is null or length("publishedAt") >= 4', "locator": "length(origin.locator) > 0", "canonicalUrl": "kind <> 'url' or origin.canonicalUrl is not null",
        "content": _TEXT.format(c="content") + " and content.path = 'sources/' || id || '/content.md'", "authors": "authors is null or len(authors) = len(list_distinct(authors)) + case when len(list_filter(authors, lambda x: x is null)) > 0 then 1 else 0 end",
    },
    "article": {
        "schemaVersion": '"schemaVersion" = 1', "id": "regexp_matches(id, '^art_[a-z0-9]{16,64}$')", "mode": "mode in ('archive', 'digest', 'synthesis')", "title": f"{_plain_sql('title')} <> ''", "slug": "regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') and length(slug) <= 100",
        "sources": 'len("sourceIds") >= 1', "unique sources": 'len("sourceIds") = len(list_distinct("sourceIds"))', "body": _TEXT.format(c="body"), "body path": "body.path = 'articles/' || mode || '/' || id || '/content.md'",
        "archive": """mode <> 'archive' or ("archiveVerification" is not null and "generatedBy" is null and len("sourceIds") = 1)""", "derived": """mode = 'archive' or ("archiveVerification" is null and "generatedBy" is not null and coalesce(len(citations), 0) >= 1)""",
        "citation ids": "citations is null or len(list_filter(citations, lambda c: not regexp_matches(c.id, '^cite_[a-z0-9][a-z0-9_-]{0,63}$'))) = 0", "unique citations": "citations is null or len(list_distinct(list_transform(citations, lambda c: c.id))) = len(citations)",
    },
    "export": {
        "schemaVersion": '"schemaVersion" = 1', "id": "regexp_matches(id, '^exp_[a-z0-9]{16,64}$')", "articleId": """regexp_matches("articleId", '^art_[a-z0-9]{16,64}$')""", "format": "format in ('markdown', 'html', 'pdf', 'epub')", "destination": "destination.type is not null",
        "artifact": "artifact is null or (" + _HASHED.format(c="artifact") + " and " + _SAFE.format(p="artifact.path") + ")",
        "delivered": "status <> 'delivered' or destination.type <> 'kindle' or (delivery.confirmedAt is not null and delivery.confirmationMethod is not null and delivery.deliveredAt is not null)",
    },
}
_ALTERED_ALL = f"""{ALTERED}, altered_sources as (select * replace (case when {_ksql(8)} = 0 then 'fax' else kind end as kind, case when {_ksql(8)} = 1 then 'soon' else "capturedAt" end as "capturedAt", case when {_ksql(8)} = 2 then 'x' else "publishedAt" end as "publishedAt",
case {_ksql(8)} when 3 then struct_update(origin, locator := '') when 4 then struct_update(origin, "canonicalUrl" := cast(null as varchar)) else origin end as origin, case when {_ksql(8)} = 5 then struct_update(content, "contentHash" := 'sha256:x') else content end as content,
case when {_ksql(8)} = 6 then list_concat(authors, authors) else authors end as authors) from (select distinct * from sources)),
altered_exports as (select * replace (case when {_ksql(5)} = 0 then 'docx' else format end as format, case {_ksql(5)} when 1 then struct_update(destination, type := cast(null as varchar)) when 3 then struct_update(destination, type := 'kindle') else destination end as destination,
case when {_ksql(5)} = 2 then struct_update(artifact, path := '/x') else artifact end as artifact, case when {_ksql(5)} = 3 then 'delivered' else status end as status, case when {_ksql(5)} <> 3 then delivery end as delivery) from (select distinct * from exports))"""


def _violations_sql(record: str, source: str) -> str:
    rules = ", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in _RULES[record].items())
    return f"select '{record}' as record, id, array_to_string(list_filter([{rules}], lambda x: x is not null), ',') as violations from {source}"


@query(f"with {_ALTERED_ALL} select * from ({_violations_sql('source', 'altered_sources')} union all {_violations_sql('article', 'altered')} union all {_violations_sql('export', 'altered_exports')}) where violations <> ''")
def schema_violations(s, d):
    """Records of all tables, most of them altered in store, that break a rule, with the rules broken."""
    parts = [(altered_sources(_sources(s, d)), checks.source_rules(), "source"), (altered_articles(_articles(s, d)), checks.article_rules(), "article"), (altered_exports(_exports(s, d)), checks.export_rules(), "export")]
    out = [checks.check(df, rules).where(F.size("violations") > 0).select(F.lit(k).alias("record"), "id", F.array_join("violations", ",").alias("violations")) for df, rules, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
