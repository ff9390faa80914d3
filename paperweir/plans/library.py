"""Queries of the library, citation, export and vault operators, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.functions import url as U
from paperweir.operators import checks, citations, export, fonts, ingest, library, vault
from paperweir.session import materialise, spread, table

WS = T.WS
NOW = "2026-01-01T00:00:00.000Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _articles(s: SparkSession, d: str) -> DataFrame:
    return library.distinct_records(table(s, d, "articles"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    return library.distinct_records(table(s, d, "sources"))


def _exports(s: SparkSession, d: str) -> DataFrame:
    return library.distinct_records(table(s, d, "exports"))


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """(id, body): the Markdown of all articles: of archives that of the page they archive, where there is one; of derived
    articles notes that cite each of their citations."""
    pages = spread(table(s, d, "web_articles").select(F.col("sourceId").alias("source_id"), "body").where("body is not null"))
    archives = _articles(s, d).where("mode = 'archive'").select("id", F.col("sourceIds")[0].alias("source_id")).join(pages, "source_id").select("id", "body")
    notes = F.concat(F.lit("Notes"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit(" and [^"), c["id"], F.lit("]"))), ""))
    return archives.unionByName(_articles(s, d).where("mode <> 'archive'").select("id", notes.alias("body")))


BODIES_SQL = """bodies as (select a.id, w.body from (select distinct id, "sourceIds"[1] as sid from articles where mode = 'archive') a join web_articles w on w."sourceId" = a.sid where w.body is not null
union all select id, 'Notes' || coalesce(array_to_string(list_transform(citations, lambda c: ' and [^' || c.id || ']'), ''), '') from (select distinct id, citations from articles where mode <> 'archive'))"""


# Compatibility forms that SQL's strip_accents leaves as they are.
_COMPATIBLE = {"¹": "1", "²": "2", "³": "3", "¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "ª": "a", "º": "o", "™": "TM", "ﬁ": "fi", "ﬂ": "fl"}


def _slug_sql(c: str) -> str:
    plain = c
    for sign, letters in _COMPATIBLE.items():
        plain = f"replace({plain}, '{sign}', '{letters}')"
    plain = f"regexp_replace(regexp_replace(lower(strip_accents({plain})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(substr({plain}, 1, 80), ''), case when {c} is not null then 'article' end)"


def _plain_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


_MD_SQL = r"""regexp_replace(replace(replace(replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]{{}}()#+\-.!|])', '\\\1', 'g')"""
_ESC_HTML = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
_ESC_MD = r"trim(regexp_replace(regexp_replace({c}, '([\\`*_\[\]])', '\\\1', 'g'), '" + WS + r"+', ' ', 'g'))"


# --- text


@query(f"select doc_id, 'sha256:' || sha256({_plain_sql('text')}) as text_hash, strlen(text) as n_bytes from documents")
def normalize_hash(s, d):
    return table(s, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), T.byte_length(F.col("text")).alias("n_bytes"))


@query(f"select doc_id, sha256({_MD_SQL.format(c='text')}) as md_hash from documents")
def text_to_markdown(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(T.plain_text_to_markdown(F.col("text")), 256).alias("md_hash"))


@query(f"select id, slug, regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') and length(slug) <= 100 as safe from (select id, {_slug_sql('title')} as slug from (select distinct * from sources))")
def slugify_titles(s, d):
    return _sources(s, d).select("id", T.slugify(F.col("title")).alias("slug"), T.is_safe_slug(T.slugify(F.col("title"))).alias("safe"))


@query(r"""with a as (select distinct id, regexp_replace(slug, '(-[0-9]+)+$', '') as base, "createdAt" from articles), n as (select *, row_number() over (partition by base order by "createdAt" nulls first, id) as k from a)
select id, case when k = 1 then base else base || '-' || k end as slug from n""")
def slug_collisions(s, d):
    """Slugs as saving one article after the other would choose them, of bases without number."""
    return library.choose_slugs(_articles(s, d).select("id", F.regexp_replace("slug", "(-[0-9]+)+$", "").alias("base"), "createdAt").distinct())


@query("select slug, count(*) as n_articles from (select distinct id, slug from articles) group by slug having count(*) > 1")
def repeated_slugs(s, d):
    return _articles(s, d).groupBy("slug").agg(F.count("*").alias("n_articles")).where("n_articles > 1")


@query(f"select distinct id from (select id, {_slug_sql('title')} as slug from sources) where slug in (select slug from articles)")
def used_slugs(s, d):
    """Sources whose slug an article has already."""
    return checks.used_slugs(_sources(s, d).select("id", T.slugify(F.col("title")).alias("slug")), _articles(s, d)).select("id").distinct()


@query(
    r"""select id, case when strpos(e, '@') <= 1 then '[redacted]' else substr(e, 1, 1) || repeat('*', least(greatest(strpos(e, '@') - 2, 3), 8)) || '@kindle.com' end as redacted
from (select distinct id, slug || '@kindle.com' as e from articles)"""
)
def redact_emails(s, d):
    return _articles(s, d).select("id", T.redact_email(F.concat("slug", F.lit("@kindle.com"))).alias("redacted"))


@query(
    r"""select id, coalesce(nullif(regexp_replace(regexp_replace(slug, '(?i)[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'article') || '.epub' as file,
substr('Paperweir: ' || """
    + f"regexp_replace(regexp_replace(title, '[\\x00-\\x1f]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
    + r""", 1, 200) as subject,
nullif("""
    + f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[<>:\"/\\\\|?*\\x00-\\x1f]', '-', 'g'), '{WS}+', ' ', 'g'), '[. ]+$', ''), '^{WS}+|{WS}+$', '', 'g')"
    + r""", '') as note from (select distinct id, slug, title from articles)"""
)
def safe_names(s, d):
    a = _articles(s, d)
    return a.select("id", T.safe_filename(F.col("slug"), "epub").alias("file"), T.safe_subject(F.col("title"), "Paperweir").alias("subject"), T.sanitize_filename(F.col("title")).alias("note"))


@query(
    """select id, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KiB', b / 1024.0) else printf('%.1f MiB', b / 1048576.0) end as size
from (select distinct id, artifact.byteLength as b from exports)"""
)
def artifact_sizes(s, d):
    return _exports(s, d).select("id", T.format_bytes(F.col("artifact.byteLength")).alias("size"))


@query("select id, strftime(try_cast(\"createdAt\" as timestamp), '%Y-%m-%dT%H:%M:%SZ') as modified, substr(\"createdAt\", 1, 10) as day from (select distinct id, \"createdAt\" from articles)")
def modified_times(s, d):
    return _articles(s, d).select("id", T.modified_timestamp(F.col("createdAt")).alias("modified"), F.substring("createdAt", 1, 10).alias("day"))


# --- URLs


@query(
    r"""with u as (select "sourceId" as id, "inputUrl" as u, regexp_extract("inputUrl", '^[^?#]*\?([^#]*)', 1) as q, regexp_extract("inputUrl", '(#.*)$', 1) as f from web_articles),
k as (select id, u, f, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' and not starts_with(lower(string_split(p, '=')[1]), 'utm_') and not list_contains(['ascsubtag','camp','creative','fbclid','gclid','igshid','linkcode','mc_cid','mc_eid','ref','ref_src','spm','tag'], lower(string_split(p, '=')[1]))), '&') as k from u)
select id, regexp_extract(u, '^([^?#]*)', 1) || case when k <> '' then '?' || k else '' end || case when starts_with(lower(f), '#:~:text=') then '' else f end as url from k"""
)
def clean_urls(s, d):
    """Tracking parameters and text fragments cut from the URLs as entered, native."""
    return table(s, d, "web_articles").select(F.col("sourceId").alias("id"), U.strip_tracking(F.col("inputUrl")).alias("url"))


@query(
    r"""with l as (select "sourceId" as id, coalesce(nullif(replace(replace(regexp_extract("rawHtml", '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '&amp;', '&'), '&#x27;', chr(39)), ''), "inputUrl") as u from web_articles),
c as (select id, regexp_extract(u, '^([^?#]*)', 1) as b, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) as q, regexp_extract(u, '(#.*)$', 1) as f from l),
k as (select id, regexp_replace(lower(regexp_extract(b, '^([a-zA-Z]+://[^/]*)', 1)), ':(80|443)$', '') as host, coalesce(nullif(regexp_extract(b, '^[a-zA-Z]+://[^/]*(/.*)$', 1), ''), '/') as path, f,
array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' and not starts_with(lower(string_split(p, '=')[1]), 'utm_') and not list_contains(['ascsubtag','camp','creative','fbclid','gclid','igshid','linkcode','mc_cid','mc_eid','ref','ref_src','spm','tag'], lower(string_split(p, '=')[1]))), '&') as k from c)
select id, host || path || case when k <> '' then '?' || k else '' end || case when starts_with(lower(f), '#:~:text=') then '' else f end as url from k"""
)
def canonical_urls(s, d):
    """Canonical URL of each page: its cleaned link, else its cleaned URL."""
    link = F.nullif(F.regexp_extract("rawHtml", r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), F.lit(""))
    return table(s, d, "web_articles").select(F.col("sourceId").alias("id"), U.canonical_url(fonts.unescape(link), F.col("inputUrl")).alias("url"))


@query("""select id, coalesce(regexp_matches(origin.locator, '(?i)^https?://[^/?#]'), false) as is_http from (select distinct id, origin from sources)""")
def http_locators(s, d):
    return _sources(s, d).select("id", U.is_http_url(F.col("origin.locator")).alias("is_http"))


@query(
    """select event_id, o1 in (0, 10, 127) or o1 >= 224 or (o1 = 100 and o2 between 64 and 127) or (o1 = 169 and o2 = 254) or (o1 = 172 and o2 between 16 and 31) or (o1 = 192 and o2 in (0, 168))
or (o1 = 198 and (o2 in (18, 19) or (o2 = 51 and o3 = 100))) or (o1 = 203 and o2 = 0 and o3 = 113) as private from
(select event_id, event_id * 7 % 256 as o1, event_id * 11 % 256 as o2, event_id * 13 % 256 as o3 from events)"""
)
def private_addresses(s, d):
    """Addresses made of the event numbers, whether they are private."""
    o = [(F.col("event_id") * k % 256).cast("string") for k in (7, 11, 13)]
    return table(s, d, "events").select("event_id", U.is_private_address(F.concat_ws(".", *o, F.lit("9"))).alias("private"))


# --- pages


@query(
    """select id, pos - 1 as pos, l[pos] as href from (select "sourceId" as id, regexp_extract_all("cleanedHtml", '<a href="([^"]*)"', 1) as l from web_articles), unnest(range(1, len(l) + 1)) t(pos)"""
)
def page_links(s, d):
    links = F.regexp_extract_all("cleanedHtml", F.lit('<a href="([^"]*)"'), 1)
    return table(s, d, "web_articles").select(F.col("sourceId").alias("id"), F.posexplode(links).alias("pos", "href"))


_PARAGRAPHS = (
    r"""with p as (select id, pos, """
    + _plain_sql(r"replace(replace(replace(replace(replace(replace(replace(regexp_replace(l[pos], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")
    + r""" as t from (select "sourceId" as id, regexp_extract_all("cleanedHtml", '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) as l from web_articles), unnest(range(1, len(l) + 1)) x(pos))"""
)


@query(_PARAGRAPHS + " select id, n, t as paragraph from (select *, row_number() over (partition by id order by length(t) desc, pos) as n from p where length(t) >= 80) where n <= 12")
def top_paragraphs(s, d):
    t = table(s, d, "web_articles").select(F.col("sourceId").alias("id"), F.posexplode(fonts.top_paragraphs(F.col("cleanedHtml"))).alias("n", "paragraph"))
    return t.select("id", (F.col("n") + 1).cast("long").alias("n"), "paragraph")


@query(_PARAGRAPHS + " select id, string_agg(t, ' ' order by pos) as opening from (select *, row_number() over (partition by id order by pos) as n from p where t <> '') where n <= 3 group by id")
def opening_paragraphs(s, d):
    return table(s, d, "web_articles").select(F.col("sourceId").alias("id"), fonts.opening(F.col("cleanedHtml")).alias("opening")).where("opening <> ''")


def _compared(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '{WS}+', ' ', 'g'))"


@query(
    _PARAGRAPHS
    + f""", o as (select id, string_agg(t, ' ' order by pos) as opening from (select *, row_number() over (partition by id order by pos) as n from p where t <> '') where n <= 3 group by id)
select id, d <> '' and (o = d or starts_with(o, d || ' ')) as repeats, length(b) <= 240 and regexp_matches(b, '(?i)^by\\s+\\p{{L}}') as byline
from (select w."sourceId" as id, {_compared("coalesce(w.description, '')")} as d, {_compared("coalesce(o.opening, '')")} as o, {_plain_sql("coalesce(w.description, '')")} as b from web_articles w left join o on o.id = w."sourceId" where w."cleanedHtml" is not null)
union all select "sourceId", null, length({_plain_sql("coalesce(description, '')")}) <= 240 and regexp_matches({_plain_sql("coalesce(description, '')")}, '(?i)^by\\s+\\p{{L}}') from web_articles where "cleanedHtml" is null"""
)
def description_repeats(s, d):
    w = table(s, d, "web_articles")
    return w.select(F.col("sourceId").alias("id"), fonts.repeats_opening(F.col("description"), F.col("cleanedHtml")).alias("repeats"), T.is_byline(F.coalesce("description", F.lit(""))).alias("byline"))


@query(
    _PARAGRAPHS
    + ", q"
    + _PARAGRAPHS.removeprefix("with p").replace('"cleanedHtml"', '"readableContentHtml"')
    + """, e as (select distinct id, substr(t, 1, 160) as prefix from (select *, row_number() over (partition by id order by length(t) desc, pos) as n from q where length(t) >= 80) where n <= 12),
v as (select p.id, p.pos, coalesce(bool_or(contains(p.t, e.prefix)), false) as hit from p left join e on e.id = p.id where length(p.t) >= 40 group by p.id, p.pos),
a as (select *, bool_or(hit) over (partition by id) as found from v) select id, count(*) as n_paragraphs from a where hit or not found group by id"""
)
def expected_paragraphs(s, d):
    """Paragraphs of the extract that hold one of the page's longest, by their beginning."""
    w = table(s, d, "web_articles").select(F.col("sourceId").alias("id"), "cleanedHtml", "readableContentHtml")
    visible = w.select("id", F.explode(fonts.paragraphs(F.col("cleanedHtml"))).alias("text"))
    expected = w.select("id", F.explode(fonts.top_paragraphs(F.col("readableContentHtml"))).alias("text"))
    return fonts.expected_paragraphs(visible, expected).groupBy("id").agg(F.count("*").alias("n_paragraphs"))


_FAMILIES = ["Inter, sans-serif", "Georgia, serif", "'Times New Roman'", '"PT Sans"', "Unknown, monospace", "Noto Serif, sans-serif", "Helvetica", ""]


@query(
    """with f as (select id, length(title) % 8 as k, least(cast(content.byteLength as integer), 1000) as w, coalesce(origin.canonicalUrl, kind) as page from (select distinct id, title, content, origin, kind from sources) where title is not null),
v as (select page, sum(case when k in (0, 3, 6) then w else 0 end) as sans, sum(case when k in (1, 2, 5) then w else 0 end) as serif from f group by page)
select page, case when sans > serif then 'sans-serif' else 'serif' end as style from v"""
)
def font_vote(s, d):
    """Font style by page from one sample a source; the family of a sample is told by the length of its title."""
    f = F.array(*[F.lit(x) for x in _FAMILIES])
    x = _sources(s, d).where("title is not null").select(F.coalesce("origin.canonicalUrl", "kind").alias("id"), f[F.length("title") % 8].alias("fontFamily"), F.col("content.byteLength").cast("int").alias("textLength"))
    return fonts.vote(x).withColumnRenamed("id", "page")


def _unescaped(c: str) -> str:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "\'\'"), ("&#39;", "\'\'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    return c


def _meta_sql(attribute: str, value: str) -> str:
    return _plain_sql(_unescaped(f"""regexp_extract("rawHtml", '(?i)<meta[^>]*{attribute}="{value}"[^>]*content="([^"]*)"', 1)"""))


@query(f"""select "sourceId" as id, trim(regexp_replace({_meta_sql('property', 'og:title')}, '(&#[xX]?[0-9A-Fa-f]+;|[^\x01-\x7f])+', '', 'g')) as title, {_meta_sql('name', 'author')} as author, {_meta_sql('property', 'article:published_time')} as date from web_articles where "rawHtml" is not null""")
def page_metadata(s, d):
    """What the head of each raw page states, read from its tree; of titles the ASCII part, since SQL reads no numeric entities."""
    from paperweir.functions import articles, dom

    @F.pandas_udf("title string, author string, date string")
    def stated(pages: pd.Series) -> pd.DataFrame:
        keys = (("property", "og:title"), ("name", "author"), ("property", "article:published_time"))
        rows = [[articles._meta(tree, *k) for k in keys] for tree in map(dom.parse_html, pages)]
        return pd.DataFrame(rows, columns=["title", "author", "date"])

    w = spread(table(s, d, "web_articles").where("rawHtml is not null").select("sourceId", "rawHtml"))
    return w.select(F.col("sourceId").alias("id"), stated("rawHtml").alias("m")).select("id", F.trim(F.regexp_replace("m.title", r"[^\x01-\x7f]+", "")).alias("title"), "m.author", "m.date")


@query()
def page_articles(s, d):
    """Metadata, Markdown and text that extraction derives of each raw page, in one pass."""
    pages = table(s, d, "web_articles").select(F.col("inputUrl").alias("url"), F.col("rawHtml").alias("html"))
    e = ingest.extract_pages(pages)
    return e.select("input_url", "source_url", "title", "author", "date", "description", F.sha2("body", 256).alias("body_hash"), F.length("source_text").alias("n_chars"), F.length("cleaned_html").alias("n_html"))


@query()
def visible_text_hash(s, d):
    """Hash of the visible text of each cleaned page; numeric entities and stray tags need a parser, so SQL has no equal."""
    w = table(s, d, "web_articles").where("cleanedHtml is not null")
    return w.select(F.col("sourceId").alias("id"), F.sha2(export._visible(F.col("cleanedHtml")), 256).alias("text_hash"))


@query()
def html_to_markdown(s, d):
    from paperweir.functions.articles import markdown_from_html

    @F.pandas_udf(export.StringType())
    def md(h):
        return h.map(lambda x: None if x is None else markdown_from_html(x))

    return spread(table(s, d, "web_articles").select("sourceId", "cleanedHtml")).select(F.col("sourceId").alias("id"), F.sha2(md(F.col("cleanedHtml")), 256).alias("md_hash"))


_IMAGE = r'!\[[^\]]*\]\(\s*<?[^\s)>]+>?(?:\s+"[^"]*")?\s*\)'


@query(
    rf"""with lines as (select id, pos, l[pos] as line, (regexp_matches(l[pos], '^ {{0,3}}(```|~~~)'))::int as fence from (select "sourceId" as id, string_split(body, chr(10)) as l from web_articles where body is not null), unnest(range(1, len(l) + 1)) t(pos)),
placed as (select *, sum(fence) over (partition by id order by pos) as fences, coalesce(sum(length(line) + 1) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as off from lines),
m as (select id, off, regexp_extract_all(line, '{_IMAGE}') as m, regexp_split_to_array(line, '{_IMAGE}') as parts from placed where fences % 2 = 0 and fence = 0),
e as (select id, m[k] as hit, off + list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as base from m, unnest(range(1, len(m) + 1)) t(k))
select id, cast(base + strpos(hit, '](') + case when contains(hit, '](<') then 2 else 1 end as integer) as start, cast(base + strpos(hit, '](') + case when contains(hit, '](<') then 2 else 1 end + length(regexp_extract(hit, '\]\(<?([^\s)>]+)', 1)) as integer) as "end",
regexp_extract(hit, '\]\(<?([^\s)>]+)', 1) as target from e"""
)
def image_refs_outside_code(s, d):
    refs = F.explode(vault.image_references(F.col("body")))
    return table(s, d, "web_articles").where("body is not null").select(F.col("sourceId").alias("id"), refs.alias("r")).select("id", "r.start", "r.end", "r.target")


_IMAGES = r"""lines as (select id, pos, l[pos] as line, (regexp_matches(l[pos], '^ {0,3}(```|~~~)'))::int as fence from (select "sourceId" as id, string_split(body, chr(10)) as l from web_articles where body is not null), unnest(range(1, len(l) + 1)) t(pos)),
outside as (select id, pos, line from (select *, sum(fence) over (partition by id order by pos) as fences from lines) where fences % 2 = 0 and fence = 0),
found as (select id, pos, k, regexp_extract(m[k], '!\[[^\]]*\]\(\s*<?([^\s)>]+)', 1) as target from (select id, pos, regexp_extract_all(line, '!\[[^\]]*\]\(\s*<?[^\s)>]+>?(?:\s+"[^"]*")?\s*\)') as m from outside), unnest(range(1, len(m) + 1)) t(k)
union all select id, pos, 1000 + k, regexp_extract(m[k], '(?i)src\s*=\s*["'']([^"'']+)', 1) from (select id, pos, regexp_extract_all(line, '(?i)<img\b[^>]*\bsrc\s*=\s*["''][^"'']+["''][^>]*>') as m from outside), unnest(range(1, len(m) + 1)) t(k))"""


@query(f"""with {_IMAGES} select id as article_id, target, cast(row_number() over (partition by id order by first) as integer) as n from (select id, target, min(pos * 100000 + k) as first from found group by id, target)""")
def asset_numbering(s, d):
    """Images of each page outside fenced code, numbered by first appearance."""
    refs = table(s, d, "web_articles").where("body is not null").select(F.col("sourceId").alias("article_id"), F.explode(vault.image_references(F.col("body"))).alias("r"))
    return vault.number_assets(refs.select("article_id", "r.start", "r.target"))


@query(
    f"""with {_IMAGES}, f as (select id, target, row_number() over (partition by id order by first) as n from (select id, target, min(pos * 100000 + k) as first from found group by id, target)),
m as (select *, case ascii(right(target, 1)) % 3 when 0 then 'image/png' when 1 then 'image/tiff' end as media from f)
select id as article_id, n, case when media = 'image/png' then lpad(n::varchar, 3, '0') || '-' || coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(url_decode(regexp_extract(regexp_replace(regexp_replace(target, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)), '\\.[^.]+$', ''), '[^\\w.-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'image') || '.png' end as export_name,
case when media is null then 'not fetched' when media <> 'image/png' then 'unsupported media type' end as rejected from m"""
)
def planned_assets(s, d):
    """Files that the images of pages get in an export, where a third was fetched as PNG, a third in a form that is refused."""
    refs = table(s, d, "web_articles").where("body is not null").select(F.col("sourceId").alias("article_id"), F.explode(vault.image_references(F.col("body"))).alias("r")).select("article_id", "r.start", "r.target")
    k = F.ascii(F.right("target", F.lit(1))) % 3
    assets = refs.select("target").distinct().select("target", F.when(k == 0, "image/png").when(k == 1, "image/tiff").alias("mediaType"), F.lit("x").cast("binary").alias("contents")).where("mediaType is not null")
    plan = vault.plan_assets(refs, assets, refs.select("article_id", F.lit("s").alias("slug")).distinct())
    return plan.select("article_id", F.col("n").cast("long").alias("n"), F.when(F.col("rejected").isNull(), F.col("export_name")).alias("export_name"), "rejected")


# --- ingest and records


@query(f"select doc_id, 'sha256:' || sha256({_MD_SQL.format(c='text')}) as content_hash, 'sha256:' || sha256({_plain_sql('text')}) as text_hash from documents where text is not null and {_plain_sql('text')} <> ''")
def ingest_texts(s, d):
    """Documents captured as pasted text: those accepted, with their hashes. The label carries the id."""
    drafts = ingest.ingest_text(table(s, d, "documents").select("text", F.col("doc_id").cast("string").alias("label")))
    return drafts.where("rejected is null").select(F.col("locator").cast("long").alias("doc_id"), F.col("contentHash").alias("content_hash"), F.col("textHash").alias("text_hash"))


@query(
    f"""select reason, count(*) as n from (select case when text is null or {_plain_sql('text')} = '' then 'Cannot ingest empty markdown content'
when regexp_matches(text, '(?i)<\\s*/?\\s*(script|style|iframe|object|embed|form|input|button|svg|canvas|link|meta)\\b') or regexp_matches(text, '(?i)\\son[a-z]+\\s*=') or regexp_matches(text, '(?i)(?:href|src)\\s*=\\s*["'']?\\s*javascript:')
then 'Markdown contains unsafe raw HTML' else 'accepted' end as reason from documents) group by reason"""
)
def markdown_reasons(s, d):
    drafts = ingest.ingest_markdown(table(s, d, "documents").select(F.col("text").alias("markdown"), F.lit(None).cast("string").alias("label")))
    return drafts.groupBy(F.coalesce("rejected", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""with t as (select coalesce(title, 'Pasted text') as label, {_MD_SQL.format(c='text')} as md, {_plain_sql('text')} as plain from documents where text is not null and {_plain_sql('text')} <> ''),
s as (select distinct 'src_' || substr(sha256('text' || chr(31) || label || chr(31) || 'sha256:' || sha256(md)), 1, 32) as id, label, 'sha256:' || sha256(plain) as h from t)
select 'art_' || substr(sha256(id || chr(31) || 'archive'), 1, 32) as id, id as source_id, {_slug_sql('label')} as slug, h as text_hash, cast(null as varchar) as reason from (select id, any_value(label) as label, any_value(h) as h from s group by id)"""
)
def captured_library(s, d):
    """Documents through capture: text draft, source record, archive article, slug; and the check that text hashes agree."""
    drafts = ingest.ingest_text(table(s, d, "documents").select("text", F.coalesce("title", F.lit("Pasted text")).alias("label")))
    src = materialise(library.source_records(drafts, NOW).dropDuplicates(["id"]).drop("contentText"), "captured")
    arch = library.archive_records(src, NOW)
    ok = library.archive_fidelity(arch, src).select(F.col("article_id").alias("id"), "reason")
    return arch.join(ok, "id").select("id", F.col("sourceIds")[0].alias("source_id"), "slug", F.col("body.textHash").alias("text_hash"), "reason")


@query("""select "content"."contentHash" as content_hash, count(distinct id) as n_sources from sources group by 1 having count(distinct id) > 1""")
def duplicate_content(s, d):
    g = _sources(s, d).groupBy(F.col("content.contentHash").alias("content_hash")).agg(F.count_distinct("id").alias("n_sources"))
    return g.where("n_sources > 1")


@query(
    """with a as (select distinct id, sourceIds[1] as sid, body.textHash as b, archiveVerification.sourceId as vs, archiveVerification.sourceTextHash as vh from articles where mode = 'archive'),
s as (select distinct id, content.textHash as h from sources)
select a.id as article_id, a.sid as source_id, case when s.h is null then 'unknown source' when vs is distinct from sid then 'verification names another source' when vh is distinct from s.h or b is distinct from s.h then 'text hash mismatch' end as reason
from a left join s on s.id = a.sid"""
)
def archive_fidelity(s, d):
    return library.archive_fidelity(_articles(s, d), _sources(s, d))


@query(
    """with a as (select distinct id, sourceIds[1] as sid, body.textHash as b from articles where mode = 'archive'), s as (select distinct id, content.textHash as h from sources)
select a.id as article_id, s.id as source_id from a join s on s.id = a.sid where ascii(right(a.id, 1)) % 2 = 0"""
)
def archive_tampered(s, d):
    """Archives of which every second one was altered in store: those that the check names."""
    odd = F.ascii(F.right("id", F.lit(1))) % 2 == 0
    changed = _articles(s, d).withColumn("body", F.when(odd, F.col("body").withField("textHash", F.lit("sha256:0"))).otherwise(F.col("body")))
    return library.archive_fidelity(changed, _sources(s, d)).where("reason = 'text hash mismatch'").select("article_id", "source_id")


@query(
    r"""with r as (select slug, max("sourceIds"[1]) as sid, max(body.textHash) as h from articles where mode = 'archive' group by slug),
p as (select "sourceId" as sid, """
    + _plain_sql('"sourceText"')
    + """ as t from web_articles)
select slug, case when p.sid is null or t is null then 'fail' when 'sha256:' || sha256(t) = h then 'pass' else 'fail' end as status, case when p.sid is null or t is null then 'missing page' when 'sha256:' || sha256(t) <> h then 'text hash mismatch' end as reason,
case when 'sha256:' || sha256(t) = h then length(t) end as characters from r left join p on p.sid = r.sid"""
)
def fidelity_status(s, d):
    """Archives by slug against the text of the page they archive; of a slug that several archives share one row, whose
    source and hash are the greatest of theirs and need not belong together. fidelity_articles checks each archive."""
    a = _articles(s, d).where("mode = 'archive'").groupBy("slug").agg(F.max(F.col("sourceIds")[0]).alias("sid"), F.max(F.regexp_replace("body.textHash", "^sha256:", "")).alias("expected"))
    w = table(s, d, "web_articles").where("sourceText is not null").select(F.col("sourceId").alias("sid"), F.col("sourceText").alias("text"))
    return library.fidelity_status(a.select("slug", "expected"), a.join(w, "sid").select("slug", "text"))


@query(
    r"""with r as (select distinct id, slug, "sourceIds"[1] as sid, body.textHash as h from articles where mode = 'archive'),
p as (select "sourceId" as sid, """
    + _plain_sql('"sourceText"')
    + """ as t from web_articles where "sourceText" is not null)
select r.id as article_id, slug, case when h is null then 'skip' when t is null then 'fail' when 'sha256:' || sha256(t) = h then 'pass' else 'fail' end as status,
case when h is null then 'no source text hash' when t is null then 'missing page' when 'sha256:' || sha256(t) <> h then 'text hash mismatch' end as reason,
case when 'sha256:' || sha256(t) = h then length(t) end as characters from r left join p on p.sid = r.sid"""
)
def fidelity_articles(s, d):
    """Every archive against the text of the page it archives."""
    a = _articles(s, d).where("mode = 'archive'").select(F.col("id").alias("article_id"), "slug", F.col("sourceIds")[0].alias("sid"), F.regexp_replace("body.textHash", "^sha256:", "").alias("expected"))
    w = table(s, d, "web_articles").where("sourceText is not null").select(F.col("sourceId").alias("sid"), F.col("sourceText").alias("text"))
    return a.select("article_id", "slug").join(library.fidelity_status(a, a.join(w, "sid").select("article_id", "text"), "article_id"), "article_id")


# --- listing and joins


@query(
    """select id, mode, title, slug, "createdAt" from (select distinct id, mode, title, slug, "createdAt" from articles)
order by "createdAt" desc nulls last, case mode when 'archive' then 1 when 'digest' then 2 when 'synthesis' then 3 else 0 end, id limit 20"""
)
def library_list(s, d):
    return library.list_articles(table(s, d, "articles"))


@query("select mode, count(distinct id) as n_articles, min(\"createdAt\") as first, max(\"createdAt\") as last from articles group by mode")
def library_modes(s, d):
    return _articles(s, d).groupBy("mode").agg(F.count_distinct("id").alias("n_articles"), F.min("createdAt").alias("first"), F.max("createdAt").alias("last"))


@query(
    """with a as (select id, "sourceIds" as l from articles group by all), x as (select id as article_id, pos - 1 as pos, l[pos] as source_id from a, unnest(range(1, len(l) + 1)) t(pos)),
s as (select distinct id, title, origin.canonicalUrl as url from sources) select article_id, cast(pos as integer) as pos, source_id, s.title, s.url as "canonicalUrl", s.id is not null as found from x left join s on s.id = x.source_id"""
)
def articles_with_sources(s, d):
    return library.articles_with_sources(_articles(s, d), _sources(s, d)).select("article_id", "pos", "source_id", "title", "canonicalUrl", "found")


@query(
    """with a as (select id, "sourceIds" as l from articles group by all), x as (select id as article_id, pos, l[pos] as source_id from a, unnest(range(1, len(l) + 1)) t(pos)),
j as (select x.article_id, x.pos, s.* from x left join (select distinct id, authors, "publishedAt", origin.canonicalUrl as url from sources) s on s.id = x.source_id)
select article_id, coalesce(len(list_distinct(flatten(list(authors) filter (where authors is not null)))), 0) as n_authors, count(distinct "publishedAt") filter (where "publishedAt" <> '') as n_dates,
arg_min(url, pos) filter (where url is not null and url <> '') as "canonicalUrl" from j group by article_id"""
)
def article_source_facts(s, d):
    f = library.source_facts(library.articles_with_sources(_articles(s, d), _sources(s, d)))
    # an author that is null counts as none
    return f.select("article_id", F.size(F.array_compact("authors")).cast("long").alias("n_authors"), F.size("published").cast("long").alias("n_dates"), "canonicalUrl")


@query('select "articleId" as article_id, format, count(distinct id) as n_exports, max("createdAt") as last from exports group by 1, 2')
def exports_by_article(s, d):
    return _exports(s, d).groupBy(F.col("articleId").alias("article_id"), "format").agg(F.count_distinct("id").alias("n_exports"), F.max("createdAt").alias("last"))


@query("""select distinct e.id from (select id, case when ascii(right(id, 1)) % 5 = 0 then "articleId" || 'x' else "articleId" end as aid from exports) e where not exists (select 1 from articles a where a.id = e.aid)""")
def orphan_exports(s, d):
    """Exports of articles that are not there, a fifth of them altered in store."""
    altered = F.when(F.ascii(F.right("id", F.lit(1))) % 5 == 0, F.concat("articleId", F.lit("x"))).otherwise(F.col("articleId"))
    return _exports(s, d).withColumn("articleId", altered).join(_articles(s, d).select(F.col("id").alias("articleId")), "articleId", "left_anti").select("id").distinct()


@query(
    """select e.id as export_id, 'r*****@kindle.com' as recipient, 's***@mail.example' as sender, substr('Paperweir: ' || """
    + f"regexp_replace(regexp_replace(a.title, '[\\x00-\\x1f]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
    + """, 1, 200) as subject, coalesce(nullif(regexp_replace(regexp_replace(a.slug, '(?i)[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'article') || '.' || e.format as filename,
case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KiB', b / 1024.0) else printf('%.1f MiB', b / 1048576.0) end as size
from (select distinct id, "articleId", format, artifact.byteLength as b, "createdAt", status from exports) e join (select distinct id, title, slug from articles) a on a.id = e."articleId" """
)
def delivery_previews(s, d):
    return export.delivery_preview(_exports(s, d), _articles(s, d), "reader@kindle.com", "sndr@mail.example")


# --- citations

_C = """c as (select a.id as article_id, pos as n, l[pos].id as id, l[pos]."sourceId" as source_id, l[pos].locator.heading as heading, l[pos].quote as quote, sids from (select id, citations as l, "sourceIds" as sids from articles group by all) a, unnest(range(1, len(l) + 1)) t(pos)),
s as (select distinct id, title, origin.canonicalUrl as url, origin.locator as loc from sources)"""


_CA = _C.replace("from (select id, citations as l", """from (select id, case ascii(right(id, 1)) % 8 when 0 then list_transform(citations, lambda c: struct_update(c, "sourceId" := 'src_gone')) when 1 then list_concat(citations, citations) else citations end as l""")


def _altered_citations(s, d):
    """Articles, a quarter of those that cite with citations of a source that is not there, or with each citation twice."""
    k = F.ascii(F.right("id", F.lit(1))) % 8
    gone = F.transform("citations", lambda c: c.withField("sourceId", F.lit("src_gone")))
    return _articles(s, d).withColumn("citations", F.when(k == 0, gone).when(k == 1, F.concat("citations", "citations")).otherwise(F.col("citations")))


@query(
    f"""with {_CA} select article_id, id, source_id, 'source outside the article' as problem from c where not coalesce(list_contains(sids, source_id), false)
union all select article_id, id, source_id, 'unknown source' from c where source_id not in (select id from s)
union all select article_id, id, min(source_id), 'duplicate id' from c group by article_id, id having count(*) > 1"""
)
def orphan_citations(s, d):
    return citations.orphan_citations(_altered_citations(s, d), _sources(s, d).select("id").distinct())


@query("""select distinct a.id as article_id, x as source_id from (select id, unnest(case when ascii(right(id, 1)) % 8 = 6 then list_append("sourceIds", 'src_gone') else "sourceIds" end) as x from articles) a where x not in (select id from sources where id is not null)""")
def missing_sources(s, d):
    """Sources that articles name and that are not there, an eighth of the articles altered in store."""
    ids = F.when(F.ascii(F.right("id", F.lit(1))) % 8 == 6, F.concat("sourceIds", F.array(F.lit("src_gone")))).otherwise(F.col("sourceIds"))
    return citations.missing_sources(_articles(s, d).withColumn("sourceIds", ids), _sources(s, d))


@query(
    f"""with {_C}, d as (select distinct id as article_id from articles where mode <> 'archive') select article_id, id as cite_id, 'not in the body' as problem from c where n = 1 and article_id in (select article_id from d)
union all select article_id, 'cite_zz9', 'unknown citation' from d"""
)
def citation_marker_audit(s, d):
    """Citations of derived articles against notes that leave out the first one and cite one that is not listed."""
    a = _articles(s, d).where("mode <> 'archive'")
    kept = F.slice("citations", F.lit(2), F.greatest(F.size("citations") - 1, F.lit(0)))
    notes = F.concat(F.lit("Notes"), F.coalesce(F.array_join(F.transform(kept, lambda c: F.concat(F.lit(" and [^"), c["id"], F.lit("]"))), ""), F.lit("")), F.lit(" but [^cite_zz9]"))
    bodies = a.select(F.col("id").alias("article_id"), notes.alias("body"))
    return citations.marker_audit(bodies, citations.citations_of(a).select("article_id", "id"))


@query(r"""select doc_id, len(list_filter(regexp_extract_all(text, '(?i)\[\^(cite_[a-z0-9][a-z0-9_-]{0,63})\]:?'), lambda x: not ends_with(x, ':'))) > 0 as marked, regexp_matches(text, '(?i)\[\^cite_[a-z0-9_-]+\]:') as defines from documents where text is not null""")
def citation_markers(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", (F.size(citations.markers(F.col("text"))) > 0).alias("marked"), F.col("text").rlike(citations.DEFINITION).alias("defines"))


@query(
    f"""with {_C}, w as (select "sourceId" as sid, {_plain_sql('"sourceText"')} as t from web_articles)
select article_id, c.id, source_id, coalesce(contains(w.t, {_plain_sql('quote')}), false) as found from c left join w on w.sid = c.source_id where quote is not null"""
)
def citation_quotes(s, d):
    """Whether each quote stands in the text of its source."""
    q = citations.citations_of(_articles(s, d)).where("quote is not null").select("article_id", "id", "source_id", "quote")
    return citations.quotes_in_sources(q, table(s, d, "web_articles").select(F.col("sourceId").alias("source_id"), F.col("sourceText").alias("text")))


_LABEL = "coalesce(nullif(s.title, ''), nullif(s.url, ''), s.loc)"


@query(
    f"""with {_C} select article_id, string_agg('[^' || c.id || ']: ' || case when coalesce(s.url, '') <> '' then '[' || {_ESC_MD.replace("{c}", _LABEL)} || '](' || s.url || ')' else {_ESC_MD.replace("{c}", _LABEL)} end
|| case when coalesce(heading, '') <> '' then ', ' || {_ESC_MD.replace("{c}", 'heading')} else '' end || case when coalesce(quote, '') <> '' then ' — “' || {_ESC_MD.replace("{c}", 'quote')} || '”' else '' end, chr(10) order by n) as definitions
from c join s on s.id = c.source_id group by article_id"""
)
def markdown_footnotes(s, d):
    return citations.footnotes(_articles(s, d), _sources(s, d))


@query(
    f"""with {_C} select article_id, '<section class="article-citations"><h2>Sources</h2><ol>' || string_agg('<li id="' || c.id || '"><span>[' || n || '] ' || case when coalesce(s.url, '') <> '' then '<a href="' || {_ESC_HTML.replace("{c}", 's.url')} || '">' || {_ESC_HTML.replace("{c}", _LABEL)} || '</a>' else {_ESC_HTML.replace("{c}", _LABEL)} end
|| case when coalesce(heading, '') <> '' then ', ' || {_ESC_HTML.replace("{c}", 'heading')} else '' end || '</span>' || case when coalesce(quote, '') <> '' then '<blockquote>' || {_ESC_HTML.replace("{c}", 'quote')} || '</blockquote>' else '' end || '</li>', '' order by n) || '</ol></section>' as section
from c join s on s.id = c.source_id group by article_id"""
)
def html_citation_list(s, d):
    return citations.citation_section(_articles(s, d), _sources(s, d))


# --- frontmatter, vault, artifacts


def _with_facts(s, d):
    a = _articles(s, d)
    f = library.source_facts(library.articles_with_sources(a, _sources(s, d))).withColumnRenamed("authors", "sourceAuthors").withColumnRenamed("article_id", "id")
    return a.join(f, "id")


_ORDERED = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_FRONT = (
    """a as (select distinct * from articles), x as (select id as aid, pos, sid from (select distinct id, "sourceIds" as l from articles), unnest(range(1, len(l) + 1)) t(pos), lateral (select l[pos] as sid)),
j as (select x.aid, x.pos, s.* from x left join (select distinct id, authors, "publishedAt", origin.canonicalUrl as url from sources) s on s.id = x.sid),
g as (select aid, coalesce(flatten(list(authors order by pos) filter (where authors is not null)), []) as au, coalesce(list("publishedAt" order by pos) filter (where "publishedAt" <> ''), []) as pu, coalesce(list(url order by pos) filter (where url <> ''), []) as urls from j group by aid),
h as (select a.id, a.title, a.slug, a.mode, a."createdAt", a."sourceIds", a."generatedBy" as gb, coalesce(a.authors, """
    + _ORDERED.format(l="au")
    + """) as authors, """
    + _ORDERED.format(l="pu")
    + """ as published, urls from a join g on g.aid = a.id),
front as (select id, mode, title, '---' || chr(10) || array_to_string(list_filter([
'"articleId": ' || to_json(id), '"mode": ' || to_json(mode), '"title": ' || coalesce(cast(to_json(title) as varchar), ''), '"slug": ' || coalesce(cast(to_json(slug) as varchar), ''), case when len(urls) > 0 then '"canonicalUrl": ' || to_json(urls[1]) end, '"sourceIds": ' || to_json("sourceIds"),
case when len(urls) > 0 then '"sourceUrls": ' || to_json(urls) end, case when len(authors) > 0 then '"authors": ' || to_json(authors) end, '"createdAt": ' || coalesce(cast(to_json("createdAt") as varchar), ''),
case when len(published) = 1 then '"publishedAt": ' || to_json(published[1]) when len(published) > 1 then '"publishedAt": ' || to_json(published) end,
case when gb is not null then '"generatedBy": ' || to_json(concat_ws('/', gb.provider, gb.model)) end, '"tags": ["reading","archive"]'], lambda y: y is not null), chr(10)) || chr(10) || '---' || chr(10) || chr(10) as frontmatter from h)"""
)


@query(f"with {_FRONT} select id, frontmatter from front")
def frontmatter_render(s, d):
    return vault.frontmatter(_with_facts(s, d), ("reading", "#archive"))


@query("""select id, title, slug, mode, "createdAt" as created from (select distinct id, title, slug, mode, "createdAt", "sourceIds" from articles) where len("sourceIds") > 0""")
def frontmatter_round_trip(s, d):
    """Frontmatter rendered and parsed again."""
    m = vault.frontmatter(_with_facts(s, d)).select(vault.parse_frontmatter(F.col("frontmatter")).alias("m"))
    of = lambda k: F.col("m").getItem(f'"{k}"')  # noqa: E731  # keys are kept as written, with their quotes
    return m.select(of("articleId").alias("id"), of("title").alias("title"), of("slug").alias("slug"), of("mode").alias("mode"), of("createdAt").alias("created"))


@query(f"""with {_FRONT} select 'notes/' || id || '.md' as path, case mode when 'archive' then 'unchanged' when 'digest' then 'conflict' else 'missing' end as status from front""")
def vault_diff(s, d):
    """Frontmatter of all notes against a vault that has those of archives, and those of digests edited since."""
    a = _with_facts(s, d)
    notes = vault.frontmatter(a, ("reading", "#archive")).join(a.select("id", "mode"), "id").select(F.concat(F.lit("notes/"), "id", F.lit(".md")).alias("path"), F.col("frontmatter").alias("contents"), "mode")
    there = notes.where("mode in ('archive', 'digest')").select("path", F.when(F.col("mode") == "digest", F.concat("contents", F.lit("!"))).otherwise(F.col("contents")).alias("contents"))
    return vault.diff(notes.select("path", "contents"), there)


_NOTE_NAME = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(substr("createdAt", 1, 10), '') || ' ' || coalesce(title, '') || ' (' || mode || ')', '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '"""
    + WS
    + r"""+', ' ', 'g'), '[. ]+$', ''), '^"""
    + f"{WS}+|{WS}+$', '', 'g')"
)


@query(f'select id, {_NOTE_NAME} as note from (select distinct id, title, mode, "createdAt" from articles)')
def note_names(s, d):
    return _articles(s, d).select("id", vault.note_name("{{date}} {{title}} ({{ mode }})").alias("note")).distinct()


_DEFINITIONS = f"""definitions as (select article_id, string_agg('[^' || c.id || ']: ' || case when coalesce(s.url, '') <> '' then '[' || {_ESC_MD.replace("{c}", "coalesce(nullif(s.title, ''), nullif(s.url, ''), s.loc)")} || '](' || s.url || ')' else {_ESC_MD.replace("{c}", "coalesce(nullif(s.title, ''), nullif(s.url, ''), s.loc)")} end
|| case when coalesce(heading, '') <> '' then ', ' || {_ESC_MD.replace("{c}", 'heading')} else '' end || case when coalesce(quote, '') <> '' then ' — “' || {_ESC_MD.replace("{c}", 'quote')} || '”' else '' end, chr(10) order by n) as definitions
from c join s on s.id = c.source_id group by article_id)"""
_TRIMMED_BODY = f"regexp_replace(b.body, '^{WS}+|{WS}+$', '', 'g') || case when f.definitions is not null then chr(10) || chr(10) || f.definitions || chr(10) else chr(10) end"


@query(
    f"""with {_C}, {_DEFINITIONS}, {BODIES_SQL}, x as (select a.id, '---' || chr(10) || 'articleId: ' || to_json(a.id) || chr(10) || 'mode: ' || to_json(a.mode) || chr(10) || 'title: ' || coalesce(cast(to_json(a.title) as varchar), '') || chr(10) || 'slug: ' || coalesce(cast(to_json(a.slug) as varchar), '') || chr(10) || 'sources: ' || to_json(a."sourceIds") || chr(10) || '---' || chr(10)
|| {_TRIMMED_BODY} as t from (select distinct id, mode, title, slug, "sourceIds" from articles) a join bodies b on b.id = a.id left join definitions f on f.article_id = a.id)
select id as "articleId", 'exp_' || substr(sha256(id || chr(31) || 'markdown' || chr(31) || sha256(t)), 1, 32) as id, 'sha256:' || sha256(t) as hash, strlen(t) as n_bytes from x"""
)
def markdown_exports(s, d):
    """Markdown artifacts of all articles with a body, archives and those that cite, and their export records."""
    a = _articles(s, d)
    return export.export_records(export.markdown_export(a, _bodies(s, d), _sources(s, d)), "markdown", NOW).select("articleId", "id", F.col("artifact.contentHash").alias("hash"), F.col("artifact.byteLength").alias("n_bytes"))


@query(
    f"""with {_C}, {_DEFINITIONS}, {BODIES_SQL}, {_FRONT}, notes as (select r.id, 'inbox/' || m.note || '.md' as path, r.frontmatter || {_TRIMMED_BODY} as t
from front r join (select id, {_NOTE_NAME} as note from (select distinct id, title, mode, "createdAt" from articles)) m on m.id = r.id join bodies b on b.id = r.id left join definitions f on f.article_id = r.id)
select id as article_id, path, 'exp_' || substr(sha256(id || chr(31) || 'vault' || chr(31) || sha256(t)), 1, 32) as export_id, 'sha256:' || sha256(t) as hash from notes"""
)
def vault_notes(s, d):
    """Notes of a vault export, frontmatter, body and footnotes together, and the identity of their export records; no image was fetched."""
    a = _with_facts(s, d)
    notes = export.markdown_export(a, _bodies(s, d), _sources(s, d), with_metadata=False).withColumnRenamed("artifact", "body")
    none = s.createDataFrame([], "target string, mediaType string, contents binary")
    planned = vault.plan_notes(a, notes, none, "inbox", "{{date}} {{title}} ({{ mode }})", ("reading", "#archive"))
    return vault.delivered(planned, "vault", "inbox", NOW).select(F.col("articleId").alias("article_id"), F.col("destination.notePath").alias("path"), F.col("id").alias("export_id"), F.col("artifact.contentHash").alias("hash"))


def _esc(c: str) -> str:
    return _ESC_HTML.replace("{c}", c)


@query(
    f"""with {BODIES_SQL}, l as (select a.id, string_agg(case when coalesce(s.url, '') <> '' then '<a href="' || {_esc('s.url')} || '">' || {_esc("coalesce(nullif(s.title, ''), nullif(s.url, ''), s.loc)")} || '</a>' else {_esc("coalesce(nullif(s.title, ''), nullif(s.url, ''), s.loc)")} end, ' · ' order by pos) as links
from (select distinct id, "sourceIds" as sids from articles) a, unnest(range(1, len(sids) + 1)) t(pos) join (select distinct id, title, origin.canonicalUrl as url, origin.locator as loc from sources) s on s.id = a.sids[pos] group by a.id)
select a.id, sha256('<!doctype html>' || chr(10) || '<html lang="' || {_esc("coalesce(language, 'en')")} || '">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<meta name="viewport" content="width=device-width, initial-scale=1">' || chr(10) || '<title>' || {_esc('a.title')} || '</title>' || chr(10)
|| '<style>{export.STYLE.replace("'", "''")}</style>' || chr(10) || '</head>' || chr(10) || '<body data-font-style="' || coalesce(presentation.sourceFontStyle, 'serif') || '" data-image-sizing="' || case when coalesce(presentation.imageScalePercent, 100) < 100 then 'scaled' else 'default' end
|| '" style="--article-image-max-width: ' || coalesce(presentation.imageScalePercent, 100) || '%">' || chr(10) || '<article class="article-shell">' || chr(10) || '<header class="article-header">' || chr(10) || '<h1 class="article-title">' || {_esc('a.title')} || '</h1>' || chr(10)
|| case when coalesce(description, '') <> '' then '<p class="article-description">' || {_esc('description')} || '</p>' || chr(10) else '' end || case when coalesce(array_to_string(authors, ', '), '') <> '' then '<p class="article-meta">' || {_esc("array_to_string(authors, ', ')")} || '</p>' || chr(10) else '' end
|| case when coalesce(links, '') <> '' then '<p class="article-source">Sources: ' || links || '</p>' || chr(10) else '' end || '</header>' || chr(10)) as head_hash, cast(case when mode = 'archive' then 0 else coalesce(len(citations), 0) end as integer) as n_markers
from (select distinct * from articles) a join bodies b on b.id = a.id left join l on l.id = a.id where a.title is not null"""
)
def html_exports(s, d):
    """HTML artifacts of all articles with a body: what stands before it, and how many numbered markers it has."""
    a = _articles(s, d).where("title is not null")
    x = export.html_export(a, _bodies(s, d), _sources(s, d))
    return x.select("id", F.sha2(F.substring_index("artifact", '<main class="article-body">', 1), 256).alias("head_hash"), F.regexp_count("artifact", F.lit('<sup class="article-citation">')).alias("n_markers"))


@query(f"with {BODIES_SQL} select a.id, ascii(right(a.id, 1)) % 4 <> 0 as valid, case when ascii(right(a.id, 1)) % 4 = 0 then 0 else 3 end as \"manifestItems\", case when ascii(right(a.id, 1)) % 4 = 0 then 0 else 1 end as \"spineItems\", case when ascii(right(a.id, 1)) % 4 = 0 then 0 else 6 end as n_files from (select distinct id from articles) a join bodies b on b.id = a.id")
def epub_validate(s, d):
    """Packages of all articles with a body, a quarter of them cut short in store: those that are valid, and what they hold."""
    cut = F.when(F.ascii(F.right("id", F.lit(1))) % 4 == 0, F.substring("epub", F.lit(1), F.octet_length("epub").cast("int") - 400)).otherwise(F.col("epub"))
    e = export.validate_epub(export.epub_export(_articles(s, d), _bodies(s, d), _sources(s, d)).select("id", cut.alias("epub")))
    return e.select("id", F.col("problem").isNull().alias("valid"), "manifestItems", "spineItems", F.size("files").alias("n_files"))


# --- checks


_TWICE = "select '{k}' as record, id, count(*) as n from (select * from {t} group by all union select * replace ({c} || '!' as {c}) from {t} where ascii(right(id, 1)) % 5 = 0 and {c} is not null) group by id having count(*) > 1"


@query(" union all ".join(_TWICE.format(k=k, t=t, c=c) for k, t, c in (("source", "sources", "title"), ("article", "articles", "title"), ("export", "exports", "status"))))
def duplicate_ids(s, d):
    """Ids that several differing records have, where a fifth of the records was stored again with a change."""
    out = []
    for t, k, c in (("sources", "source", "title"), ("articles", "article", "title"), ("exports", "export", "status")):
        df = table(s, d, t)
        again = df.where((F.ascii(F.right("id", F.lit(1))) % 5 == 0) & F.col(c).isNotNull()).withColumn(c, F.concat(c, F.lit("!")))
        out.append(checks.duplicate_ids(df.unionByName(again)).select(F.lit(k).alias("record"), "id", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])
