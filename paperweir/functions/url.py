"""URL cleaning and address checks."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that track readers, besides those that begin with utm_.
TRACKING = ("ascsubtag", "camp", "creative", "fbclid", "gclid", "igshid", "linkcode", "mc_cid", "mc_eid", "ref", "ref_src", "spm", "tag")
SCHEMES = ("http", "https", "mailto", "tel")
_PORTS = {"http": 80, "https": 443}
_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
_SAFE_PATH = "/%:@!$&'()*+,;=~-._|[]"


def clean_one(value: str | None, base: str | None) -> str:
    """One cleaned URL, '' where it is unusable; a mere fragment stays."""
    if not value:
        return ""
    if value.startswith("#"):
        return value
    value = value.strip()
    if not _SCHEME.match(value):
        if not base or not _SCHEME.match(base):
            return ""
        value = urljoin(base, value)
    try:
        u = urlsplit(value)
        port = u.port
    except ValueError:
        return ""
    scheme = u.scheme.lower()
    if scheme not in SCHEMES:
        return ""
    if scheme in ("mailto", "tel"):
        return f"{scheme}:{u.path}" + (f"?{u.query}" if u.query else "") + (f"#{u.fragment}" if u.fragment else "")
    host = (u.hostname or "").lower()
    if not host or re.search(r"[\s<>^|%]", host):
        return ""
    if ":" in host:
        host = f"[{host}]"
    user = u.netloc.rpartition("@")[0]
    netloc = (f"{user}@" if user else "") + host + (f":{port}" if port and port != _PORTS[scheme] else "")
    path = u.path or "/"
    if "/." in path:
        path = urlsplit(urljoin(f"{scheme}://{host}{path}", path)).path or "/"
    query = u.query
    pairs = parse_qsl(query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if not (k.lower().startswith("utm_") or k.lower() in TRACKING)]
    if len(kept) < len(pairs):  # a changed query is written anew as form data
        query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in kept)
    fragment = "" if u.fragment.lower().startswith(":~:text=") else u.fragment
    return urlunsplit((scheme, netloc, quote(path, safe=_SAFE_PATH), quote(query, safe="/%:@!$&()*+,;=~-._?|[]'"), quote(fragment, safe="/%:@!$&'()*+,;=~-._?|[]")))


@F.pandas_udf(T.StringType())
def clean_url(value: pd.Series, base: pd.Series) -> pd.Series:
    """value resolved against base, without tracking parameters and text fragments; '' where it is unusable."""
    seen: dict[tuple, str] = {}
    out = []
    for k in zip(value, base, strict=True):
        if k not in seen:
            seen[k] = clean_one(*k)
        out.append(seen[k])
    return pd.Series(out)


def strip_tracking(url: Column) -> Column:
    """clean_url for absolute URLs that are already normal, native: tracking parameters and text fragments cut."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    joined = F.array_join(kept, "&")
    return F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), F.when(F.lower(fragment).startswith("#:~:text="), "").otherwise(fragment))


def canonical_url(link: Column, page: Column) -> Column:
    """The page's cleaned canonical link, else its cleaned URL, else the URL."""
    return F.coalesce(F.nullif(clean_url(F.coalesce(link, page), page), F.lit("")), page)


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def is_private_address(c: Column) -> Column:
    """Whether an IP address must not be fetched from: private, local, reserved, or no address at all."""
    a = F.regexp_replace(F.lower(c), r"^\[|\]$", "")
    v4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
    mapped = F.regexp_extract(a, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    four = F.when(mapped != "", mapped).otherwise(a)
    o = [F.split(four, r"\.").getItem(i).try_cast("int") for i in range(3)]
    # Ranges of addresses that are private, local or reserved.
    private4 = (
        o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 100) & o[1].between(64, 127)) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & o[1].isin(0, 168)) | ((o[0] == 198) & (o[1].isin(18, 19) | ((o[1] == 51) & (o[2] == 100)))) | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    )
    v6 = a.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") | (mapped != "")
    private6 = a.isin("::", "::1") | a.rlike("^f[cd]") | a.rlike("^fe[89a-f]") | a.startswith("ff") | a.startswith("2001:db8") | a.startswith("::ffff:")
    return F.when(four.rlike(v4), private4).when(v6, private6).otherwise(F.lit(True))


def is_public_image_url(c: Column) -> Column:
    """http(s), no credentials, no local name, and no private literal address. Names are not looked up."""
    host = F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^\[|\]$", "")
    literal = host.rlike(r"^[0-9.]+$") | host.contains(":")
    return F.coalesce(is_http_url(c) & F.try_parse_url(c, F.lit("USERINFO")).isNull() & (host != "localhost") & ~host.endswith(".localhost") & ~(literal & is_private_address(host)), F.lit(False))


def encode_path(c: Column) -> Column:
    """Each part of a path percent-encoded."""
    one = lambda s: F.regexp_replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), "%(21|27|28|29|7E)", "%$1")
    coded = F.array_join(F.transform(F.split(c, "/"), one), "/")
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(sign))
    return coded


def open_uri(vault: Column, note: Column) -> Column:
    """URI that opens a note in the desktop application; null for a blank vault."""
    return F.when(F.trim(vault) != "", F.concat(F.lit("obsidian://open?vault="), F.url_encode(vault), F.lit("&file="), F.url_encode(note)))


def asset_stem_one(target: str) -> str:
    path = urlsplit(target).path if _SCHEME.match(target) else target
    name = re.sub(r"\.[^.]+$", "", unquote(path.rstrip("/").rpartition("/")[2]))
    return re.sub(r"^-+|-+$", "", re.sub(r"[^\w.-]+", "-", name))[:80] or "image"


@F.pandas_udf(T.StringType())
def asset_stem(target: pd.Series) -> pd.Series:
    """File stem for an image asset: decoded, other than letters, digits, . _ - as hyphens, 80 characters at most."""
    return target.map(lambda t: None if t is None else asset_stem_one(t))
