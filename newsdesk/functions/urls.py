"""Canonical forms of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "share", "share_token", "fbclid", "gclid")
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _encode(c: Column) -> Column:
    """Form encoding: ~ stays and * is escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def resolve(url: Column, base: Column) -> Column:
    """url as seen from base: absolute, //host, /path, ?query and relative paths."""
    scheme, host, path = (F.regexp_extract(base, PARTS, k) for k in (1, 2, 3))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?") | (url == ""), F.concat(root, path, url))
        .otherwise(F.concat(root, folder, url))
    )


def canonicalize_url(url: Column, base: Column | None = None) -> Column:
    """https, lower-case host without a leading m., no tracking or blank parameters, no fragment, no trailing slash."""
    u = F.trim(F.coalesce(url, F.lit("")))
    if base is not None:
        u = resolve(u, base)
    u = F.replace(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    scheme, host, path, query = (F.regexp_extract(u, PARTS, k) for k in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    scheme = F.when(scheme.isin("http", "https"), "https").otherwise(scheme)
    host = F.lower(host)
    host = F.when(host.startswith("m.") & ~F.contains(host, F.lit("github.com")), F.substring(host, 3, 1 << 20)).otherwise(host)
    # parameters of the last path segment go
    path = F.regexp_replace(path, r";[^/;]*(?:;[^/]*)?$", "")
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.lit(1 << 20))).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(*TRACKING))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def article_key_url(url: Column) -> Column:
    """/share/article/<id> and /detail/<id> name the same article of one site."""
    key = F.regexp_extract(url, r"/(?:share/article|detail)/(\d+)", 1)
    return F.when(key != "", F.concat(F.lit("https://www.cls.cn/detail/"), key)).otherwise(url)
