"""URL functions as column expressions (no Python in the executor path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that are never crawled.
BLOCKED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "css", "js", "json", "xml", "rss", "atom",
    "zip", "tar", "gz", "rar", "7z",
    "mp3", "mp4", "avi", "mov", "wmv", "flv",
    "woff", "woff2", "ttf", "eot",
)
_BLOCKED = r"\.(?:" + "|".join(BLOCKED_EXTENSIONS) + r")$"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_UNSAFE = "[^\\x21-\\x7e]|[\"<>`{}]"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def url_host(url: Column) -> Column:
    """Lower-cased host, null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query or fragment; an empty path reads as ``/``."""
    path = F.regexp_extract(url, _PATH, 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_site(link_host: Column, base_host: Column) -> Column:
    """Equal host, or a subdomain of the base host."""
    return (link_host == base_host) | F.endswith(link_host, F.concat(F.lit("."), base_host))


def crawlable_extension(url: Column) -> Column:
    return ~F.lower(url_path(url)).rlike(_BLOCKED)


def _percent_encode(text: Column) -> Column:
    """Percent-encode what may not stand in a path or query, character by character."""
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
            lambda ch: F.when(ch.rlike(_UNSAFE), F.regexp_replace(F.hex(ch), "(..)", "%$1")).otherwise(ch),
        ),
        "",
    )
    return F.when(text.rlike(_UNSAFE), encoded).otherwise(text)


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    resolved = F.concat(joined, F.when(joined == "/", F.lit("")).otherwise(tail))
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), resolved).otherwise(path)


def base_parts(base: Column) -> Column:
    """Pieces of a page URL that link resolution needs, computed once per page."""
    path = url_path(base)
    return F.struct(
        url_scheme(base).alias("scheme"),
        F.regexp_extract(base, _AUTHORITY, 1).alias("authority"),
        path.alias("path"),
        F.regexp_replace(path, r"[^/]*$", "").alias("folder"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )


def _join_all(hrefs: Column, base: Column) -> Column:
    """Resolve an array of hrefs. Each step is one ``transform`` over structs, so that a piece
    used several times later is worked out once."""
    refs = F.transform(hrefs, lambda h: F.regexp_replace(F.trim(F.regexp_replace(h, r"[\t\r\n]", "")), "#.*$", ""))
    kinds = F.transform(refs, lambda r: F.struct(
        r.alias("ref"), url_scheme(r).alias("scheme"), F.startswith(r, F.lit("//")).alias("network")))
    # own: the reference names its own host
    rooted = F.transform(kinds, lambda k: F.struct(
        F.when(k["scheme"] != "", k["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        ((k["scheme"] != "") | k["network"]).alias("own"),
        F.when(k["scheme"] != "", F.regexp_extract(k["ref"], _AUTHORITY, 1))
        .when(k["network"], F.regexp_extract(k["ref"], r"^//([^/?#]*)", 1))
        .otherwise(base["authority"]).alias("authority"),
        F.when(k["scheme"] != "", F.regexp_replace(k["ref"], r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""))
        .when(k["network"], F.regexp_replace(k["ref"], r"^//[^/?#]*", ""))
        .otherwise(k["ref"]).alias("rest"),
    ))
    split = F.transform(rooted, lambda r: F.struct(
        r["scheme"].alias("scheme"), r["own"].alias("own"),
        F.regexp_replace(F.lower(r["authority"]), F.when(r["scheme"] == "http", F.lit(":80$"))
                         .otherwise(F.lit(":443$")), "").alias("host"),
        F.substring_index(r["rest"], "?", 1).alias("path"),
        F.regexp_extract(r["rest"], r"(\?.*)$", 1).alias("query"),
        (r["rest"] == "").alias("bare"),
    ))
    pathed = F.transform(split, lambda s: F.struct(
        s["scheme"].alias("scheme"), s["host"].alias("host"),
        F.when(F.startswith(s["path"], F.lit("/")), s["path"])
        .when(s["own"], F.concat(F.lit("/"), s["path"]))
        .when(s["path"] == "", base["path"])
        .otherwise(F.concat(base["folder"], s["path"])).alias("path"),
        F.when(s["bare"] & ~s["own"], base["query"]).otherwise(s["query"]).alias("query"),
    ))
    resolved = F.transform(pathed, lambda p: F.struct(
        p["scheme"].alias("scheme"), p["host"].alias("host"), p["query"].alias("query"),
        _remove_dot_segments(p["path"]).alias("path")))
    return F.transform(resolved, lambda p: F.when(
        p["scheme"].isin("http", "https") & (p["host"] != ""),
        F.concat(p["scheme"], F.lit("://"), p["host"], _percent_encode(p["path"]), _percent_encode(p["query"]))))


def normalize_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base`` (made by :func:`base_parts`).

    Null unless http(s); the fragment is dropped, the query kept.
    """
    return F.get(_join_all(F.array(href), base), F.lit(0))


def resolve_links(hrefs: Column, base: Column, base_host: Column, allow_external: bool = False) -> Column:
    """Hrefs of one page → sorted distinct crawlable URLs. One row in, one row out: no shuffle."""
    urls = _join_all(F.array_distinct(hrefs), base)
    keep = [lambda u: u.isNotNull(), crawlable_extension]
    if not allow_external:
        keep.append(lambda u: same_site(url_host(u), base_host))
    kept = F.filter(urls, lambda u: reduce(lambda a, b: a & b, [test(u) for test in keep]))
    return F.array_sort(F.array_distinct(kept))
