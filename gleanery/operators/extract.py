"""Light page extraction: regular expressions only, so it stays JVM-side and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import media, text, urls

# Elements that separate text.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "dd", "details", "dialog", "div", "dl", "dt",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "tfoot", "ul",
)
_ALSO_SEPARATE = ("br", "tr", "td", "th", "title", "option")
_BLOCK = r"(?i)</?(?:" + "|".join(BLOCK_TAGS + _ALSO_SEPARATE) + r")(?:[^a-z0-9>][^>]*)?>"

_BODY = r"(?is)<{0}(?:[^a-z0-9>][^>]*)?>.*?(?:</{0}[^>]*(?:>|\z)|\z)"
_HREF = r"""(?i)href=[ \t\r\n\f]*("[^"]*"|'[^']*')"""
# A tag ends at the first ">" outside a quoted value.
_META_TAG = r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_META_NAMES = ("description", "og:description")


def strip_html(html: Column, max_chars: int | None = None, glue: bool = False) -> Column:
    """Visible text of a page, whole unless ``max_chars`` is given. ``glue=True`` joins text across tags with no space."""
    body = F.regexp_replace(html, _BODY.format("script"), "")
    body = F.regexp_replace(body, _BODY.format("style"), "")
    if not glue:
        body = F.regexp_replace(body, _BLOCK, " ")
    body = F.regexp_replace(body, r"<[^>]*(?:>|\z)", "")
    flat = text.collapse_space(body)
    return text.trim_space(flat if max_chars is None else F.substring(flat, 1, max_chars))


def title_light(html: Column) -> Column:
    """Text of the first title element; null when missing or blank."""
    return text.blank_to_null(text.trim_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)))


def meta_description(html: Column) -> Column:
    """The first description of a meta element that is not empty, whatever the order of its attributes."""
    tags = F.regexp_extract_all(html, F.lit(_META_TAG), F.lit(0))
    named = F.filter(tags, lambda t: F.lower(F.coalesce(
        text.blank_to_null(attribute(t, "name")), attribute(t, "property"))).isin(*_META_NAMES))
    values = F.filter(F.transform(named, lambda t: attribute(t, "content")), lambda v: v != "")
    return text.trim_space(F.get(values, F.lit(0)))


def attribute(tag: Column, name: str) -> Column:
    """The value of one attribute of a tag, ended by its own kind of quote; empty when it has none."""
    quoted = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


def hrefs_light(html: Column) -> Column:
    """All quoted href values, of any element."""
    quoted = F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))
    values = F.transform(quoted, lambda q: F.substring(q, 2, F.length(q) - 2))
    return F.filter(values, lambda v: v != "")


def links_light(df: DataFrame, allow_external: bool = False, html: str = "html", url: str = "url",
                out: str = "outgoing_links") -> DataFrame:
    """Adds the sorted distinct crawlable links of each page."""
    return (
        df.withColumn("__base", urls.base_parts(F.col(url)))
        .withColumn("__host", urls.url_host(F.col(url)))
        .withColumn(out, urls.resolve_links(hrefs_light(F.col(html)), F.col("__base"), F.col("__host"),
                                            allow_external))
        .drop("__base", "__host")
    )


def extract_pages(df: DataFrame, lightweight: bool = True, allow_external: bool = False,
                  glue: bool = False) -> DataFrame:
    """(page_id, url, html) → (page_id, url, title, description, content, outgoing_links)."""
    if not lightweight:
        from gleanery.operators.dom import extract_pages_dom

        return extract_pages_dom(df, allow_external)
    return links_light(df, allow_external).select(
        "page_id", "url",
        title_light(F.col("html")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        strip_html(F.col("html"), glue=glue).alias("content"),
        "outgoing_links",
    )


def link_edges(extracted: DataFrame) -> DataFrame:
    """One row per (src_url, dst_url)."""
    return extracted.select(F.col("url").alias("src_url"), F.explode("outgoing_links").alias("dst_url"))


def hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts of a URL column."""
    return df.select(urls.url_host(F.col(url)).alias("host")).where(F.col("host").isNotNull()).distinct()


def read_pages_report(df: DataFrame) -> DataFrame:
    """Reader outcome per page from (url, html, content), ``content`` being the article text.

    Images are empty successes, videos show their cleaned meta description, articles fail
    when they are boilerplate or empty. A null ``html`` stands for a page that was not fetched.
    """
    url, html = F.col("url"), F.col("html")
    kind = media.content_type(url)
    fetched = html.isNotNull()
    body = F.coalesce(F.col("content"), F.lit(""))
    boiler = text.is_boilerplate(body)
    video_text = text.clean_video_description(F.coalesce(meta_description(html), F.lit("")))
    title = text.trim_space(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    error = (
        F.when(kind == "image", F.lit(None).cast("string"))
        .when((kind == "video") & ~fetched, F.lit("Failed to fetch video page."))
        .when(kind == "video", F.lit(None).cast("string"))
        .when(~fetched, F.lit("Failed to fetch page."))
        .when((body != "") & boiler, F.lit("This page requires JavaScript and cannot be read automatically."))
        .when(body == "", F.lit("No readable content found on the page."))
    )
    staged = df.select(
        "*", kind.alias("__kind"), error.alias("error"), video_text.alias("__video"), title.alias("__title"),
    )
    kind_col, ok = F.col("__kind"), F.col("error").isNull()
    shown = (
        F.when(~ok | (kind_col == "image"), F.lit(""))
        .when(kind_col == "video", F.col("__video"))
        .otherwise(F.col("content"))
    )
    return staged.select(
        "url",
        F.when(kind_col != "image", text.blank_to_null(F.col("__title"))).alias("title"),
        shown.alias("content"),
        F.length(shown).cast("long").alias("content_length_chars"),
        F.when(ok & (kind_col == "article"), text.reading_time_seconds(F.col("content")))
        .otherwise(F.lit(0).cast("long")).alias("reading_time_seconds"),
        ok.alias("success"),
        "error",
        kind_col.alias("content_type"),
        F.when(kind_col == "image", url).when(kind_col == "video", media.video_thumbnail(url)).alias("media_url"),
    )
