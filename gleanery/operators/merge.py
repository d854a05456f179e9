"""Merging, filtering and suggesting over search result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import blank_to_null
from gleanery.functions.urls import url_host
from gleanery.operators.bm25 import top_k

# List sizes of the result views.
VERTICAL_SIZE = 24
SUGGESTIONS = 10

# What marks a result as research, a discussion or an official source.
RESEARCH_CATEGORIES = ("general", "science", "encyclopedia", "reference")
RESEARCH_HOSTS = ("wikipedia", "academic", "scholar", "arxiv", "cambridge", "springer", "ieee", "acm.org")
RESEARCH_TEXT = ("research paper", "study shows")
DISCUSSION_CATEGORY_PARTS = ("discuss", "forum", "qa")
DISCUSSION_CATEGORIES = ("social media",)
DISCUSSION_HOSTS = ("reddit", "stackoverflow", "stackexchange", "quora", "discourse", "forum")
OFFICIAL_HOST_ENDS = (".gov", ".mil", ".gov.uk")
OFFICIAL_CATEGORY_PARTS = ("official", "documentation")
OFFICIAL_CATEGORIES = ("standards",)
OFFICIAL_HOSTS = ("company/", "about")
OFFICIAL_TEXT = ("official website", "documentation", "standards")

# Suggestion sources in the order they are asked.
SUGGESTION_SOURCES = {
    "searxng_autocompleter": 0, "searxng_search": 1, "searxng_titles": 2, "engine": 3,
}
SUGGESTION_PROVIDERS = {
    "searxng": ("searxng_autocompleter", "searxng_search", "searxng_titles"),
    "engine": ("engine",),
}


def interleave_merge(left: DataFrame, right: DataFrame, page_size: int) -> DataFrame:
    """Alternate two ranked lists (query_id, rank, url), left first; a URL keeps its first place.

    Place 2·rank + side stands for the turn a row would get, so the merge is a minimum per URL.
    """
    turns = left.select("query_id", "url", (F.col("rank") * 2).alias("turn")).unionByName(
        right.select("query_id", "url", (F.col("rank") * 2 + 1).alias("turn")))
    first = turns.groupBy("query_id", "url").agg(F.min("turn").alias("turn"))
    merged = top_k(first.withColumn("__neg", -F.col("turn")), page_size, score="__neg", tie="url")
    side = F.when(F.col("turn") % 2 == 0, F.lit("left")).otherwise(F.lit("right"))
    return merged.select("query_id", "rank", "url", side.alias("side"))


def collect_transfer_sources(results: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
    """Results, then images, then videos as saved items, one per lower-cased URL."""
    def part(df: DataFrame, priority: int, media) -> DataFrame:
        return df.select(
            "query_id", F.lower("url").alias("__key"), F.struct(F.lit(priority).alias("priority"), "pos").alias("at"),
            F.struct(
                "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"),
                media.alias("media_url"),
            ).alias("row"))

    own = blank_to_null(F.col("img_src"))
    any_image = F.coalesce(own, blank_to_null(F.col("thumbnail")))
    every = part(results, 0, own).unionByName(part(images, 1, any_image)).unionByName(part(videos, 2, any_image))
    return every.groupBy("query_id", "__key").agg(
        F.min_by("row", "at").alias("row"), F.min("at").alias("at")
    ).select("query_id", "at.priority", "at.pos", "row.*")


def merge_lists_by_url(local: DataFrame, remote: DataFrame) -> DataFrame:
    """All local rows, then remote rows with a new URL that are not still loading."""
    fresh = remote.where(~F.col("loading")).join(local.select("url"), "url", "left_anti")
    return local.withColumn("part", F.lit(0)).unionByName(
        fresh.select(local.columns).withColumn("part", F.lit(1)))


def add_to_front(rows: DataFrame, added: DataFrame, pos: str = "pos") -> DataFrame:
    """Replace rows with the URL of an added row and put the added rows first."""
    kept = rows.join(added.select("url"), "url", "left_anti").select(rows.columns)
    return added.select(rows.columns).withColumn("part", F.lit(0)).unionByName(kept.withColumn("part", F.lit(1)))


def append_page(results: DataFrame, following: DataFrame, page: int, images: bool = False) -> DataFrame:
    """Load-more as a bag union; rows keep (page, pos). Image rows without an image are dropped."""
    if images:
        following = following.where(blank_to_null(F.col("img_src")).isNotNull())
    return results.unionByName(following.withColumn("page", F.lit(page)), allowMissingColumns=True)


def _any_of(column: Column, parts: Sequence[str], test=F.contains) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | test(column, F.lit(part))
    return out


def facet(df: DataFrame) -> DataFrame:
    """Adds ``is_research``, ``is_discussion`` and ``is_official``."""
    # a projection of its own, so that the lower-cased texts are made once per row
    staged = df.withColumns({
        "__cat": F.lower(F.coalesce("category", F.lit(""))),
        "__host": F.coalesce(url_host(F.col("url")), F.lit("")),
        "__text": F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))),
    })
    category, host, text = F.col("__cat"), F.col("__host"), F.col("__text")
    return staged.withColumns({
        "is_research": category.isin(*RESEARCH_CATEGORIES) | _any_of(host, (".edu",), F.endswith)
        | _any_of(host, RESEARCH_HOSTS) | _any_of(text, RESEARCH_TEXT),
        "is_discussion": _any_of(category, DISCUSSION_CATEGORY_PARTS) | category.isin(*DISCUSSION_CATEGORIES)
        | _any_of(host, DISCUSSION_HOSTS),
        "is_official": _any_of(host, OFFICIAL_HOST_ENDS, F.endswith) | _any_of(category, OFFICIAL_CATEGORY_PARTS)
        | category.isin(*OFFICIAL_CATEGORIES) | _any_of(host, OFFICIAL_HOSTS) | _any_of(text, OFFICIAL_TEXT),
    }).drop("__cat", "__host", "__text")


def thumbnail_of(df: DataFrame) -> DataFrame:
    """Adds ``thumb``: the image, else the thumbnail, null when neither."""
    return df.withColumn("thumb", F.coalesce(blank_to_null(F.col("img_src")), blank_to_null(F.col("thumbnail"))))


def has_thumbnail(df: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows with a thumbnail that did not fail to load."""
    shown = thumbnail_of(df).where(F.col("thumb").isNotNull())
    if failed is not None:
        shown = shown.join(failed.select(F.col("url").alias("thumb")).distinct(), "thumb", "left_anti")
    return shown


def image_results(df: DataFrame) -> DataFrame:
    return df.where(blank_to_null(F.col("img_src")).isNotNull())


def split_verticals(df: DataFrame, size: int = VERTICAL_SIZE) -> DataFrame:
    """Image, video and news lists of each query: the first ``size``, of which those with a thumbnail show.

    Image rows must have an image of their own.
    """
    lists = df.where(F.col("category").isin("images", "videos", "news")).withColumn(
        "__key", F.struct("query_id", "category")).withColumn("__neg", -F.col("pos"))
    first = top_k(lists, size, key="__key", score="__neg", tie="url").drop("__key", "__neg")
    shown = has_thumbnail(first)
    return shown.where((F.col("category") != "images") | blank_to_null(F.col("img_src")).isNotNull())


def results_with_url(hits: DataFrame) -> DataFrame:
    """Hits with a URL; null titles read blank, the snippet falls back to the description."""
    return hits.where(blank_to_null(F.col("url")).isNotNull()).select(
        "query_id", "url", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(blank_to_null(F.col("snippet")), blank_to_null(F.col("description")), F.lit("")).alias("snippet"))


def distinct_url_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("url") if approximate else F.count_distinct("url")
    return df.groupBy("query_id").agg(count.alias("unique_urls"))


def suggest(candidates: DataFrame, k: int = SUGGESTIONS, provider: str | None = None) -> DataFrame:
    """(query_id, source, pos, suggestion) → the first ``k`` of the first source that has any."""
    if provider is not None:
        candidates = candidates.where(F.col("source").isin(*SUGGESTION_PROVIDERS[provider]))
    order = F.create_map(*[F.lit(v) for pair in SUGGESTION_SOURCES.items() for v in pair])
    ordered = candidates.where(blank_to_null(F.col("suggestion")).isNotNull()).withColumn(
        "__prio", order[F.col("source")])
    winner = ordered.groupBy("query_id").agg(F.min("__prio").alias("__prio"))
    kept = ordered.join(winner, ["query_id", "__prio"]).withColumn("__neg", -F.col("pos"))
    return top_k(kept, k, score="__neg", tie="suggestion").select("query_id", "source", "rank", "suggestion")
