"""Search responses as JSON: reading another engine's and writing our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions.media import parse_duration, raw_duration

# Fixed value: source name of results that do not name their engine.
DEFAULT_SOURCE = "searxng"


def read_metasearch_json(spark: SparkSession, path: str) -> DataFrame:
    """One response per line, by explicit schema."""
    return spark.read.schema(schemas.METASEARCH_RESPONSE).json(path)


def metasearch_results(responses: DataFrame, page_size: int | None = None) -> DataFrame:
    """Responses → one row per result with a URL, renamed to our columns; ``page_size`` keeps that many per response."""
    with_url = F.filter("results", lambda r: r["url"].isNotNull() & (r["url"] != ""))
    rows = responses.select("query", F.posexplode(with_url if page_size is None else F.slice(with_url, 1, page_size)).alias("pos", "r"))
    return rows.select(
        "query", "pos",
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.col("r.url").alias("url"),
        F.coalesce("r.content", F.lit("")).alias("snippet"),
        F.coalesce("r.engine", F.lit(DEFAULT_SOURCE)).alias("source"),
        "r.img_src", "r.thumbnail",
        F.col("r.publishedDate").alias("published_date"),
        "r.category", "r.engine",
        parse_duration(F.col("r.length")).cast("int").alias("length_seconds"),
        raw_duration(F.col("r.length")).alias("length_raw"),
    )


def metasearch_totals(responses: DataFrame, page_size: int) -> DataFrame:
    """Reported total, or results kept plus one page when none is reported."""
    kept = F.least(
        F.size(F.filter("results", lambda r: r["url"].isNotNull() & (r["url"] != ""))), F.lit(page_size))
    total = F.coalesce(F.nullif("number_of_results", F.lit(0)), (kept + page_size).cast("long"))
    return responses.select("query", total.alias("total_results"), "suggestions", "infoboxes")


def export_results(hits: DataFrame, path: str) -> None:
    """Write hits as JSON lines."""
    hits.select(F.to_json(F.struct(*hits.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "errorifexists").text(path)
