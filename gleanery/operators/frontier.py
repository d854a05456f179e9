"""Crawl frontier: seeds, fresh links, breadth-first expansion and budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators.running import ordered_index, running_total
from gleanery.session import materialize, scratch_path


def seed_frontier(seeds: DataFrame) -> DataFrame:
    """Seed URLs at depth 0, each once."""
    return seeds.select("url").dropDuplicates(["url"]).select(
        "url", F.lit(0).alias("depth"), F.lit(0).alias("retry_count"))


def within_depth(frontier: DataFrame, max_depth: int) -> DataFrame:
    return frontier.where(F.col("depth") <= max_depth)


def fresh_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links never seen before, one row per URL at its smallest depth."""
    return links.groupBy("url").agg(F.min("depth").alias("depth")).join(
        visited.select("url"), "url", "left_anti")


def max_pages_budget(frontier: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` rows by (depth, url)."""
    return ordered_index(frontier, ["depth", "url"], "__n").where(F.col("__n") <= max_pages).drop("__n")


def crawl_schedule(frontier: DataFrame, rules: DataFrame | None = None, default_delay: float = 1.0,
                   order: str = "seq") -> DataFrame:
    """Earliest start of each URL: delay × number of earlier URLs of its host."""
    df = frontier.withColumn("host", urls.url_host(F.col("url")))
    ranked = running_total(df, ["host"], [order], F.lit(1), "__rank")
    delay = F.lit(default_delay)
    if rules is not None:
        ranked = ranked.join(rules.select("host", "crawl_delay"), "host", "left")
        delay = F.coalesce(F.col("crawl_delay"), delay)
    return ranked.withColumn("start_seconds", delay * (F.col("__rank") - 1)).drop("__rank", "crawl_delay")


def expand_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None,
                    admit: Callable[[DataFrame], DataFrame] | None = None, edges_stored: bool = False) -> DataFrame:
    """Breadth-first expansion over (src, dst) edges from (url) seeds → (url, depth).

    Each level is written once to the shared folder, which cuts the lineage and doubles as the
    visited set. ``admit`` may drop URLs of a level (robots rules, for example); those are not
    expanded. Edges are read once per level: pass ``edges_stored=True`` when they already are a
    plain table, else they are written out once first.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "frontier")
    links = edges.select(F.col("src").alias("url"), F.col("dst"))
    if not edges_stored:
        links = materialize(links, "edges")
    level = seeds.select("url").distinct()
    taken = 0
    for depth in range(max_depth + 1):
        if admit is not None:
            level = admit(level).select("url")
        if max_pages is not None:
            level = materialize(level, "level")
            room = max_pages - taken
            if level.count() > room:
                level = ordered_index(level, ["url"], "__n").where(F.col("__n") <= room).drop("__n")
        path = f"{root}/depth={depth}"
        level.write.mode("overwrite").parquet(path)
        current = spark.read.schema("url STRING").parquet(path)
        size = current.count()
        taken += size
        if size == 0 or depth == max_depth or (max_pages is not None and taken >= max_pages):
            break
        visited = spark.read.schema("url STRING, depth INT").parquet(root)
        level = (
            current.join(links, "url").select(F.col("dst").alias("url")).distinct()
            .join(visited.select("url"), "url", "left_anti")
        )
    return spark.read.schema("url STRING, depth INT").option("basePath", root).parquet(root)
