"""The crawled-page and embedding tables: reads, upserts and state changes.

Tables are immutable snapshots; every change returns the new state as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All crawled pages in id order."""
    return spark.read.schema(schemas.PAGE).parquet(path).orderBy("id")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a table state to a fresh path."""
    df.write.mode("errorifexists").parquet(path)


def unindexed_batch(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """The pages to index, by id; the first ``limit`` of them if given."""
    waiting = pages.where(~F.col("indexed")).orderBy("id")
    return waiting if limit is None else waiting.limit(limit)


def first_per_key(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first in ``order`` (null last), of equal ones that with the least digest.

    The winner is found on keys, order and digest alone, by aggregates that combine before the shuffle; texts move
    once, to meet it.
    """
    keys = list(keys)
    rows = batch.withColumn("__h", F.xxhash64(*batch.columns))
    narrow = rows.groupBy(*keys, order).agg(F.min("__h").alias("__h"))
    best = narrow.groupBy(*keys).agg(
        F.min(order).alias("__o"), F.coalesce(F.min_by("__h", order), F.min("__h")).alias("__w"))
    on = (F.col("__h") == F.col("__w")) & F.col(order).eqNullSafe(F.col("__o"))
    for k in keys:
        best = best.withColumnRenamed(k, f"__k_{k}")
        on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    found = rows.join(best, on, "left_semi").drop("__h")
    # rows that agree in every column are one; they stand side by side, so this adds no second copy of the text
    return found.dropDuplicates(keys).select(*keys, *[c for c in batch.columns if c not in keys])


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite the columns the (key-unique) batch shares with matching target rows; add the new rows.

    Target columns missing from the batch, such as a generated id, are kept.
    """
    keys = list(keys)
    values = [c for c in batch.columns if c in target.columns and c not in keys]
    incoming = batch.select(*keys, F.struct(*values).alias("__new"))
    # one full join: each side is read and shuffled once
    both = target.join(incoming, keys, "full")
    hit = F.col("__new").isNotNull()
    return both.select([
        F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in target.columns
    ])


def upsert_pages(target: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert by URL; of repeated URLs in the batch the first counts."""
    return upsert(target, first_per_key(batch, ["url"], order).drop(order), ["url"])


def upsert_embeddings(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by (page_id, chunk_index); of repeated keys in the batch one row counts."""
    return upsert(target, batch.dropDuplicates(["page_id", "chunk_index"]), ["page_id", "chunk_index"])


def insert_ignore(target: DataFrame, batch: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """Add the rows whose key is new, the first of each; leave the others alone."""
    fresh = first_per_key(batch, [key], order).drop(order).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(target.columns)


def append_activity(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append-only event write."""
    return log.unionByName(rows)


def embeddings_with_pages(embeddings: DataFrame, pages: DataFrame) -> DataFrame:
    """First chunks with the url and title of their page."""
    return embeddings.where(F.col("chunk_index") == 0).join(
        pages.select(F.col("id").alias("page_id"), "url", "title"), "page_id"
    ).select("page_id", "url", "title", "embedding")


def pages_missing_embeddings(pages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Indexed pages without any embedding."""
    have = embeddings.select(F.col("page_id").alias("id"))
    return pages.where("indexed").join(have, "id", "left_anti")


def urls_already_crawled(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The given URLs that are in the page table."""
    return urls.select("url").join(pages.select("url"), "url", "left_semi")


def mark_indexed(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Set ``indexed`` on the listed ids."""
    done = ids.select("id").distinct().withColumn("__done", F.lit(True))
    return pages.join(done, "id", "left").withColumn(
        "indexed", F.col("indexed") | F.coalesce("__done", F.lit(False))).drop("__done")


def page_counts(pages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: pages, indexed pages, embeddings."""
    a = pages.agg(F.count("*").alias("total_pages"), F.count_if("indexed").alias("indexed_pages"))
    return one_row(a, embeddings.agg(F.count("*").alias("embeddings")))


def one_row(*aggregates: DataFrame) -> DataFrame:
    """One-row aggregates side by side: a union in which each column has a single value."""
    both = aggregates[0]
    for other in aggregates[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def shard_count(n: int) -> int:
    """The number of shards asked for, rounded up to a power of two."""
    return 1 << max(0, n - 1).bit_length()


def shard_doc_counts(pages: DataFrame, n: int) -> DataFrame:
    """Documents per hash shard of the URL, and in all."""
    shards = shard_count(n)
    counts = pages.groupBy(F.pmod(F.xxhash64("url"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("docs"))
    every = pages.sparkSession.range(shards).select(F.col("id").alias("shard"))
    per_shard = every.join(counts, "shard", "left").na.fill(0, ["docs"]).select(
        F.col("shard").cast("string").alias("shard"), "docs")
    return per_shard.unionByName(pages.agg(F.lit("total").alias("shard"), F.count("*").alias("docs")))


def distinct_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.select(url).dropDuplicates([url])
