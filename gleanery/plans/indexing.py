"""Index maintenance: incremental update, rebuild and embedding recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.index import Index, build_index, with_postings
from gleanery.operators.vector import Embedder, embed_pages, hashing_embedder
from gleanery.session import materialize
from gleanery.sources.pages import pages_missing_embeddings, upsert_embeddings


def as_documents(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("id").alias("doc_id"), "url", "title", "description", "content")


def update_index(index: Index, pages: DataFrame) -> Index:
    """Delete the documents of the given URLs, add the pages, work the statistics out again.

    Of pages with the same URL the one with the greatest ``doc_id`` counts; of those the same row, once.
    """
    # the winners are found on narrow rows; only then do texts move
    last = pages.groupBy("url").agg(F.max("doc_id").alias("doc_id"))
    pages = materialize(pages.join(last, ["url", "doc_id"], "left_semi").select(pages.columns).dropDuplicates(["doc_id"]), "changed")
    added = build_index(pages, stage=True)
    gone = index.docs.select("doc_id", "url").join(pages.select("url"), "url", "left_semi").select("doc_id").unionByName(
        pages.select("doc_id")).distinct()

    def swap(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old.join(gone, "doc_id", "left_anti")
        return kept.select(new.columns).unionByName(new)

    return with_postings(
        swap(index.docs, added.docs), swap(index.postings, added.postings),
        swap(index.positions, added.positions), swap(index.doc_lengths, added.doc_lengths))


def reset_index_state(pages: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every page unindexed, no embeddings."""
    return pages.withColumn("indexed", F.lit(False)), embeddings.limit(0)


def reindex_all(pages: DataFrame, embedder: Embedder = hashing_embedder) -> tuple[DataFrame, Index, DataFrame]:
    """Rebuild from every page → (pages marked indexed, index, embeddings)."""
    return pages.withColumn("indexed", F.lit(True)), build_index(as_documents(pages)), embed_pages(pages, embedder)


def recover_missing_embeddings(pages: DataFrame, embeddings: DataFrame, embedder: Embedder = hashing_embedder,
                               model: str = "hashing") -> DataFrame:
    """Embeddings with the gaps of indexed pages filled."""
    missing = pages_missing_embeddings(pages, embeddings)
    return upsert_embeddings(embeddings, embed_pages(missing, embedder, model))
