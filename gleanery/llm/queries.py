"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import (
    conversation, decontaminate, jaccard, language, line_dedup, merkle, mixing, quality, substring, token_count, token_files, topk, url_filter,
)
from gleanery.llm.oracles import RULES
from gleanery.session import materialize, scratch_path

#: The folder of public vocabulary files.
TOKENIZERS = public_tokenizers.path("").rstrip("/")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    documents = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.fit_languages(documents.filter(~out).select("lang", "text"))
    found = language.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that an earlier one has in the same run; the text as a digest."""
    found = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of lines that came before; the text as a digest."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(documents, _table(spark, sf_dir, "benchmark")).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token counts of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    documents = _table(spark, sf_dir, "documents")
    # written once: the decisions need ids and sizes only
    sizes = materialize(documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix_sources(sizes, sizes=sizes)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to token files, then reads them back."""
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)
    return token_files.read_token_files(spark, folder).drop("place")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_filter(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after planted damage."""
    rows = _table(spark, sf_dir, "conversations")
    return conversation.repaired_conversations(rows, conversation.damage(rows))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and a verified proof of every document; half of them are tampered with."""
    documents = _table(spark, sf_dir, "documents")

    def leaf(text: Column) -> Column:
        return merkle.digest(*(merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))

    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claim = F.when(tampered, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    # the texts are read once: everything after works on digests
    leaves = materialize(documents.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), claim.alias("claim")), "digests")
    found = merkle.certify(leaves)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows with the largest inner product for every hundredth vector."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_language_id, op2_substring_dedup, op3_url_filters, op4_line_dedup, op5_decontamination, op6_token_counts, op7_mixing, op8_token_files,
        op9_jaccard_join, op10_quality_rules, op11_conversation_repair, op12_merkle_manifest, op13_exact_top_k,
    )}


def oracle_sql() -> dict[str, str]:
    from gleanery.llm import oracles, oracles_trees

    return oracles.SQL | oracles_trees.SQL
