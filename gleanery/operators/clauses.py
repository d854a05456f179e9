"""BM25 over clauses: words and phrases, required, optional or excluded, in all fields or in one.

A clause of one word is a term. A clause of several words is a phrase and is scored as a term of its own: it occurs
as often as its words stand next to each other in a field. Its rarity is, as is usual, the sum of its words'
rarities, or with ``rarity="phrase"`` that of the documents that hold the phrase.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import tokenize
from gleanery.operators.bm25 import BOOSTS, K1, B, idf, phrase_digest, phrase_places, read_terms, term_statistics, top_k
from gleanery.operators.clause_scan import best_of_clauses
from gleanery.operators.index import Index
from gleanery.session import materialize

#: Scores are rounded to so many digits. They are summed in a way that no order changes, so equal documents tie.
DIGITS = 12

SHOULD, MUST, MUST_NOT = "should", "must", "must_not"


def word_clauses(queries: DataFrame, occur: str = SHOULD) -> DataFrame:
    """(query_id, q) as one clause per word."""
    return queries.select("query_id", F.explode(tokenize(F.col("q"))).alias("text"), F.lit(occur).alias("occur"))


def _normal(clauses: DataFrame) -> DataFrame:
    """query_id, literal, words, field (null: all), occur, boost: equal clauses are one whose boosts add up."""
    field = F.col("field") if "field" in clauses.columns else F.lit(None)
    boost = F.coalesce(F.col("boost"), F.lit(1.0)) if "boost" in clauses.columns else F.lit(1.0)
    rows = clauses.select(
        "query_id", tokenize(F.col("text")).alias("words"), field.cast("string").alias("field"),
        F.col("occur"), boost.cast("double").alias("boost")).where(F.size("words") > 0)
    # words hold no blank, so the joined text names the sequence
    return rows.withColumn("literal", F.array_join("words", " ")).groupBy("query_id", "literal", "words", "field", "occur").agg(
        F.sum("boost").alias("boost"))


def phrase_frequencies(index: Index, phrases: DataFrame) -> DataFrame:
    """Phrases (literal, words) → literal, field, doc_id, tf: how often the words stand next to each other."""
    found = phrase_places(index, phrases).groupBy("p1", "p2", "field", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    return phrases.select("literal", *phrase_digest(F.col("words"))).join(found, ["p1", "p2"]).select("literal", "field", "doc_id", "tf")


def literal_matches(index: Index, literals: DataFrame, rarity: str = "words") -> DataFrame:
    """literal, field, doc_id, tf, doc_len, idf of every occurrence of ``literals`` (literal, words)."""
    literals = materialize(literals.select("literal", "words"), "literals")
    parts = literals.select("literal", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    # one row per field, three at most
    docs = F.broadcast(index.field_stats.select("field", "n_docs"))
    rated = term_statistics(index, parts.select("literal", "i", "term"), "parts").join(docs, "field")
    rare = rated.groupBy("literal", "field").agg(exact_sum(idf(F.col("n_docs"), F.col("df"))).alias("idf"))
    single = read_terms(index.postings, parts.where("n = 1").select("literal", "term"), index, "single").select(
        "literal", "field", "doc_id", "tf", "doc_len")
    found = materialize(phrase_frequencies(index, literals.where(F.size("words") > 1)), "frequencies")
    lengths = index.doc_lengths.select("field", "doc_id", F.col("len").alias("doc_len"))
    phrases = found.join(lengths, ["field", "doc_id"]).select("literal", "field", "doc_id", "tf", "doc_len")
    if rarity == "phrase":
        own = found.groupBy("literal", "field").agg(F.count("*").alias("df")).join(docs, "field").select(
            "literal", "field", idf(F.col("n_docs"), F.col("df")).alias("own"))
        rare = rare.join(own, ["literal", "field"], "left").withColumn("idf", F.coalesce("own", "idf")).drop("own")
    return single.unionByName(phrases).join(rare, ["literal", "field"])


def exact_sum(value: Column) -> Column:
    """Sum of doubles, below 2^63 in units of 2^-20 on the whole, that is the same in any order of the rows.

    Units of 2^-20 and what is left of them in units of 2^-60 are summed as integers; a double is rounded once, at the end.
    """
    scaled = value * F.lit(2.0**20)
    whole = F.floor(scaled)
    rest = F.floor((scaled - whole) * F.lit(2.0**40))
    return (F.sum(whole) + F.sum(rest) / F.lit(2.0**40)) / F.lit(2.0**20)


def _part(weight: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len"))
    return weight * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)


def bm25_clauses(index: Index, clauses: DataFrame, k: int, offset: int = 0, boosts: Mapping[str, float] = BOOSTS,
                 rarity: str = "words") -> DataFrame:
    """Top documents per query → (query_id, rank, doc_id, score).

    ``clauses`` is (query_id, text, occur[, field][, boost]); ``occur`` is should, must or must_not. A document
    must match every required clause and no excluded one; without a required clause it must match an optional
    one. Required and optional clauses score, in each field they may match, with the field's boost times their own.
    Clauses without a word count as none; a query of excluded clauses alone finds nothing. A clause given twice
    counts twice. On an index built from text clauses go to the texts (``clause_scan``), on a stored one they are joined.
    """
    if rarity not in ("words", "phrase"):
        raise ValueError(f"rarity is 'words' or 'phrase', not {rarity!r}")
    wanted = materialize(_normal(clauses), "clauses")
    if index.fields is not None:
        found = best_of_clauses(index.docs, wanted, k + offset, boosts, rarity, DIGITS)
        if found is not None:
            return top_k(found, k, offset).select("query_id", "rank", "doc_id", "score")
    matches = literal_matches(index, wanted.select("literal", "words").distinct(), rarity)
    boost = F.create_map(*[F.lit(v) for pair in boosts.items() for v in pair])
    # one row per field, three at most
    stats = F.broadcast(index.field_stats.where(F.col("field").isin(*boosts)).select("field", "avg_len"))
    rows = wanted.select("query_id", "literal", F.col("field").alias("only"), "occur", F.col("boost").alias("own"))
    part = exact_sum(_part(boost[F.col("field")] * F.col("idf"))).alias("part")
    # first per document what a clause of boost 1 adds, in all fields and in single ones, so that a clause meets a document
    # once: one that matches in several fields is one required clause
    fielded = materialize(rows.where("only is not null").select("literal", F.col("only").alias("field")).distinct(), "fielded")
    rated = matches.join(stats, "field")
    everywhere = rated.groupBy("literal", "doc_id").agg(part).withColumn("scope", F.lit(""))
    single = rated.join(fielded, ["literal", "field"], "left_semi").groupBy("literal", "field", "doc_id").agg(part)
    parts = everywhere.unionByName(single.withColumnRenamed("field", "scope"))
    hits = parts.join(rows.withColumn("scope", F.coalesce("only", F.lit(""))), ["literal", "scope"])
    scored = hits.groupBy("query_id", "doc_id").agg(
        F.round(exact_sum(F.when(F.col("occur") != MUST_NOT, F.col("own") * F.col("part"))), DIGITS).alias("score"),
        F.count_if(F.col("occur") == MUST).alias("got"), F.count_if(F.col("occur") == MUST_NOT).alias("bad"))
    needed = wanted.groupBy("query_id").agg(F.count_if(F.col("occur") == MUST).alias("needed"))
    kept = scored.join(needed, "query_id").where(
        (F.col("bad") == 0) & (F.col("got") == F.col("needed")) & F.col("score").isNotNull())
    return top_k(kept, k, offset).select("query_id", "rank", "doc_id", "score")
