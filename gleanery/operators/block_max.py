"""Exact top-k by BM25 without scoring every match: postings in blocks of documents with bounds.

Documents are dealt to blocks by a hash of their id. The postings of a term in a block are one row that carries
the largest frequency and the least field length among them, from which follows the most that the term can add to a
score there, whatever the statistics are at query time. The heads of blocks, without their entries, give each
query an upper bound per block. The blocks with the highest bounds are scored first; their k-th score is a floor, and
of the others only those are opened whose bound reaches it. Rare words dominate the bounds, so blocks that hold
nothing but frequent words stay closed. Documents move to their blocks as text and are counted there, so no posting is
shuffled to build a block; an opened block is read once for all queries, whose sums are made in the cells of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.bm25 import BOOSTS, K1, SCORE_DIGITS, B, query_terms, term_weights, top_k
from gleanery.operators.index import Index, field_tokens, hash_bucket
from gleanery.operators.scoring import summed
from gleanery.session import bound_batches, materialize
from gleanery.sources.index_store import buckets_for, write_by_term

#: Documents of a block, about.
BLOCK_DOCS = 64
#: Blocks of a task that builds them, about.
TASK_BLOCKS = 128
#: Blocks that are scored first for each query, or the hits asked for, if these are more: each block holds a match.
FIRST_BLOCKS = 4
#: Digits of bounds; scores have fewer.
BOUND_DIGITS = SCORE_DIGITS + 2

_ROWS = (
    "field STRING, term STRING, doc_block INT, n INT, max_tf INT, min_len INT, "
    "entries ARRAY<STRUCT<doc_id: BIGINT, tf: INT, doc_len: INT>>"
)
SCHEMA = f"{_ROWS}, term_bucket INT"
_ENTRY = [("doc_id", pa.int64()), ("tf", pa.int32()), ("doc_len", pa.int32())]


def _block_rows(part: pa.Table) -> pa.RecordBatch:
    """One row per field, term and block of whole blocks: (field, doc_id, tokens, doc_block) per document and field."""
    tokens = part.column("tokens").combine_chunks()
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    kinds = max(1, len(words.dictionary))
    key, tf = np.unique(np.repeat(np.arange(len(size)) * kinds, size) + words.indices.to_numpy(), return_counts=True)
    row, term = np.divmod(key, kinds)
    fields = part.column("field").combine_chunks().dictionary_encode()
    field, block = fields.indices.to_numpy()[row], part.column("doc_block").to_numpy()[row]
    doc = part.column("doc_id").to_numpy()[row]
    order = np.lexsort((doc, term, field, block))
    field, block, term, doc, tf, length = field[order], block[order], term[order], doc[order], tf[order].astype(np.int32), size[row][order].astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = (block[1:] != block[:-1]) | (field[1:] != field[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(order)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), pa.array(tf), pa.array(length)], names=[n for n, _ in _ENTRY])
    none = np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([
        fields.dictionary.take(pa.array(field[first])), words.dictionary.take(pa.array(term[first])), pa.array(block[first], pa.int32()),
        pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tf, first) if len(first) else none),
        pa.array(np.minimum.reduceat(length, first) if len(first) else none), pa.ListArray.from_arrays(pa.array(ends), entries),
    ], names=["field", "term", "doc_block", "n", "max_tf", "min_len", "entries"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by block; those of the last one wait for the next batch."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        block = rows.column("doc_block").to_numpy()
        whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
        if whole:
            yield _block_rows(rows.slice(0, whole))
        waiting = rows.slice(whole)
    if waiting is not None:
        yield _block_rows(waiting)


def posting_blocks(index: Index, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """field, term, doc_block, n, max_tf, min_len, entries. A row holds the entries of one block's documents only."""
    # one row per field
    docs = index.field_stats.agg(F.max("n_docs")).first()[0] or 0
    blocks = max(1, -(-docs // block_docs))
    spark = index.docs.sparkSession
    bound_batches(spark)
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS))
    dealt = index.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "description", "content").withColumn(
        "doc_block", hash_bucket(F.col("doc_id"), blocks)).repartition(tasks, "doc_block").sortWithinPartitions("doc_block")
    rows = field_tokens(dealt, "doc_block").where(F.col("tokens").isNotNull())
    return rows.mapInArrow(_by_block, _ROWS)


def write_blocks(index: Index, path: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Write the blocks beside a stored index, by the same buckets of terms. The tasks that build blocks hold some of every bucket."""
    blocks = posting_blocks(index, block_docs).withColumn("term_bucket", hash_bucket(F.col("term"), index.term_buckets or 1))
    blocks.sortWithinPartitions("term_bucket", "term", "doc_block").write.mode("overwrite").partitionBy("term_bucket").parquet(path)
    return index.docs.sparkSession.read.schema(SCHEMA).parquet(path)


def write_block_index(index: Index, path: str, block_docs: int = BLOCK_DOCS) -> tuple[Index, DataFrame]:
    """Write what a search of blocks reads: the blocks and the statistics, which are added up from them."""
    spark = index.docs.sparkSession
    index.field_stats.write.mode("overwrite").parquet(f"{path}/field_stats")
    field_stats = spark.read.schema("field STRING, n_docs BIGINT, avg_len DOUBLE").parquet(f"{path}/field_stats")
    stored = replace(index, field_stats=field_stats, term_buckets=buckets_for(field_stats)[0])
    blocks = write_blocks(stored, f"{path}/blocks", block_docs)
    write_by_term(blocks.groupBy("field", "term").agg(F.sum("n").alias("df")), f"{path}/term_stats", stored.term_buckets)
    stats = spark.read.schema("field STRING, term STRING, df BIGINT, term_bucket INT").parquet(f"{path}/term_stats")
    return replace(stored, term_stats=stats), blocks


def _part(tf: Column, length: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.col("avg_len"))
    return tf * F.lit(K1 + 1) / (tf + norm)


def _asked(blocks: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``blocks`` of the asked terms, with a number of the term; and the weight of each number in each query."""
    keys = [c for c in ("term_bucket", "field", "term") if c in blocks.columns and c in weights.columns]
    numbered = materialize(weights.select(*keys, "avg_len").distinct().withColumn("term_id", F.monotonically_increasing_id()), "numbered")
    # the comparison keeps all rows and marks this side as a filter for partition pruning
    return blocks.join(numbered.where(F.length("term") > 0), keys), weights.join(numbered, keys).select("query_id", "term_id", "weight")


def _bounds(asked: DataFrame, weights: DataFrame) -> DataFrame:
    heads = asked.select(F.col("doc_block").alias("doc_id"), "term_id", _part(F.col("max_tf"), F.col("min_len")).alias("part"))
    return summed(heads, weights, BOUND_DIGITS).select("query_id", F.col("doc_id").alias("doc_block"), F.col("score").alias("bound"))


def _best(asked: DataFrame, weights: DataFrame, opened: DataFrame, want: int) -> DataFrame:
    """query_id, doc_id, score of the best documents in the opened blocks, for all queries."""
    found = asked.join(opened, "doc_block").select("term_id", "avg_len", F.explode("entries").alias("e"))
    postings = found.select(F.col("e.doc_id").alias("doc_id"), "term_id", _part(F.col("e.tf"), F.col("e.doc_len")).alias("part"))
    scored = summed(postings, weights, SCORE_DIGITS, best=want)
    return materialize(top_k(scored, want).select("query_id", "rank", "doc_id", "score"), "best")


def block_bounds(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_block, bound: the most a document of the block can score."""
    return _bounds(*_asked(blocks, weights))


def bm25_search_blocks(index: Index, blocks: DataFrame, queries: DataFrame, k: int, offset: int = 0,
                       boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """The rows of ``bm25_search``, from the blocks that can hold them.

    A block stays closed only if its bound, with a margin for rounding, is below the score of rank ``k + offset``
    among the documents already scored, for every query, so ties are opened and the result is exact.
    """
    want = k + offset
    asked, weights = _asked(blocks, term_weights(index, query_terms(queries), boosts))
    bounds = materialize(_bounds(asked, weights), "bounds")
    first = top_k(bounds, max(FIRST_BLOCKS, want), score="bound", tie="doc_block").select("doc_block").distinct()
    first = materialize(first, "first")
    best = _best(asked, weights, first, want)
    floor = best.where(F.col("rank") == want - 1).select("query_id", F.col("score").alias("floor"))
    margin = F.lit(10.0**-SCORE_DIGITS)
    later = bounds.join(first, "doc_block", "left_anti").join(floor, "query_id", "left").where(
        F.col("floor").isNull() | (F.col("bound") + margin >= F.col("floor")))
    rest = _best(asked, weights, materialize(later.select("doc_block").distinct(), "later"), want)
    every = best.unionByName(rest).select("query_id", "doc_id", "score")
    return top_k(every, k, offset).select("query_id", "rank", "doc_id", "score")
