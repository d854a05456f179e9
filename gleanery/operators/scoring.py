"""Sums of weights over matches: many queries against many documents, without a row per match.

Query weights are sent to the ranges of documents, so that neither side is repeated on disk; beyond a bound they meet the
postings in the cells of a grid. A range of documents and a tile of queries are looked at at a time, bounded on both sides. Inside a cell matches are numbered and added up in arrays, document by document and term by term, so documents
with equal postings get equal scores. A cell hands on scores, its best k per query, or how many documents match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialize

#: Postings and query weights of a cell, about.
CELL_POSTINGS, CELL_WEIGHTS = 1 << 18, 1 << 17
#: Query weights that are sent to all ranges of documents (24 bytes each); more meet the postings in a grid.
SENT_WEIGHTS = 1 << 23
#: Matches, or pairs of document and query, that are held at a time.
SLICE = 1 << 20
#: Postings for which another task is worth while.
LEAST_POSTINGS = 1 << 14


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Place of each value among the distinct values in order, nulls first, and those values."""
    coded = column.combine_chunks().dictionary_encode("encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _sums(postings: pa.Table, terms: np.ndarray, queries: np.ndarray, weights: np.ndarray, n_queries: int,
          docs: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, sums per document and query) of one slice of documents after the other; 0 where nothing matches."""
    order = np.argsort(terms, kind="stable")
    queries, weights = queries[order], weights[order]
    known, first, count = np.unique(terms[order], return_index=True, return_counts=True)
    asked = postings.column("term_id").to_numpy()
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    keep = np.flatnonzero(known[at] == asked)
    keep = keep[np.lexsort((at[keep], docs[keep]))]
    at, docs, part = at[keep], docs[keep], postings.column("part").to_numpy()[keep]
    times = count[at]
    begin = np.searchsorted(docs, np.arange(n_docs + 1))
    matches = np.concatenate([[0], np.cumsum(times)])[begin]
    low = 0
    while low < n_docs:
        high = min(low + max(1, SLICE // n_queries), int(np.searchsorted(matches, matches[low] + SLICE, "right")) - 1, n_docs)
        high = max(high, low + 1)
        own = slice(begin[low], begin[high])
        each = times[own]
        place = np.arange(each.sum()) + np.repeat(first[at[own]] - (np.cumsum(each) - each), each)
        key = np.repeat((docs[own] - low) * n_queries, each) + queries[place]
        sums = np.bincount(key, np.repeat(part[own], each) * weights[place], (high - low) * n_queries)
        yield low, sums.reshape(high - low, n_queries)
        low = high


class _Best:
    """The best k documents of every query so far, as whole numbers of the last digit; ties go to the smaller document."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.query = self.doc = self.score = np.zeros(0, np.int64)
        self.floor = np.zeros(n_queries, np.int64)

    def add(self, low: int, scores: np.ndarray, seen: np.ndarray) -> None:
        scores = np.where(seen, scores, -1)
        least = self.floor
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, query = np.nonzero(scores >= least)
        query, doc, score = np.append(self.query, query), np.append(self.doc, doc + low), np.append(self.score, scores[doc, query])
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.doc, self.score = query[kept], doc[kept], score[kept]
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]


def _cell(out: pa.Schema, digits: int, best: int | None, counts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell(postings: pa.Table, weights: pa.Table) -> pa.Table:
        if not postings.num_rows or not weights.num_rows:
            return out.empty_table()
        queries, names = _codes(weights.column("query_id"))
        docs, ids = _codes(postings.column("doc_id"))
        top = _Best(len(names), best) if best is not None else None
        total = np.zeros(len(names), np.int64)
        found = [out.empty_table()]
        for low, sums in _sums(postings, weights.column("term_id").to_numpy(), queries, weights.column("weight").to_numpy(), len(names), docs, len(ids)):
            seen = sums > 0
            if counts:
                total += seen.sum(axis=0)
                continue
            whole = np.rint(sums * 10.0**digits).astype(np.int64)
            if top is not None:
                top.add(low, whole, seen)
                continue
            doc, query = np.nonzero(seen)
            found.append(pa.table([names.take(pa.array(query)), ids.take(pa.array(doc + low)), pa.array(whole[doc, query] / 10.0**digits)], schema=out))
        if counts:
            return pa.table([names, pa.array(total)], schema=out)
        if top is not None:
            return pa.table([names.take(pa.array(top.query)), ids.take(pa.array(top.doc)), pa.array(top.score / 10.0**digits)], schema=out)
        return pa.concat_tables(found)

    return cell


def _tiles(weights: pa.Table, tiles: int) -> list[pa.Table]:
    """Weights of so many queries each, all those of a query in one; about equally long."""
    if not weights.num_rows:
        return [weights]
    query = _codes(weights.column("query_id"))[0]
    order = np.argsort(query, kind="stable")
    query = query[order]
    # a tile ends where a query does
    cuts = np.unique(np.searchsorted(query, query[np.arange(tiles) * len(query) // tiles]))
    ends = np.append(cuts[1:], len(query))
    weights = weights.take(pa.array(order))
    return [weights.slice(low, high - low).combine_chunks() for low, high in zip(cuts, ends)]


def summed(postings: DataFrame, weights: DataFrame, digits: int, best: int | None = None, counts: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of every document and query that match, the score rounded to ``digits``.

    ``postings`` is (doc_id, term_id, part), ``weights`` is (query_id, term_id, weight), all parts and weights above 0; a score
    is the sum of their products. With ``best`` each range of documents hands on so many documents per query, ties by the smaller id;
    with ``counts`` the result is (query_id, total), a row per range, and only matches are counted.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    spark = postings.sparkSession
    postings = materialize(postings.select("doc_id", "term_id", "part"), "matched")
    weights = materialize(weights.select("query_id", "term_id", "weight"), "asked")
    n, m = postings.count(), weights.count()
    spread = min(4 * spark.sparkContext.defaultParallelism, -(-n // LEAST_POSTINGS))
    ranges, tiles = max(1, spread, -(-n // CELL_POSTINGS)), max(1, -(-m // CELL_WEIGHTS))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    query = StructField("query_id", weights.schema["query_id"].dataType)
    schema = StructType([query, StructField("total", LongType())] if counts else [
        query, StructField("doc_id", postings.schema["doc_id"].dataType), StructField("score", DoubleType())])
    cell = _cell(to_arrow_schema(schema), digits, best, counts)
    if m <= SENT_WEIGHTS:
        # fewer and larger ranges: each hands on its best of every query
        ranges = max(1, spread, -(-n // (CELL_POSTINGS << 3)))
        sent = spark.sparkContext.broadcast(_tiles(weights.toArrow(), tiles))

        def cells(postings: pa.Table) -> pa.Table:
            return pa.concat_tables([cell(postings.drop_columns("range"), tile) for tile in sent.value])

        dealt = postings.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
        return dealt.groupBy("range").applyInArrow(cells, schema)
    left = postings.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")).withColumn("tile", every(tiles))
    right = weights.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")).withColumn("range", every(ranges))
    return left.groupBy("range", "tile").cogroup(right.groupBy("range", "tile")).applyInArrow(cell, schema)
