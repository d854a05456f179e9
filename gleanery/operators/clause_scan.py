"""Clauses scored where the texts are: one pass counts how many documents hold each clause, a second scores and ranks them.

Clauses are sent to the tasks, and a task hands on its best documents per query, so neither postings nor matches are
written or moved. Contributions are added up as whole numbers: no order of adding changes a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.bm25 import K1, B
from gleanery.operators.index import FIELDS
from gleanery.operators.phrase_scan import Phrases, name_phrases, scan, sent_phrases
from gleanery.session import materialize

#: Words of all clauses that are sent, and the best documents of all queries that a task holds; more are joined instead.
SENT_WORDS, HELD = 1 << 20, 1 << 24
#: Pairs of document and clause that are looked at at a time.
SLICE = 1 << 20

_DOCS, _TOKENS = -1, -2


def _distinct(rows: np.ndarray, phrases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, tf = np.unique(rows * n + phrases, return_counts=True)
    return *np.divmod(key, n), tf


def _counter(sent):
    def run(documents):
        phrases: Phrases = sent.value
        n = len(phrases.ids)
        df = np.zeros((len(FIELDS), n), np.int64)
        docs, tokens = 0, np.zeros(len(FIELDS), np.int64)
        for ids, fields in documents:
            docs += len(ids)
            for i, (words, sizes) in enumerate(fields):
                tokens[i] += len(words)
                df[i] += np.bincount(_distinct(*phrases.find(words, sizes), n)[1], minlength=n)
        field, place = np.nonzero(df)
        every = np.arange(len(FIELDS))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)) for parts in (
            [phrases.ids[place], np.full(len(FIELDS), _DOCS), np.full(len(FIELDS), _TOKENS)], [field, every, every],
            [df[field, place], np.full(len(FIELDS), docs), tokens])], names=["phrase_id", "field", "n"])

    return run


class _Scorer:
    """Clauses by the phrase they ask for, with their weight in every field, and the best documents of every query so far."""

    def __init__(self, phrases: Phrases, phrase: np.ndarray, query: np.ndarray, weights: np.ndarray, admitted: np.ndarray,
                 must: np.ndarray, must_not: np.ndarray, k: int, digits: int) -> None:
        order = np.argsort(phrase, kind="stable")
        self.phrases, self.k, self.digits = phrases, k, digits
        self.query, self.weights, self.admitted = query[order], weights[order], admitted[order]
        self.must, self.must_not = must[order], must_not[order]
        self.first = np.searchsorted(phrase[order], np.arange(len(phrases.ids) + 1))
        self.n_queries = int(query.max(initial=-1)) + 1
        self.needed = np.bincount(query[must], minlength=self.n_queries)

    def start(self, doc_type: np.dtype) -> None:
        self.best_query, self.best_doc, self.best_score = np.zeros(0, np.int64), np.zeros(0, doc_type), np.zeros(0)
        self.floor = np.full(self.n_queries, -np.inf)

    def add(self, ids: np.ndarray, fields: list[tuple[np.ndarray, np.ndarray]], average: np.ndarray) -> None:
        n = len(self.phrases.ids)
        hits = [_distinct(*self.phrases.find(*field), n) for field in fields]
        step = max(1, SLICE // max(1, len(self.query)))
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            found = []
            for i, ((_, sizes), (row, phrase, tf)) in enumerate(zip(fields, hits)):
                own = slice(*np.searchsorted(row, [low, high]))
                times = np.diff(self.first)[phrase[own]]
                at = np.repeat(self.first[phrase[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                doc, count = np.repeat(row[own], times), np.repeat(tf[own], times)
                kept = self.admitted[at, i]
                at, doc, count = at[kept], doc[kept], count[kept]
                norm = K1 * ((1 - B) + B * sizes[doc] / average[i])
                found.append((doc - low, at, self.weights[at, i] * count * (K1 + 1) / (count + norm)))
            self._rank(ids[low:high], *[np.concatenate(parts) for parts in zip(*found)])

    def _rank(self, ids: np.ndarray, doc: np.ndarray, clause: np.ndarray, part: np.ndarray) -> None:
        shape = len(ids), self.n_queries
        size = shape[0] * shape[1]
        key = doc * self.n_queries + self.query[clause]
        scores = ~self.must_not[clause]
        scaled = part[scores] * 2.0**20
        whole = np.floor(scaled)
        # whole numbers below 2^53, so exact in any order
        wholes = np.bincount(key[scores], whole, size)
        rests = np.bincount(key[scores], np.floor((scaled - whole) * 2.0**40), size)
        bad = np.bincount(key[~scores], minlength=size) > 0
        # a clause that matches in several fields is one
        one = np.unique((doc * len(self.query) + clause)[self.must[clause]])
        got = np.bincount((one // len(self.query)) * self.n_queries + self.query[one % len(self.query)], minlength=size)
        fits = (np.bincount(key[scores], minlength=size) > 0) & ~bad & (got == np.tile(self.needed, shape[0]))
        score = np.rint((wholes + rests / 2.0**40) / 2.0**20 * 10.0**self.digits) / 10.0**self.digits
        at = np.flatnonzero(fits & (score >= np.tile(self.floor, shape[0])))
        row, query = np.divmod(at, self.n_queries)
        query = np.append(self.best_query, query)
        doc, score = np.append(self.best_doc, ids[row]), np.append(self.best_score, score[at])
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.best_query, self.best_doc, self.best_score = query[kept], doc[kept], score[kept]
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]


def _ranker(sent, average: np.ndarray, schema: T.StructType):
    def run(documents: Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
        scorer, begun = sent.value, False
        for ids, fields in documents:
            ids = ids.to_numpy(zero_copy_only=False)
            if not begun:
                scorer.start(ids.dtype)
                begun = True
            scorer.add(ids, fields, average)
        if begun:
            yield pa.RecordBatch.from_arrays(
                [pa.array(scorer.best_query), pa.array(scorer.best_doc), pa.array(scorer.best_score)], names=schema.names)

    return run


def best_of_clauses(docs: DataFrame, wanted: DataFrame, best: int, boosts: Mapping[str, float], rarity: str, digits: int) -> DataFrame | None:
    """(query_id, doc_id, score), for each task the ``best`` documents of each query; nothing if the clauses are too many to send.

    ``wanted`` is (query_id, words, field, occur, boost), written out; see ``bm25_clauses``. ``doc_id`` is a whole number.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return None
    queries = materialize(wanted.select("query_id").distinct().withColumn("query_no", F.monotonically_increasing_id()), "queries")
    words, asking = wanted.agg(F.sum(F.size("words"))).first()[0] or 0, queries.count()
    if words > SENT_WORDS or asking * best > HELD:
        return None
    clauses = wanted.join(queries, "query_id").select("query_no", "words", "field", "occur", "boost").collect()
    literals = {tuple(c.words): None for c in clauses}
    literals |= {(word,): None for literal in literals for word in literal}
    place = {literal: i for i, literal in enumerate(literals)}
    schema = T.StructType([T.StructField("query_no", T.LongType()), docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if not clauses:
        return queries.join(spark.createDataFrame([], schema), "query_no").select("query_id", "doc_id", "score")
    phrases = sent_phrases(name_phrases(spark.createDataFrame([(i, list(p)) for p, i in place.items()], "phrase_id BIGINT, words ARRAY<STRING>")))
    counted = scan(docs, "phrase_id BIGINT, field BIGINT, n BIGINT", _counter(spark.sparkContext.broadcast(phrases)))
    # three rows at most of each word or phrase that was sent
    counts = {(r.phrase_id, r.field): r.n for r in counted.groupBy("phrase_id", "field").agg(F.sum("n").alias("n")).collect()}
    n_docs = counts.get((_DOCS, 0), 0)
    average = np.array([counts.get((_TOKENS, i), 0) / max(1, n_docs) for i in range(len(FIELDS))])

    def idf(literal: tuple[str, ...], field: int) -> float:
        df = counts.get((place[literal], field), 0)
        return math.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if df else 0.0

    rated = {literal: [idf(literal, i) if rarity == "phrase" else math.fsum(idf((word,), i) for word in literal) for i in range(len(FIELDS))]
             for literal in {tuple(c.words) for c in clauses}}
    at = np.empty(len(phrases.ids), np.int64)
    at[phrases.ids] = np.arange(len(phrases.ids))
    numbers, query = np.unique([c.query_no for c in clauses], return_inverse=True)
    weights = np.array([[c.boost * boosts.get(name, 0.0) * rate for name, rate in zip(FIELDS, rated[tuple(c.words)])] for c in clauses])
    admitted = np.array([[name in boosts and c.field in (None, name) for name in FIELDS] for c in clauses])
    occurs = np.array([c.occur for c in clauses])
    scorer = _Scorer(phrases, at[[place[tuple(c.words)] for c in clauses]], query, weights, admitted, occurs == "must", occurs == "must_not", best, digits)
    found = scan(docs, schema, _ranker(spark.sparkContext.broadcast(scorer), average, schema))
    numbered = spark.createDataFrame([(i, int(no)) for i, no in enumerate(numbers)], "place BIGINT, query_no BIGINT")
    return found.withColumnRenamed("query_no", "place").join(numbered, "place").join(queries, "query_no").select("query_id", "doc_id", "score")
