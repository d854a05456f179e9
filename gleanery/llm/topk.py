"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order in which like ones stand together and cut into blocks of documents. Each block has a
forward index (its vectors) and, per term (component), the largest and the least weight in it; a query's sum over the
terms of the better of the two bounds every score in the block. A query visits blocks by descending bound and stops
as soon as no bound can beat its k-th hit.

Blocks form groups. A query is first answered in the group in which it stands; the k-th hit found there is a threshold
that holds everywhere. Then queries and groups meet in cells of a grid, each of bounded size on both sides, and
each query's best of all groups are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.ordering import ranked
from gleanery.session import materialize

#: Components become integers in units of 1 / SCALE.
SCALE = 1024
BLOCK_ROWS = 256
#: Rows of a group and queries of a cell, at most; fewer if vectors are so wide that CELL_BYTES would be passed.
GROUP_ROWS, CELL_QUERIES, CELL_BYTES = 8_192, 4_096, 64 << 20
#: Vectors that order the others, drawn by hash: a bounded sample that only decides which rows stand together.
PIVOTS = 64
#: Queries that are scored at a time.
TILE = 256
_LEAST = np.iinfo(np.int64).min


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


class Group:
    """Blocks of vectors of one width, ready to be searched."""

    def __init__(self, ids: list[int | None], ranks: np.ndarray, x: np.ndarray, block_rows: int = BLOCK_ROWS):
        self.ids, self.ranks, self.x, self.m = ids, ranks, x, len(ids)
        top = np.iinfo(np.int64).max
        keys = np.array([top if i is None else i for i in ids], np.int64)
        self.order = np.lexsort((ranks, [i is None for i in ids], keys))
        self.sorted_keys = [ids[i] for i in self.order if ids[i] is not None]
        #: what an equal score is worth: the smaller the id, the more
        self.worth = np.empty(self.m, np.int64)
        self.worth[self.order] = np.arange(self.m)[::-1]
        starts = np.arange(0, self.m, block_rows)
        self.blocks = [(s, min(s + block_rows, self.m)) for s in starts]
        self.high = np.maximum.reduceat(x, starts, axis=0) if self.m else x
        self.low = np.minimum.reduceat(x, starts, axis=0) if self.m else x
        self.best_worth = np.maximum.reduceat(self.worth, starts) if self.m else self.worth
        self.largest = float(np.abs(x).max()) if x.size else 0.0
        self.visited = 0

    def search(self, q: np.ndarray, k: int, own: np.ndarray, beat: list[tuple[int, int | None] | None]) -> Iterator[tuple[int, int, int]]:
        """(query, row, score) of each query's best ``k`` rows here, apart from row ``own`` (-1: none), that are better
        than the hit ``beat`` (score, id)."""
        bound = (float(np.abs(q).max()) if q.size else 0.0) * self.largest * max(1, self.x.shape[1])
        if bound * max(1, self.m) >= 2.0**52:
            yield from self._search_large(q, k, own, beat)
            return
        for first in range(0, len(q), TILE):
            part = slice(first, first + TILE)
            for i, row, score in self._search_tile(q[part], k, own[part], beat[part]):
                yield first + i, row, score

    def _floor(self, beat: tuple[int, int | None] | None) -> int:
        """The value that a hit must pass to be better than ``beat``."""
        if beat is None:
            return _LEAST
        score, name = beat
        before = len(self.sorted_keys) if name is None else int(np.searchsorted(np.array(self.sorted_keys, np.int64), name))
        return int(score) * self.m + self.m - 1 - before

    def _search_tile(self, q, k, own, beat) -> Iterator[tuple[int, int, int]]:
        m, n = self.m, len(q)
        bounds = (np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T).astype(np.int64) * m + self.best_worth
        order = np.argsort(-bounds, axis=1, kind="stable")
        least = np.array([self._floor(b) for b in beat], np.int64)
        best = np.full((n, k), _LEAST, np.int64)
        kth, done, step = least.copy(), 0, 1
        while done < len(self.blocks):
            take = order[:, done : done + step]
            query, place = np.nonzero(np.take_along_axis(bounds, take, 1) > kth[:, None])
            if not len(query):
                break  # bounds only fall from here
            wanted = take[query, place]
            for b in np.unique(wanted):
                rows = query[wanted == b]
                start, stop = self.blocks[b]
                self.visited += len(rows)
                value = (q[rows] @ self.x[start:stop].T).astype(np.int64) * m + self.worth[start:stop]
                mine = np.flatnonzero((own[rows] >= start) & (own[rows] < stop))
                value[mine, own[rows][mine] - start] = _LEAST
                both = np.concatenate([best[rows], value], axis=1)
                best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth = np.maximum(least, best.min(axis=1))
            done, step = done + step, step * 2
        for i in range(n):
            for value in best[i]:
                if value > least[i]:
                    yield i, int(self.order[m - 1 - int(value % m)]), int(value // m)

    def _search_large(self, q, k, own, beat) -> Iterator[tuple[int, int, int]]:
        """The same for weights beyond the exact range of doubles, by integers of any size."""
        rows = [[int(v) for v in row] for row in self.x]
        for i, vector in enumerate(q):
            vector, floor = [int(v) for v in vector], self._floor(beat[i])
            values = (
                (sum(map(int.__mul__, vector, row)) * self.m + int(self.worth[j]), j) for j, row in enumerate(rows) if j != own[i])
            for value, j in heapq.nlargest(k, (v for v in values if beat[i] is None or v[0] > floor)):
                yield i, j, value // self.m


def _clamped(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _groups(ids: list, ranks: np.ndarray, widths: np.ndarray, vectors: pa.Array, block_rows: int) -> Iterator[tuple[int, np.ndarray, Group]]:
    """(width, rows, group) of each width among the rows."""
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield int(width), rows, Group([ids[i] for i in rows], ranks[rows], _matrix(vectors.take(pa.array(rows)), int(width)), block_rows)


def _integers(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column) -> DataFrame:
    """vec_id, query, x (array of doubles) of the rows that take part."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"),
        F.col(vector_column).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > np.finfo(float).max / SCALE))
    return rows.filter(F.col("x").isNotNull() & ~F.coalesce(odd, F.lit(True)))


def _with_pivot(rows: DataFrame) -> DataFrame:
    """vec_id, query, width, pivot and the integer vector as doubles."""
    drawn = rows.select("x", F.xxhash64("x").alias("h")).orderBy("h").limit(PIVOTS).collect()
    pivots: dict[int, list] = {}
    for r in drawn:
        pivots.setdefault(len(r["x"]), []).append(r["x"])
    pivots = {w: np.array(p, float).reshape(len(p), w) for w, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            widths = np.diff(np.asarray(x.offsets))
            flat = np.asarray(x.flatten())
            ends = np.cumsum(widths)
            pivot = np.full(len(widths), -1)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                if width in pivots and width:
                    own = flat[(ends[rows] - width)[:, None] + np.arange(width)]
                    pivot[rows] = np.argmax(own @ pivots[width].T, axis=1)
            data = np.floor(flat * SCALE)
            cells = [data[e - w : e].tobytes() for e, w in zip(ends, widths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("query"), pa.array(widths, pa.int32()), pa.array(pivot, pa.int32()), pa.array(cells, pa.binary())],
                names=["vec_id", "query", "width", "pivot", "vector"])

    return rows.select("vec_id", "query", "x").mapInArrow(run, "vec_id long, query boolean, width int, pivot int, vector binary")


_HITS = "array<struct<vec_id: long, score: long, rank: long>>"
_HIT = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())]))


def _at_home(rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The queries with their hits in their own group. ``rows``: group, rank, vec_id, query, width, vector."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rank")
        ids, ranks = table.column("vec_id").to_pylist(), np.asarray(table.column("rank"))
        asks, vectors = np.asarray(table.column("query")), table.column("vector").combine_chunks()
        hits: dict[int, list] = {int(i): [] for i in np.flatnonzero(asks)}
        for width, here, group in _groups(ids, ranks, np.asarray(table.column("width")), vectors, block_rows):
            own = np.flatnonzero(asks[here])
            for i, j, score in group.search(group.x[own], k, own, [None] * len(own)):
                hits[int(here[own[i]])].append({"vec_id": group.ids[j], "score": _clamped(score), "rank": int(group.ranks[j])})
        out = table.take(pa.array(list(hits), pa.int64()))
        return out.append_column("hits", pa.array(list(hits.values()), _HIT))

    return rows.groupBy("group").applyInArrow(run, f"{_schema(rows)}, hits {_HITS}")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _score_cell(k: int, block_rows: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        blocks, queries = blocks.combine_chunks(), queries.combine_chunks()
        if len(blocks) and len(queries):
            blocks = blocks.sort_by("rank")
            asked = np.asarray(queries.column("width"))
            for width, _, group in _groups(
                    blocks.column("vec_id").to_pylist(), np.asarray(blocks.column("rank")), np.asarray(blocks.column("width")),
                    blocks.column("vector").combine_chunks(), block_rows):
                own = np.flatnonzero(asked == width)
                part = queries.take(pa.array(own, pa.int64()))
                beat = [None if b is None else (b["score"], b["vec_id"]) for b in part.column("beat").to_pylist()]
                x = _matrix(part.column("vector"), width)
                name, query_id = part.column("rank").to_pylist(), part.column("vec_id").to_pylist()
                for i, j, score in group.search(x, k, np.full(len(own), -1), beat):
                    found.append((name[i], query_id[i], group.ids[j], _clamped(score), int(group.ranks[j])))
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "query_id", "vec_id", "score", "rank"), columns, strict=True)})

    return run


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows with the largest integer inner product per query.

    Components count as floor(SCALE * x). Queries are the rows for which ``is_query`` holds; a query meets every row of
    its own width but itself, so a repeat of it is an ordinary hit and both repeats ask. Equal scores go to the smaller
    id, null ids last. Vectors that are null or hold a null, a non-finite component or one whose multiple is
    not finite take no part. Scores beyond a long are clamped to its range. Fewer than ``k`` rows
    give all; no query or no row gives an empty result. Other columns are left out.
    """
    rows = ranked(_with_pivot(_integers(vectors, id_column, vector_column, is_query)), [], ["width", "pivot", "vec_id"], "vectors")
    size = rows.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0)), F.count_if("query")).first()
    widest = max(1, size[1]) * 8
    group_rows, cell_queries = (max(1, min(most, CELL_BYTES // widest)) for most in (group_rows, cell_queries))
    groups, chunks = -(-size[0] // group_rows), max(1, -(-size[2] // cell_queries))
    group = F.floor(F.col("rank") / group_rows).cast("long").alias("group")
    rows = rows.select(group, "rank", "vec_id", "query", "width", "vector")
    home = materialize(_at_home(rows, k, block_rows), "home")
    first = home.select(F.col("rank").alias("query"), F.col("vec_id").alias("query_id"), F.explode("hits").alias("hit")).select(
        "query", "query_id", "hit.vec_id", "hit.score", "hit.rank")
    hits = first
    if groups > 1 and size[2]:
        last = F.array_sort("hits", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] < b["score"], 1).otherwise(-1)).when(
            a["vec_id"].isNull() | (a["vec_id"] > b["vec_id"]), 1).otherwise(-1))
        asking = home.withColumn("beat", F.when(F.size("hits") >= k, F.element_at(last, k))).select(
            F.col("group").alias("home"), "rank", "vec_id", "width", "vector", "beat", F.pmod(F.xxhash64("rank"), F.lit(chunks)).alias("chunk"))
        asking = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).filter(F.col("group") != F.col("home"))
        blocks = rows.select("group", "rank", "vec_id", "width", "vector", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")).alias("chunk"))
        far = blocks.groupBy("group", "chunk").cogroup(asking.drop("home").groupBy("group", "chunk")).applyInArrow(
            _score_cell(k, block_rows), "query long, query_id long, vec_id long, score long, rank long")
        hits = first.unionByName(far)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rank"))
    return hits.withColumn("place", place).filter(F.col("place") <= k).select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")
