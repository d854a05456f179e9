"""Exact Jaccard join of word-shingle sets by a token-group matrix.

1. Documents with the same set are one class; only its smallest document goes on.
2. Groups: each document stands with the most typical one among those that agree with it in a min-hash, whether
   or not the two link; a large group is kept as chunks of bounded size. Links found on the way make components.
3. Matrix: per token the groups whose union holds it. Only the tokens that stand first in a global order are
   needed: a linked pair shares one among the first n - ceil(t n) + 1 of each. Very frequent tokens stand last.
4. Bound: a query document and a group that holds a larger component meet where they share such a token, once per
   token and group. For a group of one, how many of the first tokens lie outside the other bounds the overlap.
5. Only groups that may hold a link are opened: a group and its queries meet in one place, and a query is compared
   exactly with all members at once. A link is told only where it joins members that were not joined before.

Links inside a component change nothing, so no step lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import words as wd
from gleanery.llm.components import connected_components
from gleanery.session import materialize

#: Min-hash values of a document, for finding groups only.
SIGNATURE = 8
#: Members of a chunk of a group, on average, and tokens of all of them.
CHUNK = 512
CHUNK_TOKENS = 1 << 18
#: Queries that pass one copy of an opened chunk, on average.
SLICE = 4096
#: A token is frequent if it leads in more than one of so many documents, and in more than 4. There are at most FREQUENT
#: times the mean number of leading tokens of them, whatever the number of documents: they are broadcast.
FREQUENT = 50_000
FREQUENT_LEAST = 4

_U = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct k-word shingles of every text; a shorter text is one shingle as a whole."""
    data, starts = wd.joined(texts, lower=True)
    begin, end = wd.bounds(data)
    first = np.searchsorted(begin, starts)
    words = wd.hashes(data, begin, end)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    win = wd.windows(words, k)
    inside = row[: len(win)] == row[k - 1 :] if len(win) else np.zeros(0, bool)
    rows, tokens = [row[: len(win)][inside]], [win[inside]]
    counts = np.diff(first)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        rows.append(np.array([i]))
        tokens.append(wd.windows(words[first[i] : first[i + 1]], int(counts[i])) + _U(counts[i]))
    rows, tokens = np.concatenate(rows), np.concatenate(tokens) >> _U(2)
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[new], tokens[new]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))


def _leading(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first tokens a set of each size needs: a linked set has one of them, and among its own."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _short(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint32).view(np.int32)


def frequent_tokens(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Short names of tokens that lead in many documents when the order is by hash alone, counted over all documents.

    A token that shares the name of a frequent one stands late as well: any order that is the same everywhere will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in wd.chunks(batch.column(0)):
                rows, tokens = shingle_sets(batch.column(0).slice(start, stop - start), k)
                n = np.bincount(rows, minlength=stop - start)
                first = np.concatenate([[0], np.cumsum(n)])
                keep = np.arange(len(tokens)) - first[rows] < _leading(n, percent)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(_short(tokens[keep]))], names=["token"])

    least = max(FREQUENT_LEAST, docs.count() // FREQUENT)
    found = _texts(docs).mapInArrow(run, "token int").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return np.sort(np.array([r["token"] for r in found.select("token").toLocalIterator()], np.int32))


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """Per document: set size, a 128-bit name of the set, and min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in wd.chunks(batch.column(0)):
                part = batch.slice(start, stop - start)
                rows, tokens = shingle_sets(part.column(0), k)
                n = np.bincount(rows, minlength=part.num_rows)
                first = np.concatenate([[0], np.cumsum(n)])
                filled = np.flatnonzero(n)
                names = np.zeros((2, part.num_rows), _U)
                signs = np.zeros((part.num_rows, SIGNATURE), _U)
                if len(filled):
                    with np.errstate(over="ignore"):
                        for j in range(2):
                            names[j, filled] = np.add.reduceat(wd.mix(tokens + _U(0xA5A5 + j)), first[filled])
                        for j in range(SIGNATURE):
                            signs[filled, j] = np.minimum.reduceat(wd.mix(tokens ^ _U(0x9E3779B97F4A7C15 * (2 * j + 1) & (2**64 - 1))), first[filled])
                yield pa.RecordBatch.from_arrays([
                    part.column(1), pa.array(n.astype(np.int64)), pa.array(wd.signed(names[0])), pa.array(wd.signed(names[1])),
                    pa.ListArray.from_arrays(np.arange(0, SIGNATURE * part.num_rows + 1, SIGNATURE, np.int32), pa.array(wd.signed(signs.ravel()))),
                ], names=["doc_id", "n", "name1", "name2", "signs"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, name1 long, name2 long, signs array<long>")


def _leading_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, at, token): the first tokens of each set of ``n`` in the global order, of those that two documents or more have.

    Most tokens lead in one document only. They leave here, in narrow rows that are shuffled once, before groups are known.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for start, stop in wd.chunks(batch.column(0)):
                part = batch.slice(start, stop - start)
                rows, tokens = shingle_sets(part.column(0), k)
                if len(frequent):
                    short = _short(tokens)
                    place = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
                    tokens = tokens | ((frequent[place] == short).astype(_U) << _U(62))
                    tokens = tokens[np.lexsort((tokens, rows))]
                n = np.bincount(rows, minlength=part.num_rows)
                at = np.arange(len(tokens)) - np.concatenate([[0], np.cumsum(n)])[rows]
                keep = np.flatnonzero(at < _leading(n, percent)[rows])
                own = rows[keep]
                # what rows of a document have in common stands first, so it packs well
                yield pa.RecordBatch.from_arrays([
                    part.column(1).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(at[keep].astype(np.int32)),
                    pa.array(wd.signed(tokens[keep]))], names=["doc_id", "n", "at", "token"])

    every = _texts(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, n int, at int, token long")
    holders = W.partitionBy("token")
    return every.withColumns({"least": F.min("doc_id").over(holders), "top": F.max("doc_id").over(holders)}).filter(
        "least <> top").drop("least", "top")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compressed texts of the documents in ``wanted`` (``doc_id``). The joins are alike at every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [press((x or "").encode()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "z"])

    return _texts(docs).mapInArrow(run, "doc_id long, z binary").join(wanted.distinct().hint("merge"), "doc_id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets have the similarity asked for. A text ``b`` meets those that ask for it in cells,
    so each text moves twice, however often it stands in a pair."""
    opened = pairs.groupBy("b").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    members = opened.select(
        F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"),
        F.lit(False).alias("asks"), F.col("b").alias("doc_id"))
    asking = pairs.join(opened, "b").select(
        F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), "slices").cast("int").alias("slice"), F.lit(True).alias("asks"),
        F.col("a").alias("doc_id"))
    cells = members.unionByName(asking).select("centre", F.lit(0).cast("long").alias("chunk"), "slice", "asks", "doc_id", F.col("doc_id").alias("part"))
    return _cell_links(docs, materialize(cells, "pair-cells"), k, percent)


def _typical_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): each document and the most typical of those it shares min-hashes with, where there are any."""
    keys = heads.select("doc_id", F.posexplode("signs").alias("j", "sign"))
    counts = keys.groupBy("j", "sign").agg(F.count("*").alias("n")).filter("n > 1")
    met = keys.join(counts, ["j", "sign"])
    fame = met.groupBy("doc_id").agg(F.sum("n").alias("fame"))
    known = met.drop("n").join(fame, "doc_id")
    centre = known.groupBy("j", "sign").agg(F.max_by("doc_id", F.struct("fame", -F.col("doc_id"))).alias("b"))
    votes = known.join(centre, ["j", "sign"]).filter("doc_id <> b").groupBy("doc_id", "b").agg(F.count("*").alias("votes"))
    return votes.groupBy(F.col("doc_id").alias("a")).agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))


def _fits(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets of sizes ``n`` and ``m`` that share ``overlap`` tokens are linked."""
    return (100 + percent) * overlap >= percent * (n + m)


def _qualifying(rows: DataFrame, percent: int, leading: DataFrame | None = None) -> DataFrame:
    """(query, grp): query and group whose bounds allow a link. ``rows``: documents with ``part`` (component),
    ``part_size``, ``grp`` and ``grp_size``; ``leading``: their leading tokens (doc_id, n, at, token), unless ``rows`` hold them as lists.

    Tokens stand in one order everywhere. The first one that a query shares with a member has only tokens
    before it that the other lacks, which bounds their overlap; a pair without such a token has no link. Of two
    components the smaller asks the larger, so a pair is met once.
    """
    if leading is None:
        leading = rows.select("doc_id", "n", F.posexplode("leading").alias("at", "token"))
    known = rows.select("doc_id", F.struct("part_size", "part").alias("rank"), "grp", "grp_size").distinct()
    holders = W.partitionBy("token")
    met = leading.join(known, "doc_id").withColumns({"least": F.min("rank").over(holders), "top": F.max("rank").over(holders)})
    met = materialize(met.filter("least <> top").drop("least"), "matrix")
    queries = met.filter(F.col("rank") < F.col("top")).select(
        "token", F.col("doc_id").alias("query"), F.col("n").alias("q_n"), F.col("at").alias("i"), F.col("rank").alias("q_rank"))
    # one row per token and group, however many components its members belong to
    groups = met.groupBy("token", "grp").agg(
        F.max("at").alias("j"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rank").alias("g_rank"),
        (F.max("grp_size") == 1).alias("alone"))
    q_n, low = F.col("q_n"), F.col("low")
    may = (
        (F.col("q_rank") < F.col("g_rank")) & (100 * F.col("high") >= percent * q_n) & (percent * low <= 100 * q_n)
        & _fits(q_n - F.col("i"), q_n, low, percent) & (~F.col("alone") | _fits(low - F.col("j"), q_n, low, percent))
    )
    # tokens up to the last one found here that are not counted are known to lie outside
    found = queries.join(groups, "token").filter(may).groupBy("query", F.col("q_n").alias("n"), "grp").agg(
        F.count("*").alias("c"), (F.max("i") + 1).alias("upto"), (F.max("j") + 1).alias("upto_g"),
        F.first("alone").alias("alone"), F.min("low").alias("low"))
    # of several members, a token may lie in one behind its own leading tokens: such a group is opened
    out_q, out_g = (F.when(F.col("alone"), F.greatest(F.lit(0), F.col(upto) - F.col("c"))).otherwise(0) for upto in ("upto", "upto_g"))
    overlap = F.least(F.col("n") - out_q, F.when(F.col("alone"), F.col("low") - out_g).otherwise(F.col("n")))
    likely = found.withColumns({"out_q": out_q, "out_g": out_g}).filter(
        _fits(overlap, F.col("n"), F.greatest("low", F.floor((F.col("n") * percent + 99) / 100)), percent)
        & _fits((F.col("n") + F.col("low") - out_q - out_g) / 2, F.col("n"), F.col("low"), percent) | ~F.col("alone"))
    return likely.select("query", "grp").distinct()


class _Tile:
    """The members of an opened group, whose tokens are numbered so that a query counts all overlaps by one gather."""

    def __init__(self) -> None:
        self.docs, self.parts, self.sets = [], [], []

    def add(self, doc: int, part: int, tokens: np.ndarray) -> None:
        self.docs.append(doc)
        self.parts.append(part)
        self.sets.append(tokens)

    def close(self) -> None:
        self.size = np.array([len(x) for x in self.sets])
        self.begin = np.cumsum(self.size) - self.size
        self.vocabulary, self.at = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.mark = np.zeros(len(self.vocabulary), bool)
        self.part = np.array(self.parts)
        self.root = np.unique(self.part, return_inverse=True)[1]
        self.sets = []

    def ask(self, part: int, tokens: np.ndarray, percent: int) -> list[int]:
        """Members linked with a query of another component, one of each set of members not joined in this tile before."""
        if self.sets:
            self.close()
        if not self.docs:
            return []
        place = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        place = place[self.vocabulary[place] == tokens]
        self.mark[place] = True
        both = np.add.reduceat(self.mark[self.at], self.begin, dtype=np.int64)
        self.mark[place] = False
        linked = np.flatnonzero((100 * both >= percent * (self.size + len(tokens) - both)) & (self.part != part))
        if not len(linked):
            return []
        roots, first = np.unique(self.root[linked], return_index=True)
        self.root[np.isin(self.root, roots)] = roots[0]
        return [self.docs[i] for i in linked[first]]


def _opened_links(docs: DataFrame, likely: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links of queries and members of the groups they open, enough of them to join what is linked.

    A group and up to SLICE of its queries, on average, are a cell; members come first and stay, queries pass by.
    """
    opened = likely.groupBy("grp").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    known = rows.select("doc_id", "grp", "part").distinct()
    members = known.join(opened, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"), F.lit(False).alias("asks"), "doc_id", "part")
    asking = likely.join(opened, "grp").select(
        "grp", F.pmod(F.xxhash64("query"), "slices").cast("int").alias("slice"), F.lit(True).alias("asks"), F.col("query").alias("doc_id"))
    asking = asking.join(known.select("doc_id", "part").distinct(), "doc_id")
    cells = members.unionByName(asking).select("grp.centre", "grp.chunk", "slice", "asks", "doc_id", "part")
    return _cell_links(docs, materialize(cells, "cells"), k, percent)


def _cell_links(docs: DataFrame, cells: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links of the queries and members of each cell. ``cells``: centre, chunk, slice, asks (a query), doc_id, part."""
    spark = docs.sparkSession
    key = ["centre", "chunk", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, tile = None, _Tile()
        for batch in batches:
            for start, stop in wd.chunks(batch.column(5)):
                part = batch.slice(start, stop - start)
                found, tokens = shingle_sets(pa.array([unpack(z).decode() for z in part.column(5).to_pylist()], pa.large_string()), k)
                bounds = np.searchsorted(found, np.arange(part.num_rows + 1))
                a, b = [], []
                names = zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)
                facts = zip(*(part.column(c).to_pylist() for c in (3, 4, 6)), strict=True)
                for i, (name, (asks, doc, component)) in enumerate(zip(names, facts, strict=True)):
                    if name != now:
                        now, tile = name, _Tile()
                    own = tokens[bounds[i] : bounds[i + 1]]
                    if not len(own):
                        continue
                    if asks:
                        hit = tile.ask(component, own, percent)
                        a += [doc] * len(hit)
                        b += hit
                    else:
                        tile.add(doc, component, own)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    full = cells.join(_packed(docs, cells.select("doc_id")), "doc_id").select(*key, "asks", "doc_id", "z", "part")
    # a number of partitions that stays: the rows are small and the work on them is not
    dealt = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "asks")
    return dealt.mapInArrow(run, "a long, b long")


def _grouped(heads: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """Heads with their component so far (``part``) and its size, and their chunk of the documents around one typical
    document (``grp``) with the number of those documents."""
    parts = materialize(connected_components(links), "parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("part_size"))
    known = parts.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("part"), "part_size")
    stars = heads.select("doc_id", "n").join(near.withColumnRenamed("a", "doc_id"), "doc_id", "left").withColumn("centre", F.coalesce("b", "doc_id"))
    stars = materialize(stars.select("doc_id", "n", "centre"), "stars")
    # a typical document that stands with another one has a group of the others still; of these it is no member
    around = stars.groupBy("centre").agg(F.count("*").alias("grp_size"), F.sum("n").alias("tokens"))
    chunks = F.greatest(F.ceil(F.col("grp_size") / CHUNK), F.ceil(F.col("tokens") / CHUNK_TOKENS))
    placed = stars.drop("n").join(around, "centre").withColumn(
        "grp", F.struct("centre", F.pmod(F.xxhash64("doc_id"), chunks).alias("chunk"))).drop("centre", "tokens").distinct()
    return heads.join(placed, "doc_id").join(known, "doc_id", "left").withColumns({
        "part": F.coalesce("part", "doc_id"), "part_size": F.coalesce("part_size", F.lit(1))})


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest document reachable by links, per row of ``docs``.

    Sets are the distinct shingles of ``k`` lower-cased (A-Z) words; a text of fewer words is one shingle. Two
    documents link if their sets' intersection is ``percent`` percent of the union or more. All links between
    different texts are found.

    Null and wordless texts have no shingle and link with nothing. Rows with the same set are in one component;
    rows with the same id are one document, whose links are those of any of its texts; a row with a null id joins its set's component and never names one (null if alone).
    An empty table gives an empty result; further columns are ignored.
    """
    profiles = materialize(_profiles(docs, k), "profiles")
    names = profiles.filter("n > 0 and doc_id is not null").groupBy("name1", "name2", "n").agg(
        F.min("doc_id").alias("head"), F.count("*").alias("rows"))
    # narrow rows: the copies that do not go on
    others = profiles.select("doc_id", "name1", "name2", "n").join(names.filter("rows > 1"), ["name1", "name2", "n"]).filter(
        "doc_id <> head").select("doc_id", "name1", "name2")
    heads = profiles.filter("n > 0 and doc_id is not null").join(others.hint("merge"), ["doc_id", "name1", "name2"], "left_anti")
    heads = materialize(heads.select("doc_id", "n", "signs"), "heads")

    near = materialize(_typical_pairs(heads), "typical")
    links = materialize(_verified(docs, near, k, percent), "links")
    grouped = materialize(_grouped(heads.drop("signs"), near, links), "grouped")
    likely = materialize(_qualifying(grouped, percent, _leading_tokens(docs, k, percent)), "likely")
    more = _opened_links(docs, likely, grouped, k, percent)
    parts = connected_components(materialize(links.union(more), "all-links"))

    classes = names.join(parts.select(F.col("node").alias("head"), "component"), "head", "left").select(
        "name1", "name2", "n", F.coalesce("component", "head").alias("component_id"))
    rows = profiles.select("doc_id", "n", "name1", "name2")
    return rows.join(classes, ["name1", "name2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
