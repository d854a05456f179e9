"""Substring dedup: words covered by a window of words that an earlier document has too.

Documents are never held against the whole corpus. Each window of 13 words is led by its smallest 4-word
shingle by hash, its anchor, which depends on the window's words alone. Windows in a row with the same
anchor make a segment. Only anchors found in two documents or more matter; their segments go to the shard
of the anchor, so all copies of a window meet in one shard. A shard builds a compressed FM-index of its
distinct segments and streams the segments against it: backward search gives the interval of each window,
and with it the smallest document that has it. An anchor in very many documents is spread by whole windows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as wd
from gleanery.llm.fm_index import FMIndex
from gleanery.session import materialize

WINDOW = 13
ANCHOR = 4
#: Anchors in more documents are spread over shards by window.
HOT = 2_000
#: Words of segments per shard, about.
SHARD_WORDS = 300_000
#: Windows searched at a time.
STREAM = 1 << 17

_U = np.uint64
_LAST = np.iinfo(np.int64).max
_SCHEMA = "doc_id long, name long, starts array<int>, ends array<int>"


def _name(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window of WINDOW words in one text: its row, its first word, its anchor's hash and place."""
    none = np.zeros(0, np.int64)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return none, none, np.zeros(0, _U), none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    shingles = wd.windows(words, ANCHOR)
    # the first of the smallest of 1, 2, 4, 8 shingles from each place on, then of all by two overlapping runs
    best, place = shingles, np.arange(len(shingles))
    width, count = 1, WINDOW - ANCHOR + 1
    while width < count:
        step = min(width, count - width)
        less = best[step:] < best[:-step]
        best, place = np.where(less, best[step:], best[:-step]), np.where(less, place[step:], place[:-step])
        width += step
    best, place = best[at], place[at]
    return row[at], at, best, place


def _words(batch: pa.Array) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one blank between words, all of them, word bounds, hashes, and each row's first word."""
    texts = [b" ".join(x.split()) for x in batch]
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    begin, end = wd.bounds(raw)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    return texts, data, begin, end, wd.hashes(raw, begin, end), np.searchsorted(begin, starts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor), once per row and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in wd.chunks(batch.column(1)):
                part = batch.slice(start, stop - start)
                *_, hashes, first = _words(_bytes(part.column(1)))
                row, _, anchor, _ = _anchors(hashes, first)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row[new])), pa.array(wd.signed(anchor[new]))], names=["doc_id", "anchor"])

    return docs.mapInArrow(run, "doc_id long, anchor long")


def _segments(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block): the segments of repeated anchors. ``docs``: doc_id, z (packed text), cold, hot (anchors).

    Of equal segments in a batch only the smallest document's is looked up; the others are covered for certain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found: dict[bytes, list[tuple[int, int, int]]] = {}
                shard_of: dict[bytes, int] = {}
                ids = part.column(0).to_pylist()
                raw = [unpack(z) for z in part.column(1).to_pylist()]
                texts, data, begin, end, hashes, first = _words(raw)
                row, at, anchor, place = _anchors(hashes, first)
                names = [_name(x) for x in raw]
                for column, whole in ((2, False), (3, True)):
                    lists = part.column(column).to_pylist()
                    listed = np.concatenate([np.zeros(0, _U), *(
                        wd.mix(np.array(x or [], np.int64).view(_U)) ^ wd.mix(np.full(len(x or []), i + 1, _U)) for i, x in enumerate(lists))])
                    take = np.flatnonzero(np.isin(wd.mix(anchor) ^ wd.mix(row.astype(_U) + _U(1)), listed))
                    if not len(take):
                        continue
                    new = np.ones(len(take), bool)
                    if not whole:
                        new[1:] = (place[take[1:]] != place[take[:-1]]) | (at[take[1:]] != at[take[:-1]] + 1)
                    heads = take[new]
                    tails = take[np.concatenate([new[1:], [True]])]
                    keys = wd.windows(hashes, WINDOW)[at[heads]] if whole else anchor[heads]
                    for h, t, r, key in zip(at[heads].tolist(), at[tails].tolist(), row[heads].tolist(), keys.tolist(), strict=True):
                        content = data[begin[h] : end[t + WINDOW - 1]]
                        doc = _LAST if ids[r] is None else ids[r]
                        found.setdefault(content, []).append((doc, names[r], h - int(first[r])))
                        shard_of[content] = (key >> 8) % shards
                blocks: dict[int, list] = {}
                for content, where in found.items():
                    least = min(where)[0]
                    asked = [x for x in where if x[0] == least]
                    blocks.setdefault(shard_of[content], []).append((content, asked, [x for x in where if x[0] != least]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(blocks), pa.int32()), pa.array([press(pickle.dumps(x)) for x in blocks.values()], pa.binary())],
                    names=["shard", "block"])

    return docs.mapInArrow(run, "shard int, block binary")


def _earliest(contents: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every window of every segment, the smallest document with that window; by an FM-index of all."""
    raw = np.frombuffer(b"\n".join([*contents, b""]), np.uint8)
    begin, end = wd.bounds(raw)
    hashes = wd.hashes(raw, begin, end)
    _, ids = np.unique(hashes, return_inverse=True)
    lengths = np.array([x.count(b" ") + 1 for x in contents])
    ends = np.cumsum(lengths + 1)
    symbols = np.zeros(int(ends[-1]), np.int64)
    owner = np.repeat(np.arange(len(contents)), lengths + 1)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = ids + 1
    index = FMIndex(symbols, int(lengths.max()) + 1)
    doc_by_place = docs[owner[index.order]]
    starts = np.flatnonzero(np.arange(len(symbols)) + WINDOW < ends[owner])
    least = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), STREAM):
        some = starts[i : i + STREAM]
        low, high = index.search(symbols[some[:, None] + np.arange(WINDOW)])
        found = doc_by_place[low]
        many = np.flatnonzero(high - low > 1)
        if len(many):
            # intervals of equally long words are equal or apart
            at, which = np.unique(low[many], return_inverse=True)
            cuts = np.empty(2 * len(at), np.int64)
            cuts[0::2] = at
            cuts[1::2][which] = high[many]
            found[many] = np.minimum.reduceat(np.append(doc_by_place, _LAST), cuts)[0::2][which]
        least[i : i + STREAM] = found
    stops = np.cumsum(np.bincount(owner[starts], minlength=len(contents))).tolist()
    return [least[a:b] for a, b in zip([0, *stops], stops)]


def _spans(start: int, flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Covered words of a segment whose windows are marked, as spans of the document's words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return (edge[0::2] + start).tolist(), (edge[1::2] - 1 + WINDOW + start).tolist()


def _shard(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    asked: dict[bytes, list[tuple[int, int, int]]] = {}
    spans: dict[tuple[int, int], tuple[list[int], list[int]]] = {}

    def cover(doc: int, name: int, found: tuple[list[int], list[int]]) -> None:
        held = spans.setdefault((doc, name), ([], []))
        held[0].extend(found[0])
        held[1].extend(found[1])

    for block in table.column("block"):
        for content, ask, certain in pickle.loads(unpack(block.as_py())):
            asked.setdefault(content, []).extend(ask)
            for doc, name, start in certain:
                cover(doc, name, ([start], [start + content.count(b" ") + 1]))
    contents = list(asked)
    least = np.array([min(x)[0] for x in asked.values()], np.int64)
    for (content, where), first, earliest in zip(asked.items(), least.tolist(), _earliest(contents, least), strict=True):
        own = _spans(0, earliest < first)
        for doc, name, start in where:
            if doc > first:
                cover(doc, name, ([start], [start + content.count(b" ") + 1]))
            elif own[0]:
                cover(doc, name, ([x + start for x in own[0]], [x + start for x in own[1]]))
    return pa.table({
        "doc_id": pa.array([d for d, _ in spans], pa.int64()), "name": pa.array([n for _, n in spans], pa.int64()),
        "starts": pa.array([x[0] for x in spans.values()], pa.list_(pa.int32())),
        "ends": pa.array([x[1] for x in spans.values()], pa.list_(pa.int32())),
    })


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, z, starts, ends, names) → the result, each row by the spans of its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                counts, gone, kept, spans = [], [], [], []
                for z, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = unpack(z)
                    words = text.split()
                    own = [x for x in found if x["name"] == _name(text)] if found else []
                    counts.append(len(words))
                    if not own:
                        gone.append(0)
                        spans.append([])
                        kept.append(b" ".join(words).decode())
                        continue
                    begins, ends = ([p for x in own for p in x[end]] for end in ("starts", "ends"))
                    marks = np.bincount(begins, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
                    covered = np.cumsum(marks)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    gone.append(int(covered.sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)])
                    left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_text string")


def _pack(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([press(x) for x in _bytes(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "z"])

    return docs.mapInArrow(run, "doc_id long, z binary")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` (removed words, start and end) and ``kept_text`` per row.

    A word is ``[^\\x20\\x09-\\x0D]+``. It is removed if a window of 13 words of its document covers it that also
    starts in a document with a smaller id, anywhere in the corpus as given. Kept words are joined by one space.

    Null and empty texts have no words. A null id counts as greater than every other; rows with equal ids remove
    nothing from each other, and each row is cut by its own text. An empty table gives an empty result; further
    columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    anchors = document_anchors(texts)
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    lists = anchors.join(repeated, "anchor").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("cold"),
        F.collect_list(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    lists = materialize(lists, "anchors")
    size = lists.agg(F.sum(F.size("cold") + F.size("hot"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 2 * ANCHOR * 2 // SHARD_WORDS))

    # one exchange of packed texts serves both joins
    id_key = F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("key")
    packed = _pack(texts).select(id_key, "doc_id", "z")
    keyed = lists.select(id_key, "cold", "hot")
    blocks = _segments(packed.join(keyed, "key").select("doc_id", "z", "cold", "hot"), shards)
    spans = blocks.groupBy("shard").applyInArrow(_shard, _SCHEMA)
    by_doc = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("name", "starts", "ends")).alias("found"))
    return _cut(packed.join(by_doc, "key", "left").select("doc_id", "z", "found"))
