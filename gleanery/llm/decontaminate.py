"""Benchmark decontamination: exact hits of item pieces, verified by bit-parallel edit distance over words.

An item of n words may differ from a stretch of a document by ``n // per_error`` word edits. Cut into one
piece more than that, one piece at least is left whole in any such stretch: so a document without a piece
is clean for certain, and one with a piece is verified around the hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as wd

#: One word edit is allowed per so many words of an item.
PER_ERROR = 5
#: Items are shipped in blocks of at most so many bytes of text; further blocks follow in further passes.
BLOCK_BYTES = 16 << 20

_BITS = 1 << 20


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in blocks of bounded size; one item at least."""
    block: list[tuple[int, str]] = []
    held = 0
    for item_id, text in benchmark.select("item_id", F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        size = len(text.encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += size
    if block:
        yield block


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode().lower(), np.uint8)
    return wd.hashes(data, *wd.bounds(data))


def infix_distance(item: list[int], text: Iterable[int]) -> int:
    """Fewest word edits between ``item`` and any stretch of ``text`` (Myers' bit vectors, one bit per word)."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    least = score
    for word in text:
        equal = masks.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            least = min(least, score)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return least


class Pieces:
    """The pieces of a block of items, by length in words."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        self.items = [(i, h) for i, h in ((i, word_hashes(t)) for i, t in items) if len(h)]
        self.budget = [len(h) // per_error for _, h in self.items]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, h) in enumerate(self.items):
            cuts = [len(h) * j // (self.budget[k] + 1) for j in range(self.budget[k] + 2)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                found.setdefault(high - low, []).append((int(wd.windows(h[low:high], high - low)[0]), k, low))
        self.by_length = {}
        for length, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            flags = np.zeros(_BITS, bool)
            flags[keys & np.uint64(_BITS - 1)] = True
            self.by_length[length] = (keys, flags, rows)

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[dict[int, int]]:
        """Per document (its words start at ``first``): item id → least distance, within the item's budget."""
        out: list[dict[int, int]] = [{} for _ in range(len(first) - 1)]
        tried: set[tuple[int, int, int, int]] = set()  # by the whole window: clipped at the document's start, other alignments end elsewhere
        for length, (keys, flags, rows) in self.by_length.items():
            win = wd.windows(words, length)
            at = np.flatnonzero(flags[win & np.uint64(_BITS - 1)])
            place = np.searchsorted(keys, win[at])
            hit = keys[np.minimum(place, len(keys) - 1)] == win[at]
            doc_of = np.searchsorted(first, at[hit], "right") - 1
            for position, row, doc in zip(at[hit].tolist(), place[hit].tolist(), doc_of.tolist(), strict=True):
                key = rows[row][0]
                while row < len(rows) and rows[row][0] == key:
                    _, k, low = rows[row]
                    row += 1
                    item_id, item = self.items[k]
                    room = self.budget[k]
                    begin = max(int(first[doc]), position - low - room)
                    end = min(int(first[doc + 1]), position - low + len(item) + room)
                    if (doc, k, begin, end) in tried or out[doc].get(item_id) == 0 or position + length > int(first[doc + 1]):
                        continue
                    tried.add((doc, k, begin, end))
                    distance = infix_distance(item.tolist(), words[begin:end].tolist())
                    if distance <= room:
                        out[doc][item_id] = min(distance, out[doc].get(item_id, distance))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR) -> DataFrame:
    """``docs`` with ``item_ids`` (sorted list of the benchmark items it holds), ``distance`` (word edits of the
    closest; null if none) and ``contaminated``. One row in, one row out, no shuffle.

    Words are lower-cased (A-Z). An item of fewer than ``per_error`` words is found only exactly. Items without
    words and null texts match nothing; null or empty documents are clean. Items with the same text are all
    listed. An empty benchmark leaves every document clean; columns with a result's name give way.
    """
    spark = docs.sparkSession
    rows = docs.drop("item_ids", "distance", "contaminated")
    names = rows.columns
    # a text goes to the worker once, as the column that is handed on; only another type needs a copy to be read
    copied = rows.schema["text"].dataType.simpleString() != "string"
    at = len(names) + 2 if copied else names.index("text")
    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    carried = "__ids array<bigint>, __least bigint"
    rows = rows.withColumns({"__ids": F.array().cast("array<bigint>"), "__least": F.lit(None).cast("bigint")})
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(shared.value, per_error)
            for batch in batches:
                for start, stop in wd.chunks(batch.column(at)):
                    part = batch.slice(start, stop - start)
                    data, starts = wd.joined(part.column(at), lower=True)
                    begin, end = wd.bounds(data)
                    found = pieces.matches(wd.hashes(data, begin, end), np.searchsorted(begin, starts))
                    ids, least = part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist()
                    ids = [sorted({*a, *b}) for a, b in zip(ids, found, strict=True)]
                    least = [min([*([] if a is None else [a]), *b.values()], default=None) for a, b in zip(least, found, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:len(names)], pa.array(ids, pa.list_(pa.int64())), pa.array(least, pa.int64())],
                        names=[*names, "__ids", "__least"])

        sent = rows.withColumn("__text", F.col("text").cast("string")) if copied else rows
        rows = sent.mapInArrow(run, kept + carried)
    return rows.withColumns({"item_ids": F.col("__ids"), "distance": F.col("__least"), "contaminated": F.size("__ids") > 0}).drop(
        "__ids", "__least")
