"""Token counts on the map side: a broadcast table of frequent pre-tokens, then worker caches; no shuffle."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as wd
from gleanery.llm.pieces import BYTE_LEVEL, Pieces, held_pieces

#: The shared table is filled from at most so many texts of at most so many characters, and holds at most
#: so many pre-tokens. It only decides which tier answers: counts are the tokenizer's in any case.
TABLE_TEXTS = 2_000
TABLE_TEXT_CHARS = 20_000
TABLE_ENTRIES = 16_384


def frequent_lengths(texts: DataFrame, path: str, pattern: str = BYTE_LEVEL) -> dict[str, int]:
    """Token counts of frequent pre-tokens, from a bounded sample of the rows of ``texts`` (column ``text``)."""
    sample = texts.filter(F.length("text") <= TABLE_TEXT_CHARS).select("text").take(TABLE_TEXTS)
    pieces = Pieces(path, pattern, len)
    seen: Counter = Counter()
    for (text,) in sample:
        if pieces.plain(text):
            seen.update(pieces.split(text))
    chosen = [p for p, _ in seen.most_common(TABLE_ENTRIES)]
    return {p: n for p, n in pieces.look_up(chosen).items() if p in seen}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, pattern: str = BYTE_LEVEL) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text.

    ``path`` is a vocabulary file of the tokenizers library whose split is ``pattern``; strings of added tokens
    inside a text count as the library's default has it. Null text counts as empty: no bytes, no tokens.
    Repeated rows and null ids are counted row by row; further columns are ignored; an empty table gives none.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts.filter(F.col("text").isNotNull()), path, pattern))
    name = uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held_pieces((path, pattern, name), lambda: Pieces(path, pattern, len, frequent=shared.value))
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for start, stop in wd.chunks(text):
                part = text.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pc.binary_length(part).cast(pa.int64()),
                        pa.array(pieces.each(part.to_pylist(), sum), pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    counted = texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
