"""Language by compression: the language whose dictionary lets a text be written in the fewest bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import words as wd

#: A language's dictionary is made of at most so many labelled texts and so many characters of each: the bounded
#: sample that the classifier is fitted on. Rows are drawn by hash, so every part of the table can be in it.
SAMPLE_TEXTS = 128
SAMPLE_CHARS = 1_500
#: Texts are encoded block by block, so that a long text does not become its own dictionary.
BLOCK_BYTES = 1_024
LEVEL = 9
#: A prediction is rejected if the second-best encoding is less than this share longer than the best.
MARGIN = 0.01
UNKNOWN = "und"

#: Characters of Unicode category L.
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> bytes:
    """Lower-cased runs of letters with a blank around each; empty if there are none."""
    found = _LETTERS.findall(text.lower())
    return f" {' '.join(found)} ".encode() if found else b""


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit_languages(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) from the rows of ``labelled`` (``text``, ``lang``), the most frequent language first.

    Per language the texts with the smallest hash in each of SAMPLE_TEXTS slots are read: a narrow aggregate
    chooses them, then only they are collected. Rows with null text or language are left out.
    """
    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("slot", F.pmod(F.shiftright("h", 8), F.lit(SAMPLE_TEXTS)))
    chosen = rows.groupBy("lang", "slot").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    frequency = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # at most SAMPLE_TEXTS rows a language, so the texts stay where they are
    sample = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(
        F.first(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in sample.collect():
        texts.setdefault(lang, []).append((h, text))
    order = sorted(texts, key=lambda x: (-frequency[x], x))
    return [(x, b"".join(letters(t) for _, t in sorted(texts[x]))) for x in order]


class Classifier:
    """Encoders with one raw-content dictionary each."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.encoders = []
        for lang, content in model:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            encoder = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.encoders.append((lang, encoder.compress))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. The score is 0 when two languages do equally well and
        goes to 1 as the best needs ever fewer bytes than the second."""
        data = letters(text) if text else b""
        if not data or not self.encoders:
            return UNKNOWN, 0.0, True
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(x) for x in map(encode, blocks)) for _, encode in self.encoders]
        if len(sizes) == 1:
            return self.encoders[0][0], 1.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        gap = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
        return self.encoders[best][0], 1.0 - 2.0 ** -min(gap, 60), gap < MARGIN * (sizes[best] + gap) or gap == 0


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``; one row in, one row out, no shuffle.

    Only ``text`` is looked at. Null text and text without a letter give ``und``, score 0, rejected. Texts on
    which the best two languages are close keep their prediction and are rejected. An empty model rejects all.
    Columns of ``docs`` with a result's name give way; repeated rows are judged alike.
    """
    own = docs.drop("lang_pred", "score", "rejected")
    names = own.columns
    # a text goes to the worker once, as the column that is handed on; only another type needs a copy to be read
    sent, at = own, names.index("text")
    if own.schema["text"].dataType.simpleString() != "string":
        sent, at = own.withColumn("__text", F.col("text").cast("string")), len(names)
    # dictionaries are bounded by the constants above times the number of languages
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value)
        for batch in batches:
            text = batch.column(at)
            for start, stop in wd.chunks(pc.fill_null(text, "")):
                found = [judge.predict(t) for t in text.slice(start, stop - start).to_pylist()]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                     pa.array([x[2] for x in found], pa.bool_())],
                    names=[*names, "lang_pred", "score", "rejected"],
                )

    kept = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in names)
    return sent.mapInArrow(run, kept + "lang_pred string, score double, rejected boolean")
