"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, per part, ``ids-N.bin`` (little-endian unsigned ids of 16 or 32 bits, documents one after
the other), ``offsets-N.bin`` (64-bit starts of the part's documents, one more entry for the end) and
``docs-N.bin`` (64-bit document ids), and one Parquet table ``manifest`` with a row per part: its counts and
its bases, the ids and documents of all parts before it (prefix sums). The parts in order make one ascending
run of documents; a document starts at its part's base plus its offset. The width of ids and null document
ids are told in the manifest. Files are written under a name of the attempt and listed only when it succeeds,
so a lost executor leaves at most an unlisted file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import words as wd
from gleanery.llm.pieces import WORD_LEVEL, Pieces, held_pieces
from gleanery.session import materialize

_MANIFEST = "part int, ids_file string, offsets_file string, docs_file string, width int, n_docs long, n_null long, n_tokens long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file; a path without scheme is a mounted one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _load(path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the folder is mounted, else read."""
    store, at = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(at, kind, "r") if os.path.getsize(at) else np.empty(0, kind)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), kind)


def encode(docs: DataFrame, path: str, end_id: int | None, pattern: str = WORD_LEVEL, lower: bool = True) -> DataFrame:
    """``doc_id`` and ``ids``: the bytes of the ids of every whole text (null: empty) and ``end_id``."""

    def made() -> Pieces:
        pieces = Pieces(path, pattern, None, lower=lower)
        sign = "H" if id_kind(pieces.tokenizer.get_vocab_size()) == "<u2" else "I"
        pieces.value = lambda ids: struct.pack(f"<{len(ids)}{sign}", *ids)
        return pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held_pieces((path, pattern, lower), made)
        tail = b"" if end_id is None else pieces.value([end_id])
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for start, stop in wd.chunks(text):
                found = pieces.each(text.slice(start, stop - start).to_pylist(), b"".join)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array([x + tail for x in found], pa.binary())],
                    names=["doc_id", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _range_ends(docs: DataFrame, parts: int) -> list[int]:
    """Up to ``parts`` - 1 document ids that cut the table into even ranges; only the ids are read."""
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10_000).alias("q")).first()["q"] if shares else []
    return sorted(set(found or []))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None, parts: int | None = None,
                      pattern: str = WORD_LEVEL, lower: bool = True) -> DataFrame:
    """Writes every text's ids to ``folder`` in ascending order of ``doc_id`` and returns the manifest.

    Null ids come first. Rows with the same id stay separate documents, ordered by their ids' bytes. Null and
    empty texts have only the end id (none without ``end_id``). An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    vocabulary = Pieces(path, pattern, None).tokenizer.get_vocab_size()
    width = np.dtype(id_kind(vocabulary)).itemsize
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = np.array(_range_ends(docs, parts), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column(0), np.iinfo(np.int64).min))
            part = np.searchsorted(ends, ids, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["doc_id", "ids", "part"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        tag = uuid.uuid4().hex
        files, names, lengths, ids_of, part, nulls = None, [], [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                part = batch.column(2)[0].as_py()
                names = [f"{at}/{kind}-{part:06d}-{tag}.bin" for kind in ("ids", "offsets", "docs")]
                store.create_dir(at, recursive=True)
                files = store.open_output_stream(names[0])
            nulls += batch.column(0).null_count
            ids_of.append(np.asarray(pc.fill_null(batch.column(0), 0)))
            lengths.append(np.asarray(pc.binary_length(batch.column(1))).astype(np.int64) // width)
            files.write(b"".join(batch.column(1).to_pylist()))
        if files is None:
            return
        files.close()
        counts = np.concatenate(lengths)
        for name, values in ((names[1], np.concatenate([[0], np.cumsum(counts)]).astype("<u8")), (names[2], np.concatenate(ids_of).astype("<i8"))):
            with store.open_output_stream(name) as f:
                f.write(values.tobytes())
        scheme = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        yield pa.RecordBatch.from_pylist([{
            "part": part, "ids_file": scheme + names[0], "offsets_file": scheme + names[1], "docs_file": scheme + names[2],
            "width": width, "n_docs": len(counts), "n_null": nulls, "n_tokens": int(counts.sum()),
        }], schema=pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("offsets_file", pa.string()), ("docs_file", pa.string()),
                              ("width", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())]))

    dealt = encode(docs, path, end_id, pattern, lower).mapInArrow(deal, "doc_id long, ids binary, part int")
    dealt = dealt.repartitionById(len(ends) + 1, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    written = materialize(dealt.mapInArrow(write, _MANIFEST), "token-parts")
    # one row per part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = written.withColumns({
        "token_base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)),
        "doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
    })
    bases.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files, in part order: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``place``.

    The checksum is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. Tasks map the
    files of whole parts and go through them document by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _load(row["ids_file"], f"<u{row['width']}")
                offsets, docs = _load(row["offsets_file"], "<u8").astype(np.int64), _load(row["docs_file"], "<i8")
                for low in range(0, row["n_docs"], 5_000):
                    high = min(low + 5_000, row["n_docs"])
                    sums = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(low, high)]
                    null = np.arange(low, high) < row["n_null"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[low:high], pa.int64(), mask=null),
                        pa.array(row["token_base"] + offsets[low:high]),
                        pa.array(np.diff(offsets[low : high + 1])),
                        pa.array(sums, pa.int64()),
                        pa.array(row["doc_base"] + np.arange(low, high)),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32", "place"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    dealt = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, place long")
