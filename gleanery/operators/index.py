"""Inverted index as ordinary DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import tokenize
from gleanery.session import bound_batches, materialize

FIELDS = ("title", "description", "content")
#: Tokens that are counted at a time, one row at least.
COUNTED = 1 << 19
#: Tokens that are put under their terms at a time, with one batch more at most.
BLOCK_TOKENS = 1 << 20
#: Terms of a search that go to the tasks that count; more are joined with what was counted.
SENT_TERMS = 1 << 16


@dataclass(frozen=True)
class Index:
    """``postings`` carry the length of their field, so scoring never joins ``doc_lengths``."""

    docs: DataFrame          # doc_id, url, title, description, content
    postings: DataFrame      # field, term, doc_id, tf, doc_len
    positions: DataFrame     # field, term, doc_id, pos
    doc_lengths: DataFrame   # field, doc_id, len
    field_stats: DataFrame   # field, n_docs, avg_len
    term_stats: DataFrame    # field, term, df
    #: hash buckets of the terms and of the documents, if the tables are laid out by them
    term_buckets: int | None = None
    doc_buckets: int | None = None
    #: rows of ``term_stats`` still to be added up, where the index grows by batches
    term_deltas: DataFrame | None = None
    #: doc_id, field, tokens, where building has kept them
    tokens: DataFrame | None = None
    #: doc_id, field, tokens of an index that is built from text: where its postings are counted
    fields: DataFrame | None = None
    #: postings and statistics are those of some terms only
    of_some: bool = False

    def by_term(self, terms: DataFrame) -> tuple[DataFrame, list[str]]:
        """``terms`` and the keys to join them with a table of terms, so that a stored table is read by bucket."""
        if self.term_buckets is None:
            return terms, ["term"]
        return terms.withColumn("term_bucket", hash_bucket(F.col("term"), self.term_buckets)), ["term_bucket", "term"]

    def by_doc(self, docs: DataFrame) -> tuple[DataFrame, list[str]]:
        """The same for ``docs`` and the stored documents."""
        if self.doc_buckets is None:
            return docs, ["doc_id"]
        return docs.withColumn("doc_bucket", hash_bucket(F.col("doc_id"), self.doc_buckets)), ["doc_bucket", "doc_id"]

    def of_terms(self, terms: DataFrame) -> Index:
        """The same index with the postings of ``terms`` only, written out, and their statistics; a stored one is read by bucket as it is."""
        if self.term_buckets is not None or self.of_some:
            return self
        wanted = materialize(terms.where(F.col("term").isNotNull()).select("term").distinct(), "wanted")
        # one row more than is sent tells the two cases apart
        sent = [r["term"] for r in wanted.limit(SENT_TERMS + 1).collect()] if self.fields is not None else None
        if sent is not None and len(sent) <= SENT_TERMS:
            postings = count_terms(self.fields, sent)
        else:
            postings = self.postings.join(wanted, "term").select(self.postings.columns)
        postings = materialize(postings, "held")
        return replace(self, postings=postings, term_stats=term_stats(postings), of_some=True)


def hash_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def field_tokens(docs: DataFrame, *also: str) -> DataFrame:
    """One row per document and field, with the columns ``also``; ``tokens`` is null where the field is."""
    return docs.select(
        "doc_id", *also,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("field"), tokenize(F.col(name)).alias("tokens")) for name in FIELDS
        ])).alias("f"),
    ).select("doc_id", *also, "f.field", "f.tokens")


def count_terms(fields: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """field, term, doc_id, tf, doc_len of every row of ``field_tokens``, of ``terms`` only if given. Rows are counted by
    themselves, some at a time."""
    bound_batches(fields.sparkSession)
    rows = fields.where(F.col("tokens").isNotNull()).select("doc_id", "field", "tokens")
    schema = T.StructType([
        T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), rows.schema["doc_id"],
        T.StructField("tf", T.IntegerType()), T.StructField("doc_len", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if terms is None else pa.array(terms, pa.string())
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + COUNTED, "right")))
                part = batch.slice(start, stop - start)
                size = np.diff(ends[start:stop], prepend=base)
                row = np.repeat(np.arange(len(size)), size)
                words = part.column(2).flatten()
                if known is None:
                    words = words.dictionary_encode()
                    names, place = words.dictionary, words.indices.to_numpy()
                else:
                    names, found = known, pc.index_in(words, value_set=known)
                    place, row = found.drop_null().to_numpy(), row[found.is_valid().to_numpy(zero_copy_only=False)]
                kinds = max(1, len(names))
                key, tf = np.unique(row * kinds + place, return_counts=True)
                row, term = np.divmod(key, kinds)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(1).take(at), names.take(pa.array(term)), part.column(0).take(at),
                    pa.array(tf.astype(np.int32)), pa.array(size[row].astype(np.int32))], names=schema.names)
                start = stop

    return rows.mapInArrow(run, schema)


def term_blocks(fields: DataFrame, with_positions: bool = True) -> DataFrame:
    """field, term, entries (doc_id, tf, doc_len[, positions]): the postings of some texts (``field_tokens``) under their term.

    Texts are counted some at a time, so a list is no longer than what is counted together. There are far fewer rows than
    postings or positions, and a term is named once for all of them.
    """
    bound_batches(fields.sparkSession)
    rows = fields.where(F.col("tokens").isNotNull()).select("doc_id", "field", "tokens")
    entry = [rows.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("doc_len", T.IntegerType())]
    if with_positions:
        entry.append(T.StructField("positions", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()),
                           T.StructField("entries", T.ArrayType(T.StructType(entry)))])

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield _blocks_of(part, with_positions, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += len(batch.column(2).flatten())
            if tokens >= BLOCK_TOKENS:
                yield from counted(held)
                held, tokens = [], 0
        if held:
            yield from counted(held)

    return rows.mapInArrow(run, schema)


def _blocks_of(part: pa.RecordBatch, with_positions: bool, names: list[str]) -> pa.RecordBatch:
    size = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at_word = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    words, fields = part.column(2).flatten().dictionary_encode(), part.column(1).dictionary_encode()
    kinds = max(1, len(words.dictionary))
    key = fields.indices.to_numpy().astype(np.int64)[row] * kinds + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    # a posting begins where term or text change, a list where the term does
    begin = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    heads = np.flatnonzero(np.diff(key[begin], prepend=-1))
    ends = np.append(heads, len(begin)).astype(np.int32)
    field, term = np.divmod(key[begin[heads]], kinds)

    columns = [part.column(0).take(pa.array(row[begin])), pa.array(np.diff(np.append(begin, len(key))).astype(np.int32)), pa.array(size[row[begin]].astype(np.int32))]
    if with_positions:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)).astype(np.int32)), pa.array(at_word[order])))
    entries = pa.StructArray.from_arrays(columns, names=["doc_id", "tf", "doc_len", "positions"][: len(columns)])
    return pa.RecordBatch.from_arrays([
        fields.dictionary.take(pa.array(field)), words.dictionary.take(pa.array(term)), pa.ListArray.from_arrays(pa.array(ends), entries)], names=names)


def field_stats(fields: DataFrame) -> DataFrame:
    """Document count and mean field length; a missing field counts as length 0."""
    length = F.when(F.col("tokens").isNull(), F.lit(0)).otherwise(F.size("tokens"))
    return fields.groupBy("field").agg(
        F.count("*").alias("n_docs"), (F.sum(length) / F.count("*")).alias("avg_len"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Documents holding each (field, term); postings are unique per document."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def build_index(pages: DataFrame, stage: bool = False) -> Index:
    """Pages (doc_id, url, title, description, content) → index.

    Rows are dealt out by document once; terms are counted inside a row, so counting needs neither a shuffle nor a
    table of terms in memory. ``doc_id`` names one row. ``stage=True`` keeps token lists in the shared folder, for when
    they are asked for themselves or read often: writing and reading them costs several times the making. Postings are many
    more rows and are counted again; a search counts those of its own terms once and keeps them (``of_terms``).
    """
    docs = pages.select("doc_id", "url", *FIELDS)
    fields = field_tokens(docs.repartition("doc_id"))
    if stage:
        fields = materialize(fields, "tokens")
    present = fields.where(F.col("tokens").isNotNull())
    postings = count_terms(fields)
    positions = present.select("field", "doc_id", F.posexplode("tokens").alias("pos", "term")).select(
        "field", "term", "doc_id", "pos")
    lengths = present.select("field", "doc_id", F.size("tokens").alias("len"))
    return Index(docs, postings, positions, lengths, field_stats(fields if stage else field_tokens(docs)),
                 term_stats(postings), tokens=fields if stage else None, fields=fields)


def with_postings(docs: DataFrame, postings: DataFrame, positions: DataFrame, lengths: DataFrame) -> Index:
    """An index whose statistics are worked out again from its parts."""
    totals = lengths.groupBy("field").agg(F.sum("len").alias("__total"))
    counts = docs.select(F.explode(F.array(*[F.lit(name) for name in FIELDS])).alias("field")).groupBy("field").agg(
        F.count("*").alias("n_docs"))
    stats = counts.join(totals, "field", "left").select(
        "field", "n_docs", (F.coalesce("__total", F.lit(0)) / F.col("n_docs")).alias("avg_len"))
    return Index(docs, postings, positions, lengths, stats, term_stats(postings))
