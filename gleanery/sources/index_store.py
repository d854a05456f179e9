"""Index tables on disk.

Postings, positions and term statistics are laid out by term: a hash bucket of the term is the partition
column and rows are sorted by term inside a file, so that row-group statistics prune by term. Documents are laid out
by a bucket of their id in the same way. The number of buckets follows the size of the text and is stored; searches put
the bucket on their side of each join, and dynamic partition pruning skips the other buckets. A task writes its
rows of every bucket, so one very frequent term is split over several files; only rows of very many tasks are dealt out by bucket.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.index import FIELDS, Index, field_tokens, hash_bucket, term_blocks, term_stats
from gleanery.session import materialize, spread

_SCHEMAS = {
    "docs": "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING, doc_bucket INT",
    "postings": "field STRING, term STRING, doc_id BIGINT, tf INT, doc_len INT, term_bucket INT",
    "positions": "field STRING, term STRING, doc_id BIGINT, pos INT, term_bucket INT",
    "doc_lengths": "field STRING, doc_id BIGINT, len INT",
    "field_stats": "field STRING, n_docs BIGINT, avg_len DOUBLE",
    "term_stats": "field STRING, term STRING, df BIGINT, term_bucket INT",
}
#: Tasks that may each write a file of every bucket; beyond them rows are dealt out by bucket first.
MOST_WRITERS = 256
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_LAYOUT = "term_buckets INT, doc_buckets INT"
#: Words in a bucket of terms, documents in a bucket of documents, and the least number of buckets.
TOKENS_PER_BUCKET, DOCS_PER_BUCKET, LEAST_BUCKETS = 1 << 25, 1 << 17, 8


def _power_of_two(n: float) -> int:
    return max(LEAST_BUCKETS, 1 << max(0, int(n) - 1).bit_length())


def buckets_for(field_stats: DataFrame) -> tuple[int, int]:
    """Numbers of term and document buckets that keep a bucket at a few hundred MB; from one row per field."""
    size = field_stats.agg(F.sum(F.col("n_docs") * F.col("avg_len")), F.max("n_docs")).first()
    return _power_of_two((size[0] or 0) / TOKENS_PER_BUCKET), _power_of_two((size[1] or 0) / DOCS_PER_BUCKET)


def write_by_term(df: DataFrame, path: str, buckets: int, mode: str = "overwrite") -> None:
    keys = ["term_bucket", "term", *[c for c in ("doc_block", "doc_id", "pos") if c in df.columns]]
    (
        df.withColumn("term_bucket", hash_bucket(F.col("term"), buckets))
        .hint("rebalance", "term_bucket").sortWithinPartitions(*keys)
        .write.mode(mode).option("compression", "zstd").partitionBy("term_bucket").parquet(path)
    )


def _dealt(rows: DataFrame, source: DataFrame, bucket: str) -> DataFrame:
    """``rows`` where they are, if they come from few tasks that may each write a file of every bucket; else dealt out by bucket."""
    return rows if source.rdd.getNumPartitions() <= MOST_WRITERS else rows.hint("rebalance", bucket)


def write_by_doc(docs: DataFrame, path: str, buckets: int) -> None:
    (
        _dealt(docs.withColumn("doc_bucket", hash_bucket(F.col("doc_id"), buckets)), docs, "doc_bucket")
        .sortWithinPartitions("doc_bucket", "doc_id")
        .write.mode("overwrite").option("compression", "zstd").partitionBy("doc_bucket").parquet(path)
    )


def lengths_of(fields: DataFrame) -> DataFrame:
    """field, doc_id, len of every row of ``field_tokens`` with text."""
    return fields.where(F.col("tokens").isNotNull()).select("field", "doc_id", F.size("tokens").alias("len"))


def stats_of(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """The rows of ``field_stats`` from stored lengths; a missing field counts as length 0."""
    totals = lengths.groupBy("field").agg(F.sum("len").alias("__total"))
    counts = docs.agg(F.count("*").alias("n_docs")).where("n_docs > 0").select(F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), "n_docs")
    return counts.join(totals, "field", "left").select(
        "field", "n_docs", (F.coalesce("__total", F.lit(0)) / F.col("n_docs")).alias("avg_len"))


def write_terms(fields: DataFrame, postings: str, positions: str | None, buckets: int) -> DataFrame:
    """Write postings and positions of texts (``field_tokens``), the latter if a path is given → field, term, df of these texts.

    Texts become blocks of entries under their term, in the order of the files; they are written once and both tables are unfolded
    from them where they are read. Nothing is shuffled unless there are very many tasks.
    """
    spark = fields.sparkSession
    blocks = term_blocks(fields, positions is not None).withColumn("term_bucket", hash_bucket(F.col("term"), buckets))
    blocks = materialize(_dealt(blocks, fields, "term_bucket").sortWithinPartitions("term_bucket", "term"), "blocks")
    entries = blocks.select("term_bucket", "field", "term", F.inline("entries"))

    def write(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("term_bucket").parquet(path)

    writers = spark.conf.get(_WRITERS, "0")
    # a file per bucket is held open, so that rows are written in the order of the blocks and not sorted by bucket again
    spark.conf.set(_WRITERS, str(buckets))
    try:
        write(entries.select("field", "term", "doc_id", "tf", "doc_len", "term_bucket"), postings)
        if positions is not None:
            write(entries.select("field", "term", "doc_id", F.explode("positions").alias("pos"), "term_bucket"), positions)
    finally:
        spark.conf.set(_WRITERS, writers)
    return blocks.groupBy("field", "term").agg(F.sum(F.size("entries").cast("long")).alias("df"))


def write_index(index: Index, path: str, with_positions: bool = True, buckets: int | None = None) -> Index:
    """Write every table once; statistics are computed from what was written, not from the text.

    ``buckets`` (of terms) is chosen by the size of the text unless given.
    """
    spark = index.docs.sparkSession
    stats = index.field_stats
    if index.fields is not None:
        fields = index.tokens if index.tokens is not None else field_tokens(spread(index.docs))
        lengths_of(fields).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/doc_lengths")
        stats = stats_of(index.docs, spark.read.schema(_SCHEMAS["doc_lengths"]).parquet(f"{path}/doc_lengths"))
    else:
        index.doc_lengths.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/doc_lengths")
    stats.write.mode("overwrite").parquet(f"{path}/field_stats")
    by_size, doc_buckets = buckets_for(spark.read.schema(_SCHEMAS["field_stats"]).parquet(f"{path}/field_stats"))
    buckets = buckets or by_size
    write_by_doc(index.docs.select("doc_id", "url", "title", "description", "content"), f"{path}/docs", doc_buckets)
    if index.fields is not None:
        frequencies = write_terms(fields, f"{path}/postings", f"{path}/positions" if with_positions else None, buckets)
    else:
        write_by_term(index.postings.select("field", "term", "doc_id", "tf", "doc_len"), f"{path}/postings", buckets)
        if with_positions:
            write_by_term(index.positions.select("field", "term", "doc_id", "pos"), f"{path}/positions", buckets)
        frequencies = term_stats(spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings"))
    write_by_term(frequencies, f"{path}/term_stats", buckets)
    spark.createDataFrame([(buckets, doc_buckets)], _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """Reopen a stored index. Files are read when a query needs them; only its one-row layout is read at once."""
    frames = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS.items()
              if name != "positions"}
    try:
        frames["positions"] = spark.read.schema(_SCHEMAS["positions"]).parquet(f"{path}/positions")
    except AnalysisException:  # an index written without positions answers everything but phrases
        frames["positions"] = spark.createDataFrame([], _SCHEMAS["positions"])
    layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    return Index(**frames, term_buckets=layout[0], doc_buckets=layout[1])
