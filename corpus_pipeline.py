"""A corpus pipeline over ``documents``: language, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, works on all rows the one before kept, and
returns the columns of ``documents`` but for the last, which returns what its files hold per document. Empty tables
give empty results and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, jaccard, language, mixing, token_files
from gleanery.llm.queries import TOKENIZERS
from gleanery.session import bound_batches, materialize, scratch_path


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; null texts, texts without letters and narrow cases go.

    Equal rows are judged alike. Rows with a null id or language are judged too; they only teach nothing without a language.
    """
    bound_batches(spark)
    model = language.fit_languages(docs.filter(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    return language.identify(docs, model).filter("not rejected").select(docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of five-word shingle sets linked at 0.8 or more.

    Each row is a document of its own here, under a number that is written once: of repeated rows and of rows with a
    null id (they come after all others) one stays as well. Rows without words link with nothing and stay.
    """
    bound_batches(spark)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), k=5, percent=80)
    classes = found.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = classes.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = materialize(classes.join(first, "component_id").filter(F.col("first.__row") != F.col("__row")).select("__row"), "near-copies")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and wordless texts hold none. Equal rows are judged alike."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark).filter("not contaminated").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a copy is a row. Null and wordless texts have size 0 and the share of their
    source; a null source is a source of its own. Rows of one id and one size are taken alike, null ids too."""
    copies = mixing.mix_sources(docs).filter("copies > 0")
    return copies.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: per row its id, start, ids with the end id, and their checksum. A null text
    is the end id alone; rows with a null id come first, equal ids stand side by side."""
    bound_batches(spark)
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, folder, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)
    return token_files.read_token_files(spark, folder).drop("place")


STAGES = [
    ("language ID", by_language),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL has neither compressed sizes nor tokenizers; tests/llm holds a brute-force version of the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads the rows the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), stage.__name__)
    return STAGES[-1][1](spark, docs, sf_dir)
