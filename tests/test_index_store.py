"""What writing an index from text puts on disk: the rows of the index, without a shuffle of texts, postings or positions."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import index
from gleanery.sources import index_store

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"


def corpus(n=120, seed=8):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices([f"w{i}" for i in range(30)] + ["The"] * 20, k=k))
    return [*[(i, f"u{i}", text(2), rng.choice([None, text(3)]), text(rng.randrange(1, 60))) for i in range(n)],
            (900, "x", None, None, None), (901, "y", "", None, " .,;"), (902, "z", "t", "d", "one " * 500)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("stage", [False, True])
def test_written_tables_hold_the_index(spark, tmp_path, monkeypatch, stage):
    plans = []
    monkeypatch.setattr(index_store, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    kept = index.materialize
    built = index.build_index(spark.createDataFrame(corpus(), DOCS), stage=stage)
    stored = index_store.write_index(built, str(tmp_path / "ix"), buckets=4)
    for name, columns in (("postings", ("field", "term", "doc_id", "tf", "doc_len")), ("positions", ("field", "term", "doc_id", "pos")),
                          ("doc_lengths", ("field", "doc_id", "len")), ("term_stats", ("field", "term", "df")),
                          ("field_stats", ("field", "n_docs", "avg_len")), ("docs", ("doc_id", "url", "content"))):
        assert rows(getattr(stored, name).na.fill(""), *columns) == rows(getattr(built, name).na.fill(""), *columns), name
    # blocks are written where texts are read (staged tokens are dealt out by document once)
    assert len(plans) == 1 and "rebalance" not in plans[0].lower() and ("Exchange" not in plans[0] or not stage)
    files = stored.postings.select("term", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r.file, []).append(r.term)
    assert all(sum(a > b for a, b in zip(terms, terms[1:])) < 8 for terms in by_file.values())
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_blocks_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(40), DOCS).coalesce(1)
    blocks = index.term_blocks(index.field_tokens(docs)).select("field", "term", F.inline("entries")).select("field", "term", "doc_id", "tf", "doc_len", "positions")
    want = index.build_index(docs).postings
    assert rows(blocks, "field", "term", "doc_id", "tf", "doc_len") == rows(want, "field", "term", "doc_id", "tf", "doc_len")
    assert blocks.where("size(positions) <> tf").count() == 0
    assert rows(index.term_blocks(index.field_tokens(docs), False).select("term", F.inline("entries")), "term", "doc_id", "tf") == rows(want, "term", "doc_id", "tf")
