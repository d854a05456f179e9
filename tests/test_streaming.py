"""A stream over the same rows gives the batch result."""

import shutil

import numpy as np
from pyspark.sql import functions as F

from gleanery.operators import bm25, index
from gleanery.plans import index_log
from gleanery.sources.page_log import newest_pages, read_log
from gleanery.streaming import progress, streams

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"


def test_ingest_later_batches_win(spark, tmp_path):
    """The newest row of a URL counts; a batch writes its own rows and leaves the folders of the others alone."""
    schema = "seq INT, url STRING, title STRING"
    batches = [[(1, "a", "one"), (2, "a", "two"), (3, "b", "b1")], [(4, "a", "newer"), (5, "c", "c1"), (5, "c", "c1")], [(6, "b", None)]]
    sizes = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        source = streams.read_stream(spark, str(tmp_path / "in" / "*"), schema)
        streams.stream_ingest(source, str(tmp_path / "log"), str(tmp_path / "cp"), available_now=True).awaitTermination()
        sizes.append(sorted(f.name for f in (tmp_path / "log" / "batch=0").glob("part-*")))
    assert sizes[0] == sizes[1] == sizes[2]
    log = read_log(spark, str(tmp_path / "log"), "url STRING, title STRING")
    assert {r.batch: r.n for r in log.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 2, 2: 1}
    assert {r.url: r.title for r in newest_pages(log).collect()} == {"a": "newer", "b": None, "c": "c1"}


def test_index_stream_equals_batch(spark, tmp_path):
    rows = [(1, "u1", "tea", None, "green tea leaves"), (2, "u2", "milk", "x", "cold milk"), (3, "u3", None, None, "tea with milk")]
    stale = [(7, "u3", "old tea tea tea", None, "gone"), (2, "u9", "another milk", None, "")]
    for i, part in enumerate((stale, rows[:2], rows[2:])):
        spark.createDataFrame(part, DOCS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = streams.read_stream(spark, str(tmp_path / "in" / "*"), DOCS, files_per_trigger=1)
    streams.stream_index(source, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert_same_index(spark, index_log.open_log(spark, str(tmp_path / "ix")), rows)
    index_log.compact(spark, str(tmp_path / "ix"), str(tmp_path / "one"))
    assert_same_index(spark, index_log.open_log(spark, str(tmp_path / "one")), rows)


def assert_same_index(spark, got, rows):
    want = index.build_index(spark.createDataFrame(rows, DOCS))
    for name, columns in (("docs", ["doc_id", "url", "content"]), ("postings", ["field", "term", "doc_id", "tf", "doc_len"]),
                          ("positions", ["field", "term", "doc_id", "pos"]), ("doc_lengths", ["field", "doc_id", "len"]),
                          ("field_stats", ["field", "n_docs", "avg_len"]), ("term_stats", ["field", "term", "df"])):
        a, b = (sorted(map(tuple, getattr(i, name).select(*columns).collect())) for i in (got, want))
        assert a == b, name
    queries = spark.createDataFrame([(1, "tea milk"), (2, "nothing")], "query_id INT, q STRING")
    assert sorted(map(tuple, bm25.bm25_scores(got, queries).collect())) == sorted(map(tuple, bm25.bm25_scores(want, queries).collect()))


def test_a_batch_that_did_not_commit_is_invisible_and_runs_again(spark, tmp_path):
    root = str(tmp_path / "ix")
    first = [(1, "u1", "tea", None, "green tea")]
    index_log.append_batch(spark.createDataFrame(first, DOCS), root, 0)
    index_log.append_batch(spark.createDataFrame([(2, "u2", "milk", None, "milk")], DOCS), root, 1)
    shutil.rmtree(tmp_path / "ix" / "commits" / "batch=1")
    assert_same_index(spark, index_log.open_log(spark, root), first)
    again = [(1, "u5", "tea", "new", "black tea"), (1, "u5", "tea", "new", "black tea"), (0, "u5", "x", None, "x")]
    for _ in range(2):
        index_log.append_batch(spark.createDataFrame(again, DOCS), root, 1)
    assert_same_index(spark, index_log.open_log(spark, root), again[:1])
    index_log.append_batch(spark.createDataFrame([], DOCS), root, 2)
    assert_same_index(spark, index_log.open_log(spark, root), again[:1])


def test_what_a_batch_writes_depends_on_the_batch(spark, tmp_path):
    root = str(tmp_path / "ix")
    many = [(i, f"u{i}", f"title {i}", None, f"word{i} and word{i + 1} in text {i} " * 5) for i in range(400)]
    index_log.append_batch(spark.createDataFrame(many, DOCS), root, 0)
    index_log.append_batch(spark.createDataFrame([(3, "u3", "new", None, "short")], DOCS), root, 1)

    def rows(batch):
        return sum(spark.read.parquet(f"{root}/{t}/batch={batch}").count() for t in ("docs", "postings", "positions", "doc_lengths", "term_deltas"))

    assert rows(1) < 40 < rows(0) / 50


def test_ttl_lets_a_key_pass_again(spark, tmp_path):
    schema = "k STRING, ts TIMESTAMP"
    times = [("a", 1000), ("a", 1100), ("b", 1100), ("a", 1299), ("a", 1300), ("a", 1350), ("a", 5000)]
    for i, (k, s) in enumerate(times):
        spark.range(1).select(F.lit(k).alias("k"), F.timestamp_seconds(F.lit(s)).alias("ts")).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{i}"))
        source = streams.read_stream(spark, str(tmp_path / "in" / "*"), schema)
        out = streams.run_to_table(streams.dedupe_within_ttl(source, ["k"], "ts", streams.CACHE_TTL["search"]), str(tmp_path / "out"))
    got = sorted((r.k, r.s) for r in out.select("k", F.unix_timestamp("ts").alias("s")).collect())
    assert got == [("a", 1000), ("a", 1300), ("a", 5000), ("b", 1100)]


def test_ttl_keys_share_few_groups(spark, tmp_path, monkeypatch):
    """Keys in one group keep to themselves, nulls and quotes among them, over batches that let states go."""
    monkeypatch.setattr(streams, "TTL_BUCKETS", 2)
    keys = [(None, 1), ("", 1), ('a"b\\', None), ("a", 2**60 + 1), ("a", 2**60)]
    rng = np.random.default_rng(2)
    at, want, end = [np.sort(rng.integers(4000 * b, 4000 * b + 2000, 40)).tolist() for b in range(3)], [], {}
    for batch in at:
        rows = [(*keys[rng.integers(5)], t) for t in batch]
        for *key, t in rows:
            if t >= end.get(tuple(key), t):
                want.append((*key, t))
                end[tuple(key)] = t + 300
        spark.createDataFrame(rows, "k string, n long, s long").select("k", "n", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        source = streams.read_stream(spark, str(tmp_path / "in"), "k STRING, n BIGINT, ts TIMESTAMP")
        out = streams.run_to_table(streams.dedupe_within_ttl(source, ["k", "n"], "ts", 300), str(tmp_path / "out"))
    got = [(r.k, r.n, r.s) for r in out.select("k", "n", F.unix_timestamp("ts").alias("s")).collect()]
    assert len(got) > 30 and sorted(got, key=str) == sorted(want, key=str)


def test_politeness_state_spans_batches(spark, tmp_path):
    schema = "event_id BIGINT, host STRING, ts TIMESTAMP"
    for i, s in enumerate([0.0, 0.25, 5.0]):
        spark.range(1).select(F.lit(i).cast("long").alias("event_id"), F.lit("h").alias("host"),
                              F.timestamp_millis(F.lit(int(s * 1000))).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        source = streams.read_stream(spark, str(tmp_path / "in" / "*"), schema)
        out = streams.run_to_table(streams.stream_politeness(source, 1.0), str(tmp_path / "out"))
    assert sorted((r.event_id, r.wait_seconds) for r in out.collect()) == [(0, 0.0), (1, 0.75), (2, 0.0)]


def test_progress_counts_every_batch_once(spark, tmp_path):
    """Late rows, an empty batch and a batch that runs again; totals stand after each batch."""
    schema, root = "ts TIMESTAMP, ok BOOLEAN", str(tmp_path / "log")
    batches = [[(10, True), (12, False)], [(8, True), (11, True)], [], [(18, True), (18, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "s INT, ok BOOLEAN").select(F.timestamp_seconds("s").alias("ts"), "ok").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{i}"))
        source = streams.read_stream(spark, str(tmp_path / "in" / "*"), schema)
        progress.stream_progress(source, root, str(tmp_path / "cp"), available_now=True).awaitTermination()
    progress.count_batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / "p1")), root, 1)
    got = [tuple(r)[1:] for r in progress.progress(spark, root, max_pages=8).orderBy("batch").collect()]
    # an arrival without rows repeats the totals, or makes no batch
    assert list(dict.fromkeys(got)) == [(1, 1, 2.0, 0.5, 0.125), (3, 1, 4.0, 0.75, 0.375), (4, 1, 10.0, 0.4, 0.5)]


def test_an_arrival_is_one_batch_of_many_files(spark, tmp_path, monkeypatch):
    from gleanery.catalog import streaming_queries

    monkeypatch.setattr(streaming_queries, "scratch_path", lambda _, name: str(tmp_path / name))
    seen = {}

    def start(stream):
        return streams._start(stream, lambda rows, i: seen.__setitem__(i, rows.count()), str(tmp_path / "c"), True)

    streaming_queries._arrivals(spark, spark.range(0, 400, 1, 4), "id % 2", 2, start)
    assert seen == {0: 200, 1: 200}
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) == 8
