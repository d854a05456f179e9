from collections import Counter

from gleanery.operators.index import build_index

WORDS = ["ant", "bee", "cat", "dog", "elk"]


def _pages(spark, n=60):
    rows = [(i, f"u{i}", WORDS[i % 5], None, " ".join(WORDS[(i * j) % (i % 4 + 2)] for j in range(i % 9 + 1))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING")


def test_terms_are_counted_without_a_table_of_them(spark):
    pages = _pages(spark)
    postings = build_index(pages).postings
    assert "HashAggregate" not in postings._jdf.queryExecution().executedPlan().toString()
    want = set()
    for r in pages.collect():
        for field in ("title", "content"):
            want |= {(field, t, r["doc_id"], n, len(r[field].split())) for t, n in Counter(r[field].split()).items()}
    assert {tuple(r) for r in postings.collect()} == want


def test_a_search_counts_the_asked_terms_only(spark, monkeypatch):
    from gleanery.operators import index

    built = build_index(_pages(spark))
    asked = spark.createDataFrame([("ant",), ("elk",), ("ant",), ("absent",), (None,)], "term STRING")
    want = {tuple(r) for r in built.postings.where("term IN ('ant', 'elk')").collect()}
    assert {tuple(r) for r in index.count_terms(built.fields, ["elk", "ant", "absent"]).collect()} == want
    assert {tuple(r) for r in built.of_terms(asked).postings.collect()} == want
    monkeypatch.setattr(index, "SENT_TERMS", 2)
    assert {tuple(r) for r in built.of_terms(asked).postings.collect()} == want


def test_embedding_is_counted_by_term_and_bounded_by_bytes(spark):
    from gleanery.operators.vector import embed, hashing_embedder
    from gleanery.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, "64m")
    spark.conf.set(key, "64m")
    try:
        texts = [None, "", "tea tea Milk", *(f"word{i} " * (i + 1) for i in range(100))]
        rows = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, text STRING")
        got = {r["id"]: r["embedding"] for r in embed(rows, "id", "text").collect()}
        assert spark.conf.get(key) == f"{BATCH_BYTES}b"
        assert got == {i: v for i, v in enumerate(hashing_embedder(texts).astype("float32").tolist())}
    finally:
        spark.conf.set(key, before)
