"""A batch of new pages is written once before it is indexed, and its words are not looked for again."""

from gleanery.operators import bm25, index
from gleanery.plans import index_log
from gleanery.sources import index_store

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"


def test_a_batch_is_staged_once(spark, tmp_path, monkeypatch):
    staged = []

    def noted(df, name):
        staged.append(name)
        return kept(df, name)

    kept = index.materialize
    for module in (index, index_log, index_store):
        monkeypatch.setattr(module, "materialize", noted)
    first = [(i, f"u{i}", f"title {i}", None if i % 2 else "", f"word{i} and word{i + 1} in text") for i in range(30)]
    # one comes again with its id, one with its url, one is new, one has lost its text
    second = [(3, "u3", "new", None, "short"), (70, "u7", "seven", "again", "short text"), (80, "u80", "new", None, "text"), (5, "u5", "t", None, None)]
    root = str(tmp_path / "ix")
    index_log.append_batch(spark.createDataFrame(first, DOCS), root, 0)
    assert sorted(staged) == ["arrived", "blocks", "newest"]
    staged.clear()
    index_log.append_batch(spark.read.schema(DOCS).json(spark.createDataFrame(second, DOCS).toJSON()), root, 1, stored=True)
    assert sorted(staged) == ["blocks", "going", "newest", "replaced"]
    live = [d for d in first if d[0] not in (3, 5, 7)] + second
    got, want = index_log.open_log(spark, root), index.build_index(spark.createDataFrame(live, DOCS))
    for name, columns in (("postings", ["field", "term", "doc_id", "tf", "doc_len"]), ("positions", ["field", "term", "doc_id", "pos"]),
                          ("field_stats", ["field", "n_docs", "avg_len"]), ("term_stats", ["field", "term", "df"])):
        a, b = (sorted(map(tuple, getattr(i, name).select(*columns).collect())) for i in (got, want))
        assert a == b, name
    asked = spark.createDataFrame([(1, "short text seven")], "query_id INT, q STRING")
    assert sorted(map(tuple, bm25.bm25_scores(got, asked).collect())) == sorted(map(tuple, bm25.bm25_scores(want, asked).collect()))
