from collections import Counter

from gleanery.operators import scoring
from gleanery.operators.bm25 import bm25_search, match_counts
from gleanery.operators.index import build_index
from gleanery.session import materialize

WORDS = ["ant", "bee", "cat", "dog", "elk"]


def _pages(spark, n=60):
    rows = [(i, f"u{i}", WORDS[i % 5], None, " ".join(WORDS[(i * j) % (i % 4 + 2)] for j in range(i % 9 + 1))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING")


def test_cells_agree_with_sums_over_matches(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_POSTINGS", 7)
    monkeypatch.setattr(scoring, "CELL_WEIGHTS", 5)
    monkeypatch.setattr(scoring, "SLICE", 11)
    postings = [(d, t, (d * t % 7 + 1) / 3) for d in range(30) for t in range(6) if (d + t) % 3]
    weights = [(q, t, (q + t % 3 + 1) / 2) for q in range(8) for t in range(8) if q & (t + 1)]
    want = {}
    for d, t, part in postings:
        for q, u, weight in weights:
            if t == u:
                want[q, d] = want.get((q, d), 0) + part * weight
    left = spark.createDataFrame(postings, "doc_id BIGINT, term_id BIGINT, part DOUBLE")
    right = spark.createDataFrame(weights, "query_id BIGINT, term_id BIGINT, weight DOUBLE")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.summed(left, right, 9).collect()}
    assert got == {k: round(v, 9) for k, v in want.items()}
    best = scoring.summed(left, right, 9, best=3).collect()
    for q in range(8):
        order = sorted((-round(v, 9), d) for (p, d), v in want.items() if p == q)[:3]
        assert set(order) <= {(-r["score"], r["doc_id"]) for r in best if r["query_id"] == q}
    counts = Counter()
    for r in scoring.summed(left, right, 9, counts=True).collect():
        counts[r["query_id"]] += r["total"]
    assert +counts == Counter(q for q, _ in want)


def test_equal_queries_are_asked_once(spark, monkeypatch):
    seen = []
    whole = scoring.summed

    def spy(postings, weights, *args, **named):
        weights = materialize(weights, "spied")
        seen.append(weights.select("query_id").distinct().count())
        return whole(postings, weights, *args, **named)

    monkeypatch.setattr("gleanery.operators.bm25.summed", spy)
    index = build_index(_pages(spark), stage=True)
    queries = spark.createDataFrame([(i, ("cat dog", "Dog, cat!", "bee bee", None)[i % 4]) for i in range(40)], "query_id BIGINT, q STRING")
    hits = bm25_search(index, queries, k=3).collect()
    totals = {r["query_id"]: r["total_hits"] for r in match_counts(index, queries).collect()}
    assert seen == [2, 2]
    lists = {q: sorted((r["rank"], r["doc_id"], r["score"]) for r in hits if r["query_id"] == q) for q in range(40)}
    assert all(lists[q] == lists[0 if q % 4 < 2 else 2] and len(lists[q]) == 3 for q in range(40) if q % 4 < 3)
    assert lists[3] == [] and totals[3] == 0 and totals[0] == totals[1] == totals[37] > 0
