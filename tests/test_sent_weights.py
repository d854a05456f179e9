"""Weights that are sent to the postings: the rows of the grid, and neither side is repeated on disk."""

import random

import pyarrow as pa
import pytest

from gleanery.operators import scoring


@pytest.mark.parametrize("options", [{}, {"best": 2}, {"counts": True}])
def test_sent_weights_give_the_rows_of_the_grid(spark, monkeypatch, options):
    monkeypatch.setattr(scoring, "CELL_POSTINGS", 16)
    monkeypatch.setattr(scoring, "CELL_WEIGHTS", 5)
    rng = random.Random(1)
    postings = spark.createDataFrame(
        [(d, t, rng.randrange(1, 9) / 4) for d in range(90) for t in rng.sample(range(20), 6)], "doc_id BIGINT, term_id BIGINT, part DOUBLE")
    weights = spark.createDataFrame([(f"q{q}", t, 0.5 + t) for q in range(12) for t in rng.sample(range(25), 3)], "query_id STRING, term_id BIGINT, weight DOUBLE")

    def rows(df):
        if "best" in options:
            found = sorted((r.query_id, -r.score, r.doc_id) for r in df.collect())
            return [r for i, r in enumerate(found) if sum(o[0] == r[0] for o in found[:i]) < 2]
        if "counts" in options:
            totals = {}
            for r in df.collect():
                totals[r.query_id] = totals.get(r.query_id, 0) + r.total
            return totals
        return sorted(map(tuple, df.collect()))

    sent = scoring.summed(postings, weights, 9, **options)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    monkeypatch.setattr(scoring, "SENT_WEIGHTS", 0)
    grid = scoring.summed(postings, weights, 9, **options)
    assert "Generate" in grid._jdf.queryExecution().executedPlan().toString()
    assert rows(sent) == rows(grid)


def test_tiles_hold_whole_queries():
    query = [5] * 30 + [1, 2, 3, 2, 1, 4]
    tiles = scoring._tiles(pa.table({"query_id": query, "weight": range(len(query))}), 6)
    kept = [set(t.column("query_id").to_pylist()) for t in tiles]
    assert sum(map(len, kept)) == 5 == len(set().union(*kept)) and sum(t.num_rows for t in tiles) == len(query)
    assert len(scoring._tiles(pa.table({"query_id": pa.array([], pa.int64())}), 1)) == 1
