"""Phrases looked up in one pass over the texts, against brute force; pairs of large groups are not moved."""

import random

import numpy as np
import pytest

from gleanery.operators import bm25, index, phrase_scan

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"


def texts(n=80, seed=5):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(["a", "b", "c", "d"], k=k))
    docs = [(i, f"u{i}", text(rng.randrange(1, 4)), rng.choice([None, text(3)]), text(rng.choice([1, 2, 5, 40, 90]))) for i in range(n)]
    return [*docs, (900, "x", None, None, None), (901, "y", "", None, " .,;"), (902, "z", "a b", "c", "d a")]


def asked(docs, seed=6):
    rng = random.Random(seed)
    out = [(1, "A b."), (2, "b c d"), (3, " "), (4, None), (5, "absent"), (6, "a b absent"), (7, "a b c"), (7, "d a"), (7, "d, a")]
    for i in range(40):
        words = rng.choice([d for d in docs if d[4]])[4].split()
        at = rng.randrange(len(words))
        out.append((100 + i, " ".join(words[at : at + rng.choice([1, 2, 3, 4, 7, 8, 9, 31, 64, 65])])))
    return out


def brute(docs, phrases):
    def holds(text, words):
        own = (text or "").split()
        return any(own[i : i + len(words)] == words for i in range(len(own)))

    split = [(q, p.lower().replace(".", "").replace(",", "").split()) for q, p in phrases if p]
    return {(q, d[0]) for q, words in split if words for d in docs if any(holds(t, words) for t in d[2:])}


@pytest.mark.parametrize("sent", [1 << 20, 7])
def test_phrase_matches_of_any_length(spark, monkeypatch, sent):
    monkeypatch.setattr(phrase_scan, "SENT_PHRASES", sent)
    monkeypatch.setattr(bm25, "CELL_SIDE", 8)
    docs = texts()
    phrases = asked(docs)
    built = index.build_index(spark.createDataFrame(docs, DOCS))
    got = [tuple(r) for r in bm25.phrase_matches(built, spark.createDataFrame(phrases, "query_id INT, phrase STRING")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, phrases)


def test_pairs_of_equal_phrases_are_made_where_they_stay(spark, monkeypatch):
    """The square of a group of equal titles leaves its join as it is, from several tasks, and nothing is built per word."""
    monkeypatch.setattr(bm25, "CELL_SIDE", 50)
    docs = [(i, f"u{i}", "same old title", None, "text") for i in range(300)]
    built = index.build_index(spark.createDataFrame(docs, DOCS))
    phrases = spark.createDataFrame([(d[0], d[2]) for d in docs], "query_id INT, phrase STRING")
    found = bm25.phrase_matches(built, phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 300 * 300 and len(sizes) > 1


def test_places_are_found_in_slices(monkeypatch):
    monkeypatch.setattr(phrase_scan, "SLICE", 3)
    rng = np.random.default_rng(1)
    words, sizes = rng.integers(0, 3, 60).astype(np.uint64), np.array([0, 20, 1, 39, 0])
    ends = np.cumsum(sizes)
    rows = [words[e - n : e].tolist() for e, n in zip(ends, sizes)]
    phrases = sorted({tuple(rows[3][i : i + n]) for i in range(10) for n in (1, 2, 3, 5, 8, 20)} | {tuple(rows[1])})
    flat, n = np.array([w for p in phrases for w in p], np.uint64), np.array([len(p) for p in phrases])
    names = np.zeros((3, len(n)), np.uint64)
    for length, one, two, row, room in phrase_scan._windows(flat, n, int(n.max())):
        start = np.flatnonzero((room == n[row]) & (n[row] < 2 * length))
        names[:, row[start]] = one[start], *phrase_scan._named(one, two, start, n[row[start]], length)
    held = phrase_scan.Phrases(np.arange(len(n)), n, *names)
    got = sorted(zip(*[part.tolist() for part in held.find(words, sizes)]))
    want = sorted((r, p) for r, own in enumerate(rows) for p, phrase in enumerate(phrases)
                  for i in range(len(own) - len(phrase) + 1) if tuple(own[i : i + len(phrase)]) == phrase)
    assert got == want
