"""Clauses scored where the texts are: the rows of the joined way, without its tables."""

import random

import pytest

from gleanery.operators import clause_scan, clauses, index

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"
GIVEN = [
    (1, "tea", "should", None, 1.0), (1, "the the", "should", None, 2.0), (1, "cold milk", "must", "content", 1.0), (1, "tea", "must", None, 1.0),
    (2, "green tea", "must", None, 1.0), (2, "leaf", "must_not", "title", 1.0), (3, "the", "should", "title", 3.0), (3, "the", "should", None, 1.5),
    (4, "milk", "must_not", None, 1.0), (5, "absent", "must", None, 1.0), (5, "tea", "should", None, 1.0), (6, "a the a", "should", None, 1.0),
    (7, "tea", "should", "url", 1.0), (8, "cup of the", "should", None, 1.0), (8, "cup", "should", "description", 1.0),
]


def asked(spark):
    return spark.createDataFrame(GIVEN, "query_id INT, text STRING, occur STRING, field STRING, boost DOUBLE")


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(2)
    words = ["tea", "milk", "green", "cold", "leaf", "cup", "the", "the", "a"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    docs = [(i, f"u{i}", text(2), rng.choice([None, text(3)]), text(rng.randrange(1, 12))) for i in range(150)]
    return index.build_index(spark.createDataFrame([*docs, (900, "x", None, None, None), (901, "y", "", None, ".")], DOCS))


@pytest.mark.parametrize("rarity", ["words", "phrase"])
def test_texts_and_joins_find_the_same(spark, built, monkeypatch, rarity):
    monkeypatch.setattr(clause_scan, "SENT_WORDS", 0)
    joined = clauses.bm25_clauses(built, asked(spark), 20, 3, rarity=rarity).collect()
    monkeypatch.setattr(clause_scan, "SENT_WORDS", 1 << 20)

    def built_from_tables(*_):
        raise AssertionError("matches of clauses are written and joined")

    monkeypatch.setattr(clauses, "literal_matches", built_from_tables)
    scanned = clauses.bm25_clauses(built, asked(spark), 20, 3, rarity=rarity)

    def shown(rows):
        return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in rows)

    assert shown(scanned.collect()) == shown(joined) and joined


def test_equal_sums_tie_across_fields_and_clauses(spark):
    """Two words of equal rarity, one in each document, asked for in different order among others: ties go to the smaller id."""
    rng = random.Random(4)
    others = [f"o{i}" for i in range(30)]
    docs = []
    for i in range(40):
        own = [*rng.sample(others, len(others)), "left" if i % 2 else "right"]
        docs.append((i, f"u{i}", None, None, " ".join(own)))
    given = [(1, w, "should") for w in ["left", *others, "right"]]
    index_ = index.build_index(spark.createDataFrame(docs, DOCS))
    got = clauses.bm25_clauses(index_, spark.createDataFrame(given, "query_id INT, text STRING, occur STRING"), 40).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == list(range(40)) and len({r.score for r in got}) == 1
