"""Clause search against a sequential version; block-bounded search against full scoring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import block_max, bm25, clauses, index
from gleanery.sources.index_store import write_index

DOCS = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"
BOOSTS = {"title": 2.5, "description": 1.5, "content": 1.0}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["tea", "milk", "green", "cold", "leaf", "cup", "the", "the", "the", "a"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    return [(i, f"u{i}", text(2), rng.choice([None, text(3)]), text(rng.randrange(1, 15))) for i in range(n)]


def brute(docs, given, rarity, k):
    fields = {f: {d[0]: d[2 + j].split() for d in docs if d[2 + j] is not None} for j, f in enumerate(BOOSTS)}
    average = {f: sum(map(len, t.values())) / len(docs) for f, t in fields.items()}

    def count(words, text):
        return sum(text[i : i + len(words)] == words for i in range(len(text) - len(words) + 1))

    def idf(df):
        return math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))

    out = []
    for query in sorted({c[0] for c in given}):
        own = [(c[1].lower().split(), c[2], c[3], c[4]) for c in given if c[0] == query and c[1].strip()]
        scores = []
        for doc in docs:
            total, hit, ok = 0.0, False, True
            for words, occur, only, boost in own:
                matched = False
                for field, texts in fields.items():
                    tf = count(words, texts.get(doc[0], []))
                    if not tf or only not in (None, field):
                        continue
                    matched = True
                    if rarity == "phrase" and len(words) > 1:
                        rare = idf(sum(count(words, t) > 0 for t in texts.values()))
                    else:
                        rare = sum(idf(sum(w in t for t in texts.values())) for w in words)
                    norm = 1.2 * (0.25 + 0.75 * len(texts[doc[0]]) / average[field])
                    total += (occur != "must_not") * boost * BOOSTS[field] * rare * tf * 2.2 / (tf + norm)
                ok &= matched if occur == "must" else not matched if occur == "must_not" else True
                hit |= matched and occur != "must_not"
            if ok and hit:
                scores.append((-round(total, 9), doc[0]))
        out += [(query, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:k])]
    return out


GIVEN = [
    (1, "tea", "should", None, 1.0), (1, "the the", "should", None, 2.0), (1, "cold milk", "must", "content", 1.0),
    (2, "green tea", "must", None, 1.0), (2, "leaf", "must_not", "title", 1.0), (2, "cup the", "must_not", None, 1.0),
    (3, "the", "should", "title", 3.0), (3, "the", "should", "title", 1.0), (3, " ", "must", None, 1.0),
    (4, "milk", "must_not", None, 1.0), (5, "absent", "must", None, 1.0), (5, "tea", "should", None, 1.0),
    (6, "the the the", "should", "content", 1.0), (6, "a the a", "should", None, 1.0),
]


@pytest.mark.parametrize("rarity", ["words", "phrase"])
@pytest.mark.parametrize("stored", [False, True])
def test_clauses(spark, tmp_path, rarity, stored):
    docs = corpus()
    built = index.build_index(spark.createDataFrame(docs, DOCS), stage=True)
    if stored:
        built = write_index(built, str(tmp_path / "ix"), buckets=4)
    asked = spark.createDataFrame(GIVEN, "query_id INT, text STRING, occur STRING, field STRING, boost DOUBLE")
    got = clauses.bm25_clauses(built, asked, k=15, rarity=rarity).withColumn("score", F.round("score", 6))
    want = [(q, r, d, round(s, 6)) for q, r, d, s in brute(docs, GIVEN, rarity, 15)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clauses_of_nothing(spark):
    built = index.build_index(spark.createDataFrame([], DOCS), stage=True)
    asked = spark.createDataFrame([(1, "tea time", "must")], "query_id INT, text STRING, occur STRING")
    assert clauses.bm25_clauses(built, asked, k=5).collect() == []
    with pytest.raises(ValueError):
        clauses.bm25_clauses(built, asked, k=5, rarity="none")


@pytest.mark.parametrize("k,offset", [(1, 0), (5, 3), (500, 0)])
def test_blocks_give_the_rows_of_full_scoring(spark, tmp_path, k, offset):
    docs = corpus(300, 4) + [(1000 + i, f"v{i}", "tea", None, "tea tea") for i in range(30)]
    stored = write_index(index.build_index(spark.createDataFrame(docs, DOCS), stage=True), str(tmp_path / "ix"), buckets=4)
    blocks = block_max.write_blocks(stored, str(tmp_path / "blocks"), block_docs=8)
    asked = spark.createDataFrame([(1, "tea"), (2, "green leaf the"), (3, "absent"), (4, "the a a tea")], "query_id INT, q STRING")
    got = block_max.bm25_search_blocks(stored, blocks, asked, k, offset)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.bm25_search(stored, asked, k, offset).collect()))


def test_bounds_hold_and_close_blocks(spark, tmp_path):
    """No document scores more than the bound of its block; a rare word leaves most blocks below the k-th score."""
    rng = random.Random(7)
    docs = [(i, f"u{i}", None, None, " ".join(["the"] * rng.randrange(1, 5) + [f"w{rng.randrange(300)}"] * 2)) for i in range(800)]
    stored = write_index(index.build_index(spark.createDataFrame(docs, DOCS), stage=True), str(tmp_path / "ix"), buckets=4)
    blocks = block_max.write_blocks(stored, str(tmp_path / "blocks"), block_docs=16)
    asked = spark.createDataFrame([(1, "the w5 w6 w7")], "query_id INT, q STRING")
    weights = bm25.term_weights(stored, bm25.query_terms(asked))
    bounds = {r.doc_block: r.bound for r in block_max.block_bounds(blocks, weights).collect()}
    where = {e.doc_id: r.doc_block for r in blocks.collect() for e in r.entries}
    scores = {r.doc_id: r.score for r in bm25.bm25_scores(stored, asked).collect()}
    assert all(s <= bounds[where[d]] + 1e-9 for d, s in scores.items())
    third = sorted(scores.values())[-3]
    assert sum(b >= third for b in bounds.values()) < len(bounds) / 2


def test_equal_documents_tie_in_any_order_of_rows(spark):
    """Parts of very different size, dealt at random: plain sums of doubles would differ in the last places."""
    rng = random.Random(3)
    values = [rng.random() * 10 ** rng.randrange(-6, 3) for _ in range(40)]
    rows = [(i, v) for i in range(300) for v in rng.sample(values, len(values))]
    sums = spark.createDataFrame(rows, "id INT, v DOUBLE").repartition(7).groupBy("id").agg(clauses.exact_sum(F.col("v")).alias("s"))
    assert len({r.s for r in sums.collect()}) == 1
    assert abs(sums.first().s - math.fsum(values)) < 1e-9


def test_phrase_places_read_the_rarest_word_only(spark, tmp_path):
    docs = [(i, f"u{i}", "the the", None, "the cat " * 20 + ("the zebra sat" if i % 10 == 0 else "the zebu")) for i in range(40)]
    stored = write_index(index.build_index(spark.createDataFrame(docs, DOCS), stage=True), str(tmp_path / "ix"), buckets=4)
    asked = spark.createDataFrame([(1, "the zebra sat"), (2, "The Zebra SAT"), (3, "the zebu sat"), (4, "the the")], "query_id INT, phrase STRING")
    # of the four phrases, "zebra"/"sat" (4 places), "zebu" (36 or 4) and "the" are asked for, and equal phrases once
    got = {(r.query_id, r.doc_id) for r in bm25.phrase_matches(stored, asked).collect()}
    zebras = {d[0] for d in docs if d[0] % 10 == 0}
    assert got == {(q, d) for q in (1, 2) for d in zebras} | {(4, d[0]) for d in docs}
    words = spark.createDataFrame([(["the", "zebra", "sat"],), (["the", "zebra", "sat"],)], "words ARRAY<STRING>")
    assert sorted(r.start for r in bm25.phrase_places(stored, words).collect()) == [40] * 4


def test_blocks_are_built_and_scored_without_a_row_per_query_and_posting(spark, tmp_path):
    """Building a block shuffles documents only, and its rows are those of the postings; a null or blank field has none."""
    docs = [*corpus(200, 9), (900, "x", None, None, None), (901, "y", "", None, " .,;")]
    built = index.build_index(spark.createDataFrame(docs, DOCS))
    blocks = block_max.posting_blocks(built, block_docs=16)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    rows = blocks.collect()
    assert len({(r.field, r.term, r.doc_block) for r in rows}) == len(rows)
    assert all((r.n, r.max_tf, r.min_len) == (len(r.entries), max(e.tf for e in r.entries), min(e.doc_len for e in r.entries)) for r in rows)
    got = {(r.field, r.term, e.doc_id, e.tf, e.doc_len) for r in rows for e in r.entries}
    assert got == {tuple(r) for r in built.postings.collect()}
    stored, kept = block_max.write_block_index(built, str(tmp_path / "ix"), block_docs=16)
    assert {tuple(r) for r in stored.term_stats.select("field", "term", "df").collect()} == {tuple(r) for r in built.term_stats.collect()}
    asked = spark.createDataFrame([(1, "tea"), (2, "green leaf the"), (3, "absent")], "query_id INT, q STRING")
    got = block_max.bm25_search_blocks(stored, kept, asked, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.bm25_search(built, asked, 7).collect()))
