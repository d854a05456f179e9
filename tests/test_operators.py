"""Operators against plain-Python brute force, and against themselves under another layout."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import bm25, fusion, history, index, merge, rerank, running, snippet, vector, workspace
from gleanery.plans import indexing, search
from gleanery.sources import pages as P
from gleanery.sources.index_store import read_index, write_index

DOCS = [
    (1, "u1", "Rust language", "systems programming", "Rust is a fast language. Rust is safe."),
    (2, "u2", "Python language", None, "Python is a dynamic language for data."),
    (3, "u3", None, None, "Go is a language with goroutines; go is fast."),
    (4, "u4", "Cooking", "food blog", "Slow food is good food, not fast food."),
    (5, "u5", "Empty", "", ""),
]
QUERIES = [(1, "fast language"), (2, "food"), (3, "rust rust python"), (4, "nothing-here xyzzy")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id BIGINT, q STRING")


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_bm25(docs, queries):
    boosts = {"title": 2.5, "description": 1.5, "content": 1.0}
    fields = {f: {d[0]: tokens(d[i]) for d in docs if d[i] is not None} for f, i in zip(boosts, (2, 3, 4))}
    scores = defaultdict(float)
    for qid, q in queries:
        for term in tokens(q):
            for field, lists in fields.items():
                df = sum(term in t for t in lists.values())
                avg = sum(map(len, lists.values())) / len(docs)
                for doc, t in lists.items():
                    tf = t.count(term)
                    if tf:
                        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                        scores[qid, doc] += boosts[field] * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return {k: round(v, 6) for k, v in scores.items()}


def as_scores(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


def test_bm25_brute_force(docs, queries):
    assert as_scores(bm25.bm25_scores(index.build_index(docs), queries)) == pytest.approx(brute_bm25(DOCS, QUERIES))


def test_stored_index_and_layout_do_not_change_results(spark, docs, queries, tmp_path):
    want = as_scores(bm25.bm25_scores(index.build_index(docs), queries))
    stored = write_index(index.build_index(docs.repartition(3), stage=True), str(tmp_path / "ix"), buckets=4)
    assert as_scores(bm25.bm25_scores(stored, queries)) == want
    again = read_index(spark, str(tmp_path / "ix"))
    assert {r.doc_id for r in bm25.phrase_matches(again, spark.createDataFrame([(1, "is a")], "query_id INT, phrase STRING")).collect()} == {1, 2, 3}
    bare = write_index(index.build_index(docs), str(tmp_path / "bare"), with_positions=False, buckets=2)
    assert bare.positions.count() == 0


def test_paging(docs, queries):
    built = index.build_index(docs)
    full = [tuple(r) for r in bm25.bm25_search(built, queries, 10).orderBy("query_id", "rank").collect()]
    paged = []
    for offset in range(0, 6, 2):
        paged += [tuple(r) for r in bm25.bm25_search(built, queries, 2, offset).collect()]
    assert sorted(paged) == sorted(full)
    assert bm25.bm25_search(built, queries, 10, offset=50).count() == 0


def test_must_not_and_phrase(spark, docs):
    built = index.build_index(docs)
    rows = [(1, "language", ["fast"], ["goroutines"], None), (2, "language", None, None, "dynamic language"),
            (3, "food", None, None, "fast language"), (4, "rust", ["absent"], None, None)]
    qs = spark.createDataFrame(rows, "query_id INT, q STRING, must ARRAY<STRING>, must_not ARRAY<STRING>, phrase STRING")
    got = {(r.query_id, r.doc_id) for r in bm25.bm25_search_filtered(built, qs).collect()}
    # a plain word is optional beside a required one
    assert got == {(1, 1), (1, 4), (2, 2)}


def test_update_equals_rebuild(docs, queries, spark):
    changed = spark.createDataFrame([(2, "u2", "Python 3", None, "fast Python"), (6, "u6", "New", "x", "rust food")], docs.schema)
    updated = indexing.update_index(index.build_index(docs), changed)
    live = docs.where("doc_id <> 2").unionByName(changed)
    assert as_scores(bm25.bm25_scores(updated, queries)) == as_scores(bm25.bm25_scores(index.build_index(live), queries))


def test_total_hits_and_modes(spark, docs, queries):
    built = index.build_index(docs)
    asked = queries.join(vector.embed(queries, "query_id", "q"), "query_id")
    vectors = vector.embed_pages(docs.select(F.col("doc_id").alias("id"), "content"))
    for mode in ("bm25", "vector", "hybrid", "semantic", "what"):
        hits = search.hybrid_search(built, asked, vectors, mode=mode, limit=3)
        assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3
    ranked, left, right = search.ranked_hits(built, asked, vectors, "hybrid", 3)
    totals = {r.query_id: r.total_hits for r in search.total_hits(built, asked, ranked, left, right, "hybrid").collect()}
    assert totals[2] >= 1 and set(totals) == {1, 2, 3, 4}
    assert search.resolve_mode("semantic") == "vector" and search.resolve_mode(None) == "hybrid"


def test_hybrid_without_vectors_is_bm25(docs, queries):
    built = index.build_index(docs)
    hits = search.hybrid_search(built, queries, None, limit=5)
    assert {(r.query_id, r.doc_id) for r in hits.collect()} == set(brute_bm25(DOCS, QUERIES))


@pytest.mark.parametrize("query_block", [2048, 3])
def test_vector_brute_force(spark, query_block):
    rng = np.random.default_rng(7)
    pages = rng.normal(size=(300, 8)).astype(np.float32)
    pages[5] = 0
    pages[7] = pages[9]
    asked = rng.normal(size=(4, 8)).astype(np.float32)
    emb = spark.createDataFrame([(i, i % 50 == 49 and 1 or 0, v.tolist()) for i, v in enumerate(pages)],
                                "page_id BIGINT, chunk_index INT, embedding ARRAY<FLOAT>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id BIGINT, embedding ARRAY<FLOAT>")
    got = defaultdict(list)
    for r in vector.vector_search(emb, qs, 6, query_block=query_block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.page_id, r.similarity))
    for q, v in enumerate(asked.astype(float)):
        sims = {i: round(float(p @ v / np.sqrt((p @ p) * (v @ v))), vector.SCORE_DIGITS) for i, p in enumerate(pages.astype(float))
                if i != 5 and i % 50 != 49}
        want = sorted(sims.items(), key=lambda x: (-x[1], x[0]))[:6]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [v for _, v in got[q]] == pytest.approx([v for _, v in want])


def test_block_sizes_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(3)
    emb = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))],
                                "page_id BIGINT, chunk_index INT, embedding ARRAY<DOUBLE>")
    qs = emb.where("page_id < 30").select(F.col("page_id").alias("query_id"), "embedding")
    want = sorted(map(tuple, vector.vector_search(emb, qs, 5).collect()))
    monkeypatch.setattr(vector, "TILE", 11)
    assert sorted(map(tuple, vector.vector_search(emb, qs, 5, query_block=7).collect())) == want
    # vectors of another width are searched among themselves
    wide = spark.createDataFrame([(500, 0, [1.0, 2.0]), (501, 0, [2.0, -1.0])], emb.schema)
    both = vector.vector_search(emb.union(wide), qs.union(wide.select("page_id", "embedding")), 5).collect()
    assert sorted(tuple(r) for r in both if r.query_id < 500) == want
    assert [(r.page_id, r.similarity) for r in both if r.query_id == 500] == [(500, 1.0), (501, 0.0)]


def test_fuse_selector(spark):
    a = spark.createDataFrame([(1, "x", 0, 4.0), (1, "y", 1, 2.0)], "query_id INT, url STRING, rank INT, score DOUBLE")
    b = spark.createDataFrame([(1, "y", 0, 0.5), (1, "z", 1, -0.5)], "query_id INT, url STRING, rank INT, similarity DOUBLE")
    rrf = {r.url: r.score for r in fusion.fuse(a, b, 0.505, 0.5).collect()}
    assert rrf == pytest.approx({"x": 1 / 60, "y": 1 / 61 + 1 / 60, "z": 1 / 61}, abs=1e-6)
    weighted = {r.url: r.score for r in fusion.fuse(a, b, 0.8, 0.2).collect()}
    assert weighted == pytest.approx({"x": 0.8, "y": 0.4 + 0.2, "z": -0.2})
    flat = b.withColumn("similarity", F.lit(0.0))
    assert {r.url: r.score for r in fusion.fuse(a, flat, 0.8, 0.2).collect()}["z"] == 0.0


def test_rerank(spark):
    rows = [(1, r, f"u{r}", 10.0 - r, s) for r, s in enumerate([0.1, 0.9, 0.5, 0.99])] + [(2, 0, "only", 5.0, 0.7)]
    df = spark.createDataFrame(rows, "query_id INT, rank BIGINT, url STRING, score DOUBLE, model DOUBLE")
    out = [(r.query_id, r.url, r.score) for r in rerank.rerank(df, F.col("model"), top=3).orderBy("query_id", "rank").collect()]
    assert out == [(1, "u1", 0.9), (1, "u2", 0.5), (1, "u0", 0.1), (1, "u3", 7.0), (2, "only", 5.0)]
    failed = rerank.rerank(df, F.lit(None).cast("double"), top=3).orderBy("query_id", "rank").collect()
    assert [r.url for r in failed] == ["u0", "u1", "u2", "u3", "only"]


def test_batch_scorer(spark):
    df = spark.createDataFrame([(1, 0, 1.0, "a b", "b"), (1, 1, 0.5, "a b", "a b")], "query_id INT, rank BIGINT, score DOUBLE, q STRING, text STRING")
    scorer = rerank.batch_scorer(lambda q, t: t.str.len())
    assert [r.text for r in rerank.rerank(df, scorer).orderBy("rank").collect()] == ["a b", "b"]
    broken = rerank.batch_scorer(lambda q, t: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        rerank.rerank(df, broken).collect()


def test_rerank_keeps_a_list_with_a_score_missing(spark):
    rows = [(q, r, f"u{r}", 10.0 - r, s) for q, scores in ((1, [0.1, None, 0.9]), (2, [0.1, 0.5, 0.9])) for r, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "query_id INT, rank BIGINT, url STRING, score DOUBLE, model DOUBLE")
    out = rerank.rerank(df, F.col("model"), top=3).orderBy("query_id", "rank").collect()
    assert [r.url for r in out] == ["u0", "u1", "u2", "u2", "u1", "u0"]
    assert [r.score for r in out[:3]] == [10.0, 9.0, 8.0]


def test_white_space_around_values_does_not_count(spark):
    from gleanery.operators import robots

    text = "User-agent:\t*\r\nDisallow:\t/private \u00a0\nCrawl-delay:\t3"
    rules = robots.parse_robots(spark.createDataFrame([("h", text)], "host STRING, content STRING"), "bot").first()
    assert (rules.disallows, rules.crawl_delay) == (["/private"], 3.0)
    existing = spark.createDataFrame([(1, "http://a/")], "workspace_id INT, url STRING")
    batch = spark.createDataFrame([(1, 1, "\thttp://A/\n"), (1, 2, "http://b/"), (1, 3, "http://b/\x0b")], "workspace_id INT, seq INT, url STRING")
    got = workspace.bulk_add_items(existing, batch).orderBy("seq").collect()
    assert [r.status for r in got] == ["duplicate", "created", "duplicate"]


def test_update_index_with_a_url_twice(spark):
    from gleanery.plans.indexing import update_index

    schema = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"
    old = index.build_index(spark.createDataFrame([(1, "u1", "t", None, "old words"), (2, "u2", "t", None, "other")], schema), stage=True)
    changed = spark.createDataFrame([(3, "u1", "t", None, "first"), (4, "u1", "t", None, "second"), (4, "u1", "t", None, "second")], schema)
    new = update_index(old, changed)
    assert sorted(r.doc_id for r in new.docs.collect()) == [2, 4]
    found = new.postings.where("field = 'content' AND doc_id = 4").collect()
    assert [(r.term, r.tf, r.doc_len) for r in found] == [("second", 1, 1)]


def test_a_phrase_without_words_is_no_phrase(spark):
    schema = "doc_id BIGINT, url STRING, title STRING, description STRING, content STRING"
    built = index.build_index(spark.createDataFrame([(1, "u1", "t", None, "old words"), (2, "u2", "t", None, "old")], schema), stage=True)
    asked = spark.createDataFrame([(1, "old", None, None, ""), (2, "old", None, None, " - "), (3, "old", None, None, "old words")],
                                  "query_id BIGINT, q STRING, must ARRAY<STRING>, must_not ARRAY<STRING>, phrase STRING")
    hits = bm25.bm25_search_filtered(built, asked).collect()
    assert sorted((r.query_id, r.doc_id) for r in hits) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_rrf_tells_thousands_of_ranks_apart(spark):
    ranked = spark.range(5000).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"), F.format_string("u%05d", "id").alias("url"))
    fused = fusion.rrf_fuse(ranked, ranked.limit(0))
    assert fused.select("score").distinct().count() == 5000


def test_best_fragment():
    text = "alpha " * 40 + "needle in the <hay> stack " + "omega " * 40
    got = snippet.best_fragment(text, {"needle": 2.0, "stack": 1.0})
    assert "<b>needle</b>" in got and "&lt;hay&gt;" in got and len(re.sub("<.?b>", "", got)) <= 160
    assert snippet.best_fragment(text, {"zebra": 1.0}) == "" and snippet.best_fragment(None, {"a": 1.0}) == ""
    assert snippet.best_fragment("One two", {"one": 1.0}) == "<b>One</b> two"


# --- order-dependent operators against sequential simulation ---------------------------------

def test_running_total_and_previous(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(-3, 9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq BIGINT, key STRING, v BIGINT")
    totals, before, want = Counter(), {}, {}
    for seq, key, v in sorted(rows):
        totals[key] += v
        want[seq] = (totals[key], before.get(key))
        before[key] = v
    for block in (None, F.floor(F.col("seq") / 7), F.lit(0)):
        got = {r.seq: r.t for r in running.running_total(df, ["key"], ["seq"], F.col("v"), "t", block).collect()}
        assert got == {k: w[0] for k, w in want.items()}
    got = {r.seq: r.p for r in running.with_previous(df, ["key"], ["seq"], F.floor(F.col("seq") / 7), F.col("v"), "p").collect()}
    assert got == {k: w[1] for k, w in want.items()}
    numbered = running.ordered_index(df, ["v", "seq"], "n").collect()
    assert [r.seq for r in sorted(numbered, key=lambda r: r.n)] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def test_bulk_add_deals_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """The number of tasks follows the rows; one workspace far beyond its cap, a repeated URL and an empty batch come out alike."""
    ex = spark.createDataFrame([(1, "U0"), (1, "u1"), (2, "x")], "workspace_id long, url string")
    rows = [(1, i, f" U{i % 150} ") for i in range(300)] + [(2, 1000 + i, "same") for i in range(50)]
    rq = spark.createDataFrame(rows, "workspace_id long, seq long, url string")
    want = sorted((r.workspace_id, r.seq, r.status) for r in workspace.bulk_add_items(ex, rq, cap=10).collect())
    assert want[:4] == [(1, 0, "duplicate"), (1, 1, "duplicate"), (1, 2, "created"), (1, 3, "created")]
    assert [sum(s == x for *_, s in want) for x in ("created", "rejected")] == [9, 280]
    monkeypatch.setattr(workspace, "TASK_ROWS", 20)
    out = workspace.bulk_add_items(ex, rq, cap=10)
    assert sorted((r.workspace_id, r.seq, r.status) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() == 18
    assert workspace.bulk_add_items(ex, rq.limit(0), cap=10).collect() == []


def test_bulk_add_simulation(spark):
    rng = random.Random(11)
    cap, existing, batch, want = 6, [], [], {}
    for ws in range(40):
        have = [f"U{rng.randrange(12)}" for _ in range(rng.randrange(4))]
        existing += [(ws, u) for u in have]
        seen, count = {u.lower() for u in have}, len(have)
        for i in range(rng.randrange(1, 16)):
            seq = ws * 1000 + i
            url = rng.choice([" ", ""]) + rng.choice("uU") + str(rng.randrange(12))
            batch.append((ws, seq, url))
            n = url.strip().lower()
            if n in seen:
                want[seq] = "duplicate"
            elif count >= cap:
                want[seq] = "rejected"
            else:
                want[seq], count = "created", count + 1
                seen.add(n)
    ex = spark.createDataFrame(existing, "workspace_id INT, url STRING")
    rq = spark.createDataFrame(batch, "workspace_id INT, seq BIGINT, url STRING")
    statuses = workspace.bulk_add_items(ex, rq, cap=cap)
    assert {r.seq: r.status for r in statuses.collect()} == want


def test_interleave_simulation(spark):
    rng = random.Random(2)
    lefts, rights, want = [], [], {}
    for q in range(60):
        left = rng.sample(range(15), rng.randrange(8))
        right = rng.sample(range(15), rng.randrange(8))
        lefts += [(q, r, f"u{u}") for r, u in enumerate(left)]
        rights += [(q, r, f"u{u}") for r, u in enumerate(right)]
        merged, turn = [], 0
        while len(merged) < 9 and turn < max(len(left), len(right)):
            for side in (left, right):
                if turn < len(side) and len(merged) < 9 and side[turn] not in merged:
                    merged.append(side[turn])
            turn += 1
        want[q] = [f"u{u}" for u in merged]
    schema = "query_id INT, rank BIGINT, url STRING"
    got = defaultdict(list)
    out = merge.interleave_merge(spark.createDataFrame(lefts, schema), spark.createDataFrame(rights, schema), 9)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.url)
    assert {q: got[q] for q in want} == want


def test_coalescing_upsert_and_task_times(spark):
    ev = spark.createDataFrame(
        [("s", "u", 1, "A", None), ("s", "u", 2, None, "x"), ("s", "u", 3, "B", None), ("s", "v", 4, None, None)],
        "session_id STRING, url STRING, ts INT, title STRING, source STRING")
    got = {r.url: tuple(r) for r in history.coalescing_upsert(ev, ["session_id", "url"], ["title", "source"], ["ts"], "ts").collect()}
    assert got == {"u": ("s", "u", "B", "x", 1), "v": ("s", "v", None, None, 4)}
    t = spark.createDataFrame(
        [(1, 1, "pending"), (1, 2, "completed"), (1, 3, "completed"), (1, 200000, "pending"), (1, 400000, "completed"),
         (1, 400001, "completed"), (2, 5, "pending")], "task_id INT, s INT, status STRING").withColumn(
        "ts", F.timestamp_seconds("s")).withColumn("event_id", F.col("s"))
    done = {r.task_id: r.completed_at for r in history.task_completed_at(t).select(
        "task_id", F.unix_timestamp("completed_at").alias("completed_at")).collect()}
    assert done == {1: 400000, 2: None}


def test_upsert_keeps_first_and_ids(spark):
    target = spark.createDataFrame([(1, "a", "old", True), (2, "b", "old", True)], "id INT, url STRING, title STRING, indexed BOOLEAN")
    batch = spark.createDataFrame([(9, "a", "late", False), (3, "a", None, False), (4, "c", "new", False)],
                                  "seq INT, url STRING, title STRING, indexed BOOLEAN")
    got = {r.url: tuple(r) for r in P.upsert_pages(target, batch).collect()}
    assert got == {"a": (1, "a", None, False), "b": (2, "b", "old", True), "c": (None, "c", "new", False)}
    kept = {r.url: r.title for r in P.insert_ignore(target, batch).collect()}
    assert kept == {"a": "old", "b": "old", "c": "new"}


def test_facets(spark):
    rows = [("science", "https://x.org", "t", None), (None, "https://mit.edu/a", None, None), ("QA", "https://x.org", "", ""),
            (None, "https://www.nasa.gov", None, None), (None, "not a url", "The Official Website", None), (None, "https://x.org", None, None)]
    df = spark.createDataFrame(rows, "category STRING, url STRING, title STRING, snippet STRING")
    got = [(r.is_research, r.is_discussion, r.is_official) for r in merge.facet(df).collect()]
    assert got == [(True, False, False), (True, False, False), (False, True, False), (False, False, True),
                   (False, False, True), (False, False, False)]


def test_places_far_down_keep_apart(spark):
    ranks = spark.range(40_000).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), F.col("id").alias("rank"))
    fused = fusion.rrf_fuse(ranks, ranks.limit(0), key="doc_id")
    assert fused.select("score").distinct().count() == 40_000


def test_vector_grid_equals_the_broadcast_search(spark):
    """Queries beyond a block meet the vectors in cells; widths, zero vectors, ties and repeats come out alike."""
    rng = random.Random(3)
    rows = [(i, 0, [float(rng.choice([-1, 0, 1, 2])) for _ in range(4)]) for i in range(120)] + [(500, 0, [1.0, 2.0]), (501, 0, [0.0] * 4), (7, 0, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "page_id BIGINT, chunk_index INT, embedding ARRAY<FLOAT>")
    asked = vectors.select(F.col("page_id").alias("query_id"), "embedding").where("page_id % 3 = 0 OR page_id >= 500")
    whole, grid = (sorted(map(tuple, vector.vector_search(vectors, asked, k=5, query_block=b).collect())) for b in (2048, 7))
    assert whole == grid and len(whole) > 150


def test_first_of_each_key(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "n"), ("b", 5, "m"), (None, 1, "p"), (None, 1, "p"), ("c", None, "q")]
    got = P.first_per_key(spark.createDataFrame(rows, "url STRING, seq INT, text STRING"), ["url"], "seq")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, "y"), ("b", 5, "m"), (None, 1, "p"), ("c", None, "q")], key=str)
