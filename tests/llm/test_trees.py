"""Conversation repair, the Merkle manifest and the exact top-k search against brute-force versions."""

import hashlib
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import conversation as cv
from gleanery.llm import merkle, topk
from gleanery.llm.ordering import ranked

CONVERSATIONS = "conv_id long, turn long, role string, text string"


# --- conversation repair


def cheapest(rows):
    """Dijkstra over (rows taken, state), the whole text of edits as the second part of the cost."""
    states = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    queue, seen = [(0, "", 0, "B")], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in "BA":
            return cost, audit
        for letter in "ua":
            if (state, letter) in states:
                heapq.heappush(queue, (cost + 3, audit + "I", at, states[state, letter]))
        if at < len(rows):
            letter, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state))
            if not gone:
                if (state, letter) in states:
                    heapq.heappush(queue, (cost + cut, audit + "K", at + 1, states[state, letter]))
                for new in "ua":
                    if (state, new) in states:
                        heapq.heappush(queue, (cost + 3 + cut, audit + "R", at + 1, states[state, new]))
    raise AssertionError


def search(rows):
    found = cv.Viterbi()
    out = []
    for letter, gone, cut in rows:
        out += found.push(letter, cv.BLANK if gone else cv.TRUNCATED if cut else 0)
    assert found.open <= len(rows)
    out += found.finish()
    return "".join(edits for edits, _, _ in out), found


def test_search_is_cheapest_and_least():
    rng = random.Random(3)
    kinds = [(a, g, c) for a in ("s", "u", "a", "t", "") for g, c in ((False, 0), (False, 3), (True, 0))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n) if n < 3 else [rng.choices(kinds, k=3) for _ in range(400)]:
            assert search(rows)[0] == cheapest(rows)[1], rows
    for _ in range(400):
        weights = [rng.random() ** 3 + 0.01 for _ in kinds]
        rows = rng.choices(kinds, weights, k=rng.randrange(4, 40))
        assert search(rows)[0] == cheapest(rows)[1], rows


def test_search_frees_what_is_certain():
    """An orderly conversation stays open for a few rows only; rows that all survivors delete cost no branch."""
    found = cv.Viterbi()
    for i in range(5_000):
        found.push("ua"[i % 2], cv.TRUNCATED if i % 7 == 0 else 0)
        assert found.open <= 4
    for _ in range(5_000):
        found.push("u", cv.BLANK)
        assert found.open <= 4


def brute_conversations(rows):
    out = {}
    white = " \t\n\x0b\x0c\r"
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or " " if r is None else r, x if x is not None else " ") for c, t, r, x in rows if c == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, marks = set(), [0, 0, 0], []
        for _, role, text in own:
            fault = 0 if not text.strip(white) else 1 if (role, text) in seen else 2 if text.rstrip(white)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), 3 if fault == 2 else 0))
        cost, audit = cheapest(marks)
        lines, at, kept, system = [], 0, 0, False
        for edit in audit:
            role, text = own[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            kept += 1
            system = system or (kept == 1 and edit == "K" and role[0] == "s")
            lines.append((role if edit == "K" else ("assistant", "user")[(kept - system) % 2]) + ":" + text)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations_against_brute_force(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "usher"]
    texts = ["Yes.", "No", "  \t\n", "", None, "So it is! \n", "Long " * 50 + "?", "été。", "half . way", "Yes.", " "]
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([0, 1, 2, 3, 7, None]), rng.choice(roles), rng.choice(texts)) for _ in range(90)]
    rows += [(9, i, "user", "Again and again.") for i in range(60)] + [(10, 1, "user", "Twice.")] * 2
    rows += [(11, i, ("user", "assistant")[i % 2], f"Turn {i}" + "." * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    wide = df.withColumn("fault", F.lit("x")).withColumn("place", F.lit(1)).withColumn("edit", F.lit(2))
    got = {r[0]: tuple(r)[1:] for r in cv.repaired_conversations(wide, wide).collect()}
    assert got == brute_conversations(rows)


def test_edits_rebuild_the_conversation(spark):
    rows = [(1, 0, "user", "A?"), (1, 1, "user", "B."), (1, 2, "assistant", ""), (1, 3, "system", "late.")]
    edits = cv.repair(spark.createDataFrame(rows, CONVERSATIONS)).orderBy("place").collect()
    assert [(e.edit, e.role, e.text) for e in edits][:2] == [("K", "user", "A?"), ("I", "assistant", "")] or "".join(e.edit for e in edits) == cheapest(
        [("u", False, 0), ("u", False, 0), ("a", True, 0), ("s", False, 0)])[1]
    assert [e.last for e in edits] == [False] * (len(edits) - 1) + [True]
    assert all(e.text is None for e in edits if e.edit == "D")


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert cv.repaired_conversations(none, none).collect() == []
    one = spark.createDataFrame([(None, None, None, None), (4, 1, "user", "x")], CONVERSATIONS)
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in cv.repaired_conversations(one, none).collect()}
    assert got == {None: (0, "", hashlib.sha256(b"").hexdigest()), 4: (0, "", hashlib.sha256(b"").hexdigest())}


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def proof_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_brute_force(spark, height):
    rng = random.Random(height)
    rows = []
    for source, n in (("b", 47), (None, 3), ("a", 1), ("ä", 28), ("Z", 9), ("", 10)):
        for i in range(n):
            leaf = h(str(source), str(i))
            rows.append((source, rng.choice([i, i, i, i, None, 7]), leaf, h("no") if i % 4 == 0 else None))
    rows += [("b", 5, h("same"), None)] * 3
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string, claim string").repartition(4)
    got = merkle.certify(df.withColumn("rank", F.lit("r")).withColumn("n", F.lit(1)), height).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))
    by = {s: list(g) for s, g in itertools.groupby(order, key=lambda r: r[0])}
    trees = {s: tree([r[2] for r in g]) for s, g in by.items()}
    crown = tree([trees[s][-1][0] for s in by])
    want = []
    for place, (source, own) in enumerate(by.items()):
        for i, (_, doc, leaf, claim) in enumerate(own):
            proof = proof_of(trees[source], i) + proof_of(crown, place)
            node = claim or leaf
            for left, right in proof:
                node = h(left, node, right)
            want.append((doc, leaf, trees[source][-1][0], crown[-1][0], proof, node, node == crown[-1][0]))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof], r.folded_root, r.verified) for r in got), key=key) == sorted(want, key=key)
    assert sum(not r.verified for r in got) == sum(r[3] is not None for r in rows)


@pytest.mark.parametrize("height", [1, 2])
def test_log_is_in_completion_order(spark, height):
    """Every node stands at its closed-form place, and the places of a key are those of one walk through its tree."""
    sizes = {"x": 1, "y": 14, "z": 65}
    rows = [(k, i, h(k, str(i))) for k, n in sizes.items() for i in range(n)]
    leaves = ranked(spark.createDataFrame(rows, "key string, id long, digest string"), ["key"], ["id"], "t").withColumn("of", F.col("id"))
    built = merkle.build_trees(leaves, height)
    log = merkle.append_log(built).collect()
    for k, n in sizes.items():
        nodes = sorted((r.pos, r.level, r["index"], r.digest) for r in log if r.key == k)
        levels = tree([h(k, str(i)) for i in range(n)])
        walk = merkle.completion_order(levels[0], len(levels) - 1)
        assert [(p, *w) for p, w in enumerate(walk)] == nodes
        assert all(levels[level][i] == d for level, i, d in walk) and len(walk) == sum(map(len, levels))


def test_manifest_of_little(spark):
    schema = "source string, doc_id long, leaf string, claim string"
    assert merkle.certify(spark.createDataFrame([], schema)).collect() == []
    one = merkle.certify(spark.createDataFrame([(None, None, h("x"), None)], schema)).first()
    assert (one.subroot, one.root, one.proof, one.verified) == (h("x"), h("x"), [], True)
    texts = spark.createDataFrame([("é\n",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(merkle.field(F.col("t"))).collect()] == ["3:é\n", "-", "0:"]


# --- exact top-k


VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, ask, k):
    whole = []
    for place, (name, x) in enumerate(rows):
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            whole.append((place, name, [math.floor(1024 * float(v)) for v in x]))
    out = []
    for place, name, q in whole:
        if name is None or not ask(name):
            continue
        hits = [(-sum(a * b for a, b in zip(q, x, strict=True)), other is None, other or 0, other) for p, other, x in whole if p != place and len(x) == len(q)]
        for rank, (score, _, _, other) in enumerate(sorted(hits, key=lambda t: t[:3])[:k], 1):
            out.append((name, rank, other, -score))
    return sorted(out, key=str)


def top(df, ask=5, k=10, **sizes):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % ask == 0, k, **sizes).collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_top_k_against_brute_force(spark, small):
    """Ties, repeats, hot vectors, several widths and rows that take no part; small blocks make many cells."""
    sizes = {"block_rows": 8, "group_rows": 32, "cell_queries": 10} if small else {}
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.5, 0.0, -1.0]) for i in range(60)] + [(3, rows[3][1]), (5, rows[5][1]), (None, rows[7][1])]
    rows += [(300 + i, [0.5 * i, -1.0]) for i in range(7)] + [(315, []), (320, [])]
    rows += [(330, None), (335, [1.0, None]), (340, [float("nan")] * 6), (345, [float("inf")] + [0.0] * 5)]
    rng.shuffle(order := list(range(len(rows))))
    df = spark.createDataFrame([rows[i] for i in order], VECTORS).repartition(4)
    assert top(df.withColumn("rank", F.lit("x")).withColumn("group", F.lit(1)), **sizes) == brute_top(rows, lambda i: i % 5 == 0, 10)


def test_top_k_of_large_weights(spark):
    rows = [(i, [(-1.0) ** i * 2.0 ** (17 + i % 3), 1.0 + i]) for i in range(12)]
    assert top(spark.createDataFrame(rows, VECTORS), 4, 3) == brute_top(rows, lambda i: i % 4 == 0, 3)
    huge = [(0, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [3e38, 1e38]), (3, [-3e38, 0.0])]
    assert top(spark.createDataFrame(huge, VECTORS), 4, 3) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 3, -(2**63))]


def test_top_k_of_little(spark):
    assert top(spark.createDataFrame([], VECTORS)) == []
    assert top(spark.createDataFrame([(5, [1.0])], VECTORS)) == []
    assert top(spark.createDataFrame([(1, [1.0]), (2, [1.0])], VECTORS)) == []
    assert top(spark.createDataFrame([(5, [1.0]), (2, [2.0])], VECTORS)) == [(5, 1, 2, 2048 * 1024)]


def test_blocks_that_cannot_win_stay_closed():
    """Far-apart clusters: a query opens a small part of the blocks and finds the same hits."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (np.repeat(np.eye(16), topk.BLOCK_ROWS, axis=0) + rng.normal(scale=0.01, size=(16 * topk.BLOCK_ROWS, 16))))
    group = topk.Group(list(range(len(x))), np.arange(len(x)), x)
    own = np.arange(0, len(x), 64)
    found = {(i, j) for i, j, _ in group.search(x[own], 10, own, [None] * len(own))}
    scores = x[own] @ x.T
    scores[np.arange(len(own)), own] = -np.inf
    assert found == {(i, int(j)) for i in range(len(own)) for j in sorted(range(len(x)), key=lambda j: (-scores[i, j], j))[:10]}
    assert group.visited <= 2 * len(own)


def test_pipeline_bounds_batches_of_texts(spark):
    import corpus_pipeline
    from gleanery.session import BATCH_BYTES, bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        texts = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id AS string), 800) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
        corpus_pipeline.by_language(spark, texts, "")

        def sizes(batches):
            for batch in batches:
                yield batch.select(["id"]).slice(0, 0) if batch.nbytes < 2 * BATCH_BYTES else batch.select(["id"])

        assert texts.selectExpr("doc_id AS id", "text").mapInArrow(sizes, "id long").count() == 0
        spark.conf.set(name, "1k")
        bound_batches(spark)
        assert spark.conf.get(name) == "1k"
    finally:
        spark.conf.set(name, before)
