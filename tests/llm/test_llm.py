"""The training-data operators against brute force, libraries and hand-made cases."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gleanery.llm import (
    components, decontaminate, fm_index, jaccard, language, line_dedup, mixing, pieces, quality, queries, substring, token_count,
    token_files, url_filter,
)
from gleanery.session import scratch_path

SF = "/root/testdata/sf0.001"
BYTE_LEVEL, WORD_LEVEL = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RULES = queries.RULES

PASSAGE = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, f"start here {PASSAGE} end of one", "en", "a", 1),
    (2, f"another {PASSAGE} tail", "en", None, 1),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n ", "de", "b", 0),
    (None, PASSAGE, "fr", "b", 0),
    (6, "einzig", "de", "b", 0),
    (6, "einzig", "de", "b", 0),
    (7, "L1 a\nL2 b\nL3 c\n\nL4 d", "en", "c", 0),
    (8, "x\nL1 a\n\nL2 b\nL3 c\nL4 d\ny", "en", "c", 0),
    (9, "!!! ### 123", "en", "c", 0),
    (10, "<|endoftext|> it's ﬁne İ 12" + " long" * 60_000, "en", "c", 0),
]
OPERATORS = {
    "language": lambda docs: language.identify(docs, [("en", b" word the one "), ("de", b" einzig der ")]),
    "substring": substring.dedup_substrings,
    "lines": line_dedup.dedup_lines,
    "leaks": lambda docs: decontaminate.find_leaks(docs, docs.sparkSession.createDataFrame([(1, PASSAGE), (2, None), (3, " ")], "item_id long, text string")),
    "counts": lambda docs: token_count.count_tokens(docs, BYTE_LEVEL),
    "mix": mixing.mix_sources,
    "files": lambda docs: _files(docs),
    "jaccard": jaccard.jaccard_components,
    "quality": quality.quality_filter,
}


def _files(docs):
    folder = scratch_path(docs.sparkSession, "files")
    token_files.write_token_files(docs, folder, WORD_LEVEL, end_id=1, parts=3)
    return token_files.read_token_files(docs.sparkSession, folder)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result_and_no_table_is_too_small(spark, docs, name):
    """Nulls, empty and long texts, repeated rows and clashing columns give a row each; an empty table none."""
    clashing = docs.withColumns({c: F.lit(7) for c in (
        "n", "h1", "at", "size", "token", "grp", "part", "kept", "rejected", "score", "ids", "found", "copies", "cold", "name", "u", "x")})
    got = OPERATORS[name](clashing).collect()
    assert len(got) == len(ROWS)
    plain = OPERATORS[name](docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in plain)
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


# 1 language

def test_language_held_out_accuracy(spark, documents):
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert sum(not r["rejected"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_letters_or_margin(docs):
    got = {r["doc_id"]: r for r in language.identify(docs, [("en", b" the of and for with " * 9), ("de", b" der einzig einzige und " * 9)]).collect()}
    for doc_id in (3, 4, 5):
        assert (got[doc_id]["lang_pred"], got[doc_id]["score"], got[doc_id]["rejected"]) == ("und", 0.0, True)
    judge = language.Classifier([("en", b" the only word of the kind that there is here " * 3), ("de", b" der einzige seiner art und gattung hier im ort " * 3)])
    assert [judge.predict(t)[0::2] for t in ("Der einzige seiner Art, hier im Ort.", "the only word of the kind")] == [("de", False), ("en", False)]
    assert language.Classifier([("a", b" zzzzzz "), ("b", b" yyyyyy ")]).predict("wholly unlike")[2]


# 2 substrings

def _substrings(rows):
    def order(i):
        return np.iinfo(np.int64).max if i is None else i

    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < order(i):
                gone.update(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _digest(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substrings_like_brute_force(spark, docs, documents, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    for table in (docs, documents.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert _digest(substring.dedup_substrings(table)) == _substrings(rows)


def test_substring_spans(docs):
    got = {r["doc_id"]: r for r in substring.dedup_substrings(docs.filter("doc_id in (1, 2)")).collect()}
    assert got[1]["n_removed"] == 0
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(1, 41)]
    assert got[2]["kept_text"] == "another tail"


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    symbols = np.append(rng.integers(1, 4, 300), 0)
    index = fm_index.FMIndex(symbols, 300)
    for length in (1, 2, 5):
        patterns = symbols[rng.integers(0, 300 - length, 40)[:, None] + np.arange(length)]
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns, low, high):
            want = [i for i in range(301 - length + 1) if (symbols[i : i + length] == pattern).all()]
            if b - a > 1:
                assert sorted(index.order[a:b].tolist()) == want
            else:
                assert len(want) == 1 and want[0] <= index.order[a] < want[0] + length


# 3 urls

def test_aliases_of_blocked_pages(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    pages = spark.createDataFrame([
        (1, "http://a.example.com/en/1", link.format("http://bad.net/x")),
        (2, "http://b.example.com/en/2#top", link.format("//a.example.com/en/1")),
        (3, "http://www.example.net/en/3", link.format("http://b.example.com/en/2")),
        (4, "http://free.example.com/en/4", '<meta http-equiv="refresh" content="0; url=/en/5">'),
        (5, "http://free.example.com/en/5", None),
        (6, "no url", "<p>"), (7, None, None), (8, "HTTP://X.Org?q", ""), (8, "http://EXAMPLE.com/de/?q", ""), (9, "http://xnet/", ""),
        (10, "https://b.example.com/en/2", "<link rel=canonical>"),
    ], "page_id long, url string, html string")
    got = [tuple(r) for r in url_filter.filter_urls(pages, RULES).orderBy("page_id", "host").collect()]
    assert got == [
        (1, "a.example.com", "/en/1", None, "block", True),
        (2, "b.example.com", "/en/2", None, "block", True),
        (3, "www.example.net", "/en/3", "example.net/en/", "allow", False),
        (4, "free.example.com", "/en/4", None, "allow", False),
        (5, "free.example.com", "/en/5", None, "allow", False),
        (6, "", "", None, "allow", False), (7, "", "", None, "allow", False),
        (8, "example.com", "/de/", "example.com/de/", "block", False), (8, "x.org", "", None, "allow", False),
        (9, "xnet", "/", None, "allow", False),
        (10, "b.example.com", "/en/2", None, "block", True),
    ]
    redirects = spark.createDataFrame([("http://free.example.com/en/5", "https://net/"), (None, "x")], "from_url string, to_url string")
    again = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, RULES, redirects).collect()}
    assert again[4] == again[5] == "block"
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_aliases_by_another_spelling(spark):
    """Both ends of an alias edge have one name: empty path, entities, encoded letters, ports and dot segments."""
    link = '<link rel="canonical" href="{}">'
    plain = ["http://one.org", "http://two.org/p?a=1&b=2", "http://three.org/ä b", "http://four.org:80/x", "https://five.org/a/../b", "http://six.org/%c3%a4"]
    spelled = ["http://one.org/", "http://two.org/p?a=1&amp;b=2", "/%C3%A4%20b", "http://four.org/x", "https://five.org:443/./b", "//six.org/&#228;"]
    rows = [(i, url, None) for i, url in enumerate(plain)]
    # each plain page is a link target of a page that also redirects to a blocked host
    rows += [(100 + i, plain[i].split("/", 3)[0] + "//" + plain[i].split("/")[2] + f"/from{i}", link.format(t)) for i, t in enumerate(spelled)]
    rows += [(200, "http://seven.org/y", link.format("http://seven.org/z")), (201, "http://seven.org/z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame(
        [(r[1], "http://net:80") for r in rows if 100 <= r[0] < 200] + [("http://eight.org:80", "http://net/é")], "from_url string, to_url string")
    pages = pages.union(spark.createDataFrame([(300, "http://eight.org/", None)], pages.schema))
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in url_filter.filter_urls(pages, RULES, redirects).collect()}
    assert got == {r[0]: ("block", True) if r[0] < 200 else ("allow", False) for r in rows} | {300: ("block", True)}
    raw = {r["page_id"]: (r["host"], r["path"]) for r in url_filter.filter_urls(pages, RULES).collect()}
    assert (raw[0], raw[2], raw[3]) == (("one.org", ""), ("three.org", "/ä b"), ("four.org:80", "/x"))


def test_aliases_of_pages_blocked_as_they_stand(spark):
    pages = spark.createDataFrame([
        (1, "http://a.org/ü/1", None), (2, "http://b.org/2", '<link rel=canonical href="http://a.org/&uuml;/1">'),
        (3, "http://a.org/ü/../3", None), (4, "http://b.org/4", '<link rel=canonical href="http://a.org/3">'),
        (5, "http://b.org/5", '<link rel=canonical href="http://a.org/%c3%bc/5">')], "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in url_filter.filter_urls(pages, [("block", "a.org/ü/")]).collect()}
    assert got == {1: ("block", False), 2: ("block", True), 3: ("block", False), 4: ("block", True), 5: ("block", True)}


def test_references_of_attributes(spark):
    texts = ["?a=1&amp;b&copy=2&copy;&lt&#228;&#xE4;x", "&#0;&#x110000;&#150;&#x1F600;&#99999999999;", "&unknown;&&#;&", "a", "&#38", "", None, "&notit;"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r["x"] for r in table.orderBy("i").select(url_filter.decoded(F.col("t")).alias("x")).collect()]
    assert got == ["?a=1&b&copy=2©<ääx", "\ufffd\ufffd–😀\ufffd", "&unknown;&&#;&", "a", "&", "", None, "&notit;"]


def test_components_like_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is None:
            top(a)
        else:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


# 4 lines

def test_lines(docs):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.filter("doc_id in (3, 7, 8)")).collect()}
    assert (got[7]["text"], got[7]["n_lines"], got[7]["n_removed"]) == (ROWS[8][1], 4, 0)
    assert (got[8]["text"], got[8]["n_lines"], got[8]["n_removed"]) == ("x\n\ny", 6, 4)
    assert (got[3]["text"], got[3]["n_lines"]) == (None, 0)


def test_lines_repeated_in_one_document(spark):
    table = spark.createDataFrame([(1, "a\na\na\na\nb"), (1, "a\na\na\na\nb"), (2, "a\na")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(table).collect())
    assert got == [(1, "a\nb", 3), (1, "a\nb", 3), (2, "a\na", 0)]


# 5 decontamination

def test_leaks_with_edits(spark):
    item = [f"item{i}" for i in range(30)]
    edited = item[:4] + ["other"] + item[5:14] + item[15:22] + ["more", *item[22:]]
    far = [w if i % 3 else "no" for i, w in enumerate(item)]
    table = spark.createDataFrame([
        (1, "before " + " ".join(item) + " after"), (2, "Before " + " ".join(edited).upper()), (3, " ".join(far)), (4, " ".join(item[:15])),
        (5, None), (6, ""), (7, "x " * 50_000 + " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["distance"]) for r in decontaminate.find_leaks(table, bench).collect()}
    assert got == {1: ([10, 13], 0), 2: ([10, 13], 3), 3: ([], None), 4: ([], None), 5: ([], None), 6: ([], None), 7: ([10, 13], 0)}
    assert decontaminate.find_leaks(table, bench.limit(0)).filter("contaminated").count() == 0


def test_leaks_after_a_chance_hit_at_the_start(spark):
    """Hits of several alignments whose windows all begin at the document's first word."""
    item = [f"item{i}" for i in range(30)]
    texts = [item[17:21] + item, item[25:30] + item, item[4:8] + ["x"] + item[:12] + ["y"] + item[13:], item[17:21] + item[:20]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["distance"]) for r in decontaminate.find_leaks(table, bench).collect()}
    assert got == {0: ([1], 0), 1: ([1], 0), 2: ([1], 1), 3: ([], None)}


def test_leaks_like_exhaustive_distance():
    rng = np.random.default_rng(8)
    seen = 0
    for _ in range(200):
        item = [f"w{x}" for x in rng.integers(0, 25, rng.integers(5, 40))]
        edited = [w if rng.random() > 0.1 else "z" for w in item]
        low = int(rng.integers(0, len(item)))
        text = item[low : low + int(rng.integers(0, 9))] + edited + item[: int(rng.integers(0, 9))]
        words, wanted = decontaminate.word_hashes(" ".join(text)), decontaminate.word_hashes(" ".join(item))
        distance = decontaminate.infix_distance(wanted.tolist(), words.tolist())
        got = decontaminate.Pieces([(1, " ".join(item))], 5).matches(words, np.array([0, len(words)]))
        assert got == [{1: distance} if distance <= len(item) // 5 else {}]
        seen += distance <= len(item) // 5
    assert 50 < seen < 200


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], " ".join(r["text"].lower().split())) for r in bench.limit(4).collect()]
    want = {r["doc_id"]: sorted(i for i, t in items if t in " ".join((r["text"] or "").lower().split())) for r in documents.collect()}
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_leaks(documents, bench.limit(4)).collect()}
    assert all(set(want[i]) <= set(got[i]) for i in want)


def test_infix_distance_like_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 70)).tolist(), rng.integers(0, 5, rng.integers(0, 90)).tolist()
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.infix_distance(item, text) == min(row)


# 6 and 8 tokens

def test_token_counts_are_the_library_s(docs, documents):
    library = Tokenizer.from_file(BYTE_LEVEL)
    for table in (docs, documents):
        want = sorted(
            (str(r["doc_id"]), len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 512)
            for r in table.collect())
        assert sorted((str(a), b, c, d) for a, b, c, d in token_count.count_tokens(table, BYTE_LEVEL).collect()) == want


def test_piece_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(pieces, "REFUSALS", 50)
    library, own = Tokenizer.from_file(BYTE_LEVEL), pieces.Pieces(BYTE_LEVEL, pieces.BYTE_LEVEL, len)
    for i in range(30):
        text = " ".join(f"w{chr(97 + j % 26)}x{'q' * (i + j)}" for j in range(12))
        assert own.each([text], sum) == [len(library.encode(text).ids)]
        assert len(own.known) < 60


def test_token_files_round_trip(docs, documents):
    library = Tokenizer.from_file(WORD_LEVEL)
    for table in (docs, documents):
        encoded = [(r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u2")) for r in table.collect()]
        encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].tobytes()))
        want, start = [], 0
        for place, (doc_id, ids) in enumerate(encoded):
            want.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), place))
            start += len(ids)
        assert [tuple(r) for r in _files(table).orderBy("place").collect()] == want


# 7 mixing

def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n), f"s{min(9, int(x))}") for i, (n, x) in enumerate(zip(rng.integers(0, 60, 3000), rng.exponential(3, 3000)))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(table).collect()
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    for found in by_source.values():
        assert found[0]["target"] <= 3 * found[0]["source_size"]
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 30
    total = sum(r["size"] for r in got)
    assert sum(found[0]["target"] for found in by_source.values()) == pytest.approx(total)
    again = mixing.mix_sources(table.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


# 9 Jaccard

def _components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_like_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "SLICE", 3)
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 500, 120)]
    made = []
    for i in range(70):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"e{rng.integers(0, 40)}"
        made.append((100_000 + i, " ".join(words[: rng.integers(90, 121)])))
    made += [(200_000 + i, t) for i, t in enumerate(["a b", "A B", "a b c d", "a  b\nc d", "", "x y z q " * 3, "x y z q " * 5])]
    rows = made + [(r["doc_id"], r["text"]) for r in documents.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table, k, percent).collect()}
        assert got == _components(rows, k, percent)


@pytest.mark.parametrize("mixed", [False, True])
def test_jaccard_bounds_hold_in_groups_of_mixed_sizes(spark, mixed):
    """Every linked pair of different components is opened, whatever the components are and whether groups mix them."""
    percent, rng, sets, parts = 85, np.random.default_rng(6), {}, {}
    for family in range(60):
        pool = rng.permutation(2_000)[:400]
        for member in range(6):
            i = 10 * family + member
            sets[i] = set((pool[: rng.integers(85, 120)] if member else pool[:100]).tolist())
            sets[i] = {x for x in sets[i] if rng.random() > 0.02} | set(pool[rng.integers(120, 400, rng.integers(0, 9))].tolist())
            parts[i] = 10 * family + (0, 1, 1, 1, 4, 4)[member]
    # the query has s0 to s15 first; y has 13 of its own before s0 to s3; z, in one group with y, has s12 among its first
    shared, own = [5_000 + x for x in range(97)], [9_000 + x for x in range(100)]
    sets |= {1_000: {*shared, *own[:3]}, 1_001: {*range(3_000, 3_013), *shared}, 1_002: {*range(4_000, 4_012), shared[12], *own[20:92]}}
    parts |= {1_000: 1_000, 1_001: 1_001, 1_002: 1_001}
    sizes = collections.Counter(parts.values())
    group = {i: i // 20 if mixed else parts[i] for i in sets}
    members = collections.Counter(group.values())
    rows = [
        (i, parts[i], sizes[parts[i]], (group[i], 0), members[group[i]], len(x), [256 * t for t in sorted(x)[: jaccard._leading(np.array(len(x)), percent)]])
        for i, x in sets.items()
    ]
    table = spark.createDataFrame(rows, "doc_id long, part long, part_size long, grp struct<centre: long, chunk: long>, grp_size long, n long, leading array<long>")
    opened = jaccard._qualifying(table, percent).collect()
    got = {(min(r.query, i), max(r.query, i)) for r in opened for i in sets if group[i] == r.grp.centre}
    want = {(a, b) for a in sets for b in sets if a < b and parts[a] != parts[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert (1_000, 1_001) in want and len(want) > 100
    assert want - got == set()


def test_a_tile_tells_enough_links():
    """Whatever the sets, queries and members end in the components that all their links give."""
    rng = np.random.default_rng(9)
    pool = rng.permutation(1_000).astype(np.uint64)
    sets = [np.sort(rng.choice(pool[:60], rng.integers(40, 60), replace=False)) for _ in range(40)] + [np.sort(pool[100:130])]
    parts = [int(x) for x in rng.integers(0, 12, 41)]
    tile, edges = jaccard._Tile(), [(i, j) for i in range(41) for j in range(i) if parts[i] == parts[j]]
    want = list(edges)
    for i in range(20):
        tile.add(i, parts[i], sets[i])
    for i in range(20, 41):
        edges += [(i, j) for j in tile.ask(parts[i], sets[i], 75)]
        want += [(i, j) for j in range(20) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]

    def classes(pairs):
        top = list(range(41))
        for _ in top:
            for i, j in pairs:
                top[i] = top[j] = min(top[i], top[j])
        return top

    assert classes(edges) == classes(want) and len(set(classes(want))) > 1
    assert jaccard._Tile().ask(0, sets[0], 80) == []


# 10 quality

def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in found if r["quality"] == 1 and not r["base_failed"]]
    poor = [r["kept"] for r in found if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.97
    assert sum(poor) / len(poor) < 0.1


def test_quality_sketches_merge(spark):
    rows = [(i, f"{'word' * (1 + i % 3)} " * 25 + str(i), ["en", None][i % 2], f"s{i % 3}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality._metrics(quality.text_statistics(table, ["doc_id", "lang", "source"])).withColumn("base_failed", F.lit(False))
    counts = quality.sketches(stats)
    values = sorted(r["m_length"] for r in stats.filter("lang is null").collect())
    low, high = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
    got = quality.fences(counts, ["lang"]).filter("lang is null").first()
    spread = quality.FENCE * max(high - low, quality.SLACK["m_length"])
    assert (got["n_group"], got["f_m_length"]["low"], got["f_m_length"]["high"]) == (30, low - spread, high + spread)


# SQL and pipeline

def test_queries_and_sql_are_whole():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    import check_oracles

    status, n, _, note = check_oracles.compare(
        spark, check_oracles.duck(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert status == "ok" and n > 0, note


def test_pipeline_like_its_stages_by_brute_force(spark, documents):
    import corpus_pipeline

    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language.fit_languages(documents.filter(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    judge = language.Classifier(model)
    rows = [r for r in documents.collect() if not judge.predict(r["text"])[2]]
    parts = _components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r in rows if parts[r["doc_id"]][1] == r["doc_id"]]
    rows = [r for r in rows if not any(decontaminate.infix_distance(i, r["text"].lower().split()) <= len(i) // decontaminate.PER_ERROR for i in items)]
    kept = spark.createDataFrame(rows, documents.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(kept).collect()}
    library = Tokenizer.from_file(WORD_LEVEL)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        for _ in range(copies[r["doc_id"]]):
            want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == want
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["by_language", "one_of_a_kind", "uncontaminated", "mixed", "tokens"]


def test_stages_return_the_columns_of_documents(spark, documents):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert isinstance(out := stage(spark, documents, SF).schema, T.StructType) and out.names == documents.columns


@pytest.mark.parametrize("text", ["½", "² ³", "①", "12 _ -", "٣"])
def test_numbers_and_signs_are_no_letters(docs, text):
    assert not language.letters(text)
    assert language.letters(f"{text} é") == " é ".encode()


def test_one_of_a_kind_counts_rows(spark):
    """Null ids, repeated rows and repeated ids: one row of each class, that with the smallest id; extra columns stay."""
    import corpus_pipeline

    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, a), (3, a + " more"), (3, a), (3, a), (None, b), (None, b), (9, "only"), (9, "only"), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = corpus_pipeline.one_of_a_kind(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in kept if x[1] and x[1].startswith("w")] in ([(3, a)], [(3, a + " more")])
    assert sorted((x for x in kept if not (x[1] and x[1].startswith("w"))), key=str) == sorted([(None, b), (9, "only"), (4, None), (4, None), (None, "")], key=str)
    none = corpus_pipeline.one_of_a_kind(spark, docs.limit(0), "")
    assert none.collect() == [] and none.columns == docs.columns


def test_jaccard_of_documents_that_share_a_passage(spark):
    """Documents with one long passage in common meet in groups; only those that agree at large are linked."""
    import random

    from gleanery.llm import jaccard

    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(220):
        own = [f"o{i // 4 if i % 3 else i}x{j}" for j in range(30)]
        if i % 5 == 0:
            own[rng.randrange(30)] = "changed"
        rows.append((i, " ".join((own + passage) if i % 2 else (passage + own))))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()}
    sets = [{tuple(t.split()[j : j + 3]) for j in range(58)} for _, t in rows]
    lead = list(range(len(rows)))

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= 70 * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((root(x), root(y)))
                lead[q] = p
    assert got == {i: root(i) for i in range(len(rows))}


def test_jaccard_writes_little_of_texts_that_are_alone(spark, tmp_path, monkeypatch):
    """Tokens that lead in one document only are neither written nor given on."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 1_500)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string").repartition(1)
    monkeypatch.setattr("gleanery.session.scratch_root", lambda spark: str(tmp_path))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table, 5, 80).collect()}
    assert got == {i: i % 60 for i in range(61)}
    assert sum(x.stat().st_size for x in tmp_path.rglob("*.parquet")) < sum(map(len, texts)) / 4
    held = jaccard._leading_tokens(table, 5, 80).groupBy("token").agg(F.count_distinct("doc_id").alias("n")).agg(F.min("n"), F.count("*")).first()
    assert held[0] == 2 and held[1] > 100
