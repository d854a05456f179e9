"""Page extraction, robots and retry rules on hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import crawl_log, dom, extract, frontier, robots

SITE = """<html><head><title> Home &amp; more </title><meta name="description" content=" A small site. ">
<style>p{x}</style><script>if (a<b) { x = "</p>"; }</script></head>
<body><nav><a href="/nav">Menu</a></nav><h1>Hello</h1><p>First <b>bold</b>word</p><p>Second</p>
<a href="/about#team">About</a><a href='https://other.org/x'>Out</a><a href="/pic.png">Pic</a>
<a href="mailto:x@y.z">Mail</a><a href="https://sub.site.com/p">Sub</a><footer>Foot</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "https://site.com/index", SITE)], "page_id BIGINT, url STRING, html STRING")


def test_light(page):
    row = extract.extract_pages(page).first()
    assert row.title == "Home &amp; more"
    assert row.description is None
    assert row.content.startswith("Home &amp; more Menu Hello First boldword Second")
    assert "x =" not in row.content and "p{x}" not in row.content
    assert row.outgoing_links == ["https://site.com/about", "https://site.com/nav", "https://sub.site.com/p"]


def test_light_external(page):
    row = extract.extract_pages(page, allow_external=True).first()
    assert "https://other.org/x" in row.outgoing_links and len(row.outgoing_links) == 4


def test_dom(page):
    row = extract.extract_pages(page, lightweight=False).first()
    assert row.title == "Home & more"
    assert row.description == "A small site."
    assert row.content == "Hello\nFirst bold word\nSecond\nAbout Out Pic Mail Sub"
    assert row.outgoing_links == ["https://site.com/about", "https://site.com/nav", "https://sub.site.com/p"]


@pytest.mark.parametrize("html, glued, spaced", [
    ("<p>a</p><p>b</p>", "ab", "a b"), ("a\n\n  b", "a b", "a b"), ("<SCRIPT>x</SCRIPT>y", "y", "y"),
    ("<script>never closed", "", ""), ("<scripty>kept</scripty>", "kept", "kept"), ("tail <b", "tail", "tail"),
    ("<style media=x>q</style>ok", "ok", "ok"),
])
def test_strip_html(spark, html, glued, spaced):
    df = spark.createDataFrame([(html,)], "html STRING")
    row = df.select(extract.strip_html(F.col("html"), glue=True), extract.strip_html(F.col("html"))).first()
    assert tuple(row) == (glued, spaced)


def test_strip_html_is_whole_without_a_limit(spark):
    page = spark.createDataFrame([("<p>" + "é " * 200_000 + "last</p>",)], "html STRING")
    whole, cut = page.select(extract.strip_html(F.col("html")), extract.strip_html(F.col("html"), max_chars=4)).first()
    assert whole.endswith("é last") and len(whole) == 400_004 and cut == "é é"


@pytest.mark.parametrize("html, want", [
    ("""<meta name="description" content="it's > fine">""", "it's > fine"),
    ("""<META content='say "hi"' property='og:description'/>""", 'say "hi"'),
    ("""<meta name="description" content=""><meta charset="x" content="two" lang="en" name='Description'>""", "two"),
    ("""<meta name="keywords" content="no"><p content="no">""", None),
])
def test_meta_description_by_attributes(spark, html, want):
    assert spark.createDataFrame([(html,)], "html STRING").select(extract.meta_description(F.col("html"))).first()[0] == want


@pytest.mark.parametrize("html, want", [
    ("<TITLE>Hi</TITLE>", "Hi"), ("<title>  </title>", None), ("<title>open", None), ("no title", None),
    ("<title lang=en>A\nB</title><title>2</title>", "A\nB"),
])
def test_title_light(spark, html, want):
    assert spark.createDataFrame([(html,)], "html STRING").select(extract.title_light(F.col("html"))).first()[0] == want


def test_reader_text():
    html = ("<title>T</title><body><nav>skip</nav><h1>Head</h1><p>One <i>two</i></p><ul><li>a</li><li>b</li></ul>"
            "<script>x</script>tail</body>")
    assert dom.reader_text(html) == "T\n\nHead\n\nOne two\n\na\n\nb\n\ntail"


def test_reader_text_counts_hidden_elements():
    html = "<!DOCTYPE html><p>a &amp; b</p><footer><nav>x</nav>no</footer></nav><div>c</div><!-- <p>no --><noscript>no"
    assert dom.reader_text(html) == "a & b\n\nc"


@pytest.mark.parametrize("html, want", [
    ("<main>in<header>no</header></main><p>out</p>", "in\nout"), ("<html><p>Hello</p>", "Hello"),
    ("<article><p>a</p></article><p>rest</p>", "a\nrest"), ("<title>T</title><body><p>x</p><main>y</main></body>", "x\ny"),
])
def test_dom_has_a_body_in_any_case(html, want):
    assert dom.parse_document(html)[2].strip() == want


ROBOTS = [
    ("User-agent: *\nDisallow: /a\nDisallow:\nCrawl-delay: 2", (["/a"], 2.0)),
    ("User-agent: TestBot\nDisallow: /t\nUser-agent: *\nDisallow: /s", (["/t"], None)),
    ("User-agent: testbot\nCrawl-delay: -1\nCrawl-delay: x\nCrawl-delay: 1.5\nCrawl-delay: 9", ([], 1.5)),
    ("User-agent: TestBot\nUser-agent: Other\nDisallow: /x", ([], None)),
    ("User-agent: Other\nUser-agent: TestBot\nDisallow: /x", (["/x"], None)),
    ("Disallow: /before\n# note\nuser-AGENT :  *  \n DISALLOW : /p \nAllow: /q", (["/p"], None)),
    ("", ([], None)),
    ("User-agent: Other\nDisallow: /", ([], None)),
    ("User-agent: *\r\nDisallow: /crlf\r\n", (["/crlf"], None)),
]


def test_parse_robots(spark):
    df = spark.createDataFrame([(f"h{i}", c) for i, (c, _) in enumerate(ROBOTS)], "host STRING, content STRING")
    got = {r.host: (r.disallows, r.crawl_delay) for r in robots.parse_robots(df, "TestBot").collect()}
    assert [got[f"h{i}"] for i in range(len(ROBOTS))] == [want for _, want in ROBOTS]


def test_robots_allows(spark):
    rules = spark.createDataFrame([("a.com", ["/x", ""], None)], "host STRING, disallows ARRAY<STRING>, crawl_delay DOUBLE")
    pages = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/y",), ("https://b.com/x",)], "url STRING")
    got = {r.url: r.allowed for r in robots.robots_allows(pages, rules).collect()}
    assert got == {"https://a.com/x/1": False, "https://a.com/y": True, "https://b.com/x": True}


@pytest.mark.parametrize("message, want", [
    ("operation Timed Out", "timeout"), ("connection refused", "connect"), ("DNS error", "connect"),
    ("HTTP status 429", "rate_limited"), ("503 unavailable", "rate_limited"), ("Retry After 5", "rate_limited"),
    ("HTTP status 500", "permanent"), ("connect timeout", "timeout"), ("gone", "permanent"),
])
def test_error_class(spark, message, want):
    assert spark.createDataFrame([(message,)], "m STRING").select(crawl_log.error_class(F.col("m"))).first()[0] == want


def test_retry_plan(spark):
    rows = [(i, "h", None, False, "timeout", n) for i, n in enumerate([0, 1, 3, 10])]
    df = spark.createDataFrame(rows, "event_id BIGINT, host STRING, ts TIMESTAMP, ok BOOLEAN, message STRING, retry_count INT")
    got = [(r.delay_ms, r.retry) for r in crawl_log.retry_plan(df, 3, 500).orderBy("event_id").collect()]
    assert got == [(500, True), (1000, True), (4000, False), (30000, False)]


def test_frontier_depth_budget_and_admit(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("a",), ("a",)], "url STRING")

    def run(**kw):
        return {r.url: r.depth for r in frontier.expand_frontier(edges, seeds, **kw).collect()}

    assert run(max_depth=5) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert run(max_depth=1) == {"a": 0, "b": 1, "c": 1}
    assert run(max_depth=5, max_pages=2) == {"a": 0, "b": 1}
    assert run(max_depth=5, admit=lambda level: level.where("url <> 'd'")) == {"a": 0, "b": 1, "c": 1}


def test_pages_go_to_python_in_batches_bounded_by_bytes(spark):
    """Whole pages, whatever their size, with no more than a few MB of them in a Python worker at a time."""
    from gleanery.operators.dom import readable_article
    from gleanery.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, "64m")
    spark.conf.set(key, "64m")
    try:
        pages = spark.range(4).selectExpr("id", "concat('<p>', repeat('word ', 100000), id, '</p>') AS html")
        got = {r["id"]: r["content"] for r in readable_article(pages).select("id", "content").collect()}
        assert spark.conf.get(key) == f"{BATCH_BYTES}b"
        assert got == {i: "word " * 100000 + str(i) for i in range(4)}
    finally:
        spark.conf.set(key, before)
