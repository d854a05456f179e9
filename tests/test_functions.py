"""Literal inputs and outputs of the column functions."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import media, text, urls, vectors


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {schema}")
            .withColumn("out", column).orderBy("i").select("out").collect()]


URL_CASES = [
    ("https://a.com/x", "https://b.com/", "https://a.com/x"),
    ("/root", "https://b.com/dir/page?q=1", "https://b.com/root"),
    ("page2", "https://b.com/dir/page", "https://b.com/dir/page2"),
    ("../up", "https://b.com/a/b/c", "https://b.com/a/up"),
    ("../../../x", "https://b.com/a/b", "https://b.com/x"),
    ("./here/./x", "https://b.com/a/b", "https://b.com/a/here/x"),
    ("..", "https://b.com/a/b/c", "https://b.com/a/"),
    ("#frag", "https://b.com/a?q=1#old", "https://b.com/a?q=1"),
    ("?p=2", "https://b.com/a?q=1", "https://b.com/a?p=2"),
    ("", "https://b.com/a?q=1", "https://b.com/a?q=1"),
    ("//cdn.b.com/x#y", "https://b.com/", "https://cdn.b.com/x"),
    ("HTTP://EXAMPLE.com", "https://b.com/", "http://example.com/"),
    ("https://b.com:443/x", "https://b.com/", "https://b.com/x"),
    ("http://b.com:80", "https://b.com/", "http://b.com/"),
    ("http://b.com:8080/x", "https://b.com/", "http://b.com:8080/x"),
    ("  /padded \n", "https://b.com/", "https://b.com/padded"),
    ("/für?ä=1 2", "https://b.com/", "https://b.com/f%C3%BCr?%C3%A4=1%202"),
    ("mailto:a@b.com", "https://b.com/", None),
    ("javascript:void(0)", "https://b.com/", None),
    ("ftp://b.com/x", "https://b.com/", None),
    ("/a?q=x/../y", "https://b.com/", "https://b.com/a?q=x/../y"),
]


def test_normalize_url(spark):
    got = values(spark, [c[:2] for c in URL_CASES], "href STRING, base STRING",
                 urls.normalize_url(F.col("href"), urls.base_parts(F.col("base"))))
    assert got == [c[2] for c in URL_CASES]


@pytest.mark.parametrize("link, base, want", [
    ("a.com", "a.com", True), ("x.a.com", "a.com", True), ("nota.com", "a.com", False), ("a.com", "x.a.com", False),
])
def test_same_site(spark, link, base, want):
    assert values(spark, [(link, base)], "a STRING, b STRING", urls.same_site(F.col("a"), F.col("b"))) == [want]


def test_crawlable_extension(spark):
    cases = {"https://a.com/x.PNG": False, "https://a.com/x.png?y=1": False, "https://a.com/x?y=.png": True,
             "https://a.com/x.html": True, "https://a.com/app.js": False, "https://a.com": True,
             "https://a.com/x.woff2": False, "https://a.com/xpng": True}
    assert values(spark, [(u,) for u in cases], "u STRING", urls.crawlable_extension(F.col("u"))) == list(cases.values())


def test_tokenize(spark):
    cases = [("The Quick-brown fox's 2nd!", ["the", "quick", "brown", "fox", "s", "2nd"]), ("", []), (None, None),
             ("x" * 400 + " ok " + "y" * 39, ["x" * 400, "ok", "y" * 39]), ("Été ß_x", ["été", "ß", "x"])]
    assert values(spark, [(c[0],) for c in cases], "t STRING", text.tokenize(F.col("t"))) == [c[1] for c in cases]
    assert values(spark, [("x" * 40 + " ok " + "y" * 39,)], "t STRING", text.tokenize(F.col("t"), max_bytes=40)) == [["ok", "y" * 39]]


def test_collapse_keep_newlines(spark):
    cases = [("  a   b ", "a b"), ("a \n\n  b", "a \nb"), ("a\t\tb\nc", "a b\nc"), ("a\n \n \nb", "a\nb")]
    assert values(spark, [(c[0],) for c in cases], "t STRING", text.collapse_keep_newlines(F.col("t"))) == [
        c[1] for c in cases]


def test_reading_time(spark):
    cases = [("", 60), ("w " * 200, 60), ("w " * 299, 60), ("w " * 301, 120), ("w " * 500, 120), ("w " * 700, 240)]
    assert values(spark, [(c[0],) for c in cases], "t STRING", text.reading_time_seconds(F.col("t"))) == [
        c[1] for c in cases]


def test_boilerplate_and_filler(spark):
    assert values(spark, [("Please ENABLE JavaScript",), ("x" * 300 + "enable javascript",), ("fine",)], "t STRING",
                  text.is_boilerplate(F.col("t"))) == [True, True, False]
    assert values(spark, [("x" * 300 + "enable javascript",)], "t STRING", text.is_boilerplate(F.col("t"), window=300)) == [False]
    assert values(spark, [("short",), ("A real summary of a page about tea.",), ("Sorry, I'm unable to do this at all.",)],
                  "t STRING", text.is_filler_response(F.col("t"))) == [True, False, True]


def test_media(spark):
    cases = [("https://a.com/x.JPG?w=1", "image", "https://a.com/x.JPG?w=1"), ("https://youtu.be/abc-1", "video", "abc-1"),
             ("https://www.youtube.com/watch?v=Zz_9", "video", "Zz_9"), ("https://www.youtube.com/shorts/q1", "video", "q1"),
             ("https://a.com/page", "article", None)]
    rows = [(c[0],) for c in cases]
    assert values(spark, rows, "u STRING", media.content_type(F.col("u"))) == [c[1] for c in cases]
    assert values(spark, rows, "u STRING", media.content_extra(F.col("u"))) == [c[2] for c in cases]


def test_durations(spark):
    cases = [("123", 123, None), ("123.9", 123, None), ("4:05", 245, None), ("1:02:03", 3723, None), ("live", None, "live"),
             ("1:2:3:4", None, "1:2:3:4"), ("a:b", None, "a:b"), ("", None, None), (None, None, None), (" 7 ", 7, None)]
    rows = [(c[0],) for c in cases]
    assert values(spark, rows, "d STRING", media.parse_duration(F.col("d"))) == [c[1] for c in cases]
    assert values(spark, rows, "d STRING", media.raw_duration(F.col("d"))) == [c[2] for c in cases]
    assert values(spark, [(0,), (-5,), (5,), (65,), (3725,)], "s INT", media.format_duration(F.col("s"))) == [
        None, None, "0:05", "1:05", "62:05"]


def test_natural_sort_key(spark):
    names = ["user10", "User9", "user 1", "b", "a20b3", "a20b12"]
    keys = values(spark, [(n,) for n in names], "n STRING", text.natural_sort_key(F.col("n")))
    assert [n for _, n in sorted(zip(keys, names))] == ["a20b3", "a20b12", "b", "user 1", "User9", "user10"]
    runs = ["a1234567890129", "a12345678901299", "a1234567890123", "a0007", "a6"]
    keys = values(spark, [(n,) for n in runs], "n STRING", text.natural_sort_key(F.col("n")))
    assert [n for _, n in sorted(zip(keys, runs))] == ["a6", "a0007", "a1234567890123", "a1234567890129", "a12345678901299"]


def test_cosine(spark):
    got = values(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0])],
                 "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", F.round(vectors.cosine(F.col("a"), F.col("b")), 6))
    assert got == [1.0, -1.0, None]
