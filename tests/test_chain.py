"""The whole way of a crawl over pages of which some share their URL."""

import duckdb

from gleanery.catalog import registry


def test_pages_of_one_url_are_pages_of_their_own(spark, tmp_path):
    words = ["green tea", "black tea", "cold milk", "green leaf", "tea milk", "cold leaf"]
    rows = [(i, f"https://a.example/{i % 4}", f"<html><head><title>{w}</title></head><body><p>{w} and {words[i - 1]} {i}</p></body></html>") for i, w in enumerate(words)]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    queries, oracles = registry.load()
    got = queries["crawl_to_search"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(oracles["crawl_to_search"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert want and sorted(map(tuple, got.select(*names).collect())) == want
