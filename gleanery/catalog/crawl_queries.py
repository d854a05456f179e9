"""Registered queries: robots, frontier and fetch-log analytics."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.functions import urls
from gleanery.operators import crawl_log, extract, frontier, robots

_RULES = """
r AS (SELECT c_custkey, 'h' || cast(c_custkey AS varchar) AS host, c_mktsegment = 'BUILDING' AS own,
      lower(substring(c_mktsegment, 1, 1)) AS letter, lower(c_mktsegment) AS segment,
      c_acctbal, c_nationkey FROM customer),
rules AS (SELECT host, CASE WHEN own THEN '/private /' || segment ELSE '/' || letter END AS disallows,
      CASE WHEN own THEN NULL WHEN c_acctbal > 0 THEN cast(c_nationkey * 60 AS double)
           WHEN c_acctbal > -500 THEN 90.0 END AS crawl_delay FROM r)"""


@query("parse_robots", f"WITH {_RULES} SELECT * FROM rules")
def _(view):
    rules = robots.parse_robots(view("v_robots"), "TestBot")
    return rules.select("host", F.array_join("disallows", " ").alias("disallows"), "crawl_delay")


@query("robots_allows", f"""
WITH {_RULES}, u AS (SELECT o_orderkey, 'h' || cast(o_custkey AS varchar) AS host,
    '/' || lower(substring(o_orderpriority, 3)) AS path FROM orders),
h AS (SELECT u.o_orderkey, bool_or(d <> '' AND starts_with(u.path, d)) AS blocked
      FROM u JOIN (SELECT host, unnest(string_split(disallows, ' ')) AS d FROM rules) x ON u.host = x.host GROUP BY 1)
SELECT u.o_orderkey, NOT coalesce(h.blocked, FALSE) AS allowed FROM u LEFT JOIN h ON u.o_orderkey = h.o_orderkey""")
def _(view):
    pages = view("orders").select(
        "o_orderkey", F.concat(F.lit("http://h"), F.col("o_custkey").cast("string"), F.lit("/"),
                               F.lower(F.substring("o_orderpriority", 3, 100)), F.lit("?q=1")).alias("url"))
    return robots.robots_allows(pages, robots.parse_robots(view("v_robots"), "TestBot")).select(
        "o_orderkey", "allowed")


@query("seed_frontier", "SELECT DISTINCT url, 0 AS depth, 0 AS retry_count FROM pages")
def _(view):
    return frontier.seed_frontier(view("pages"))


@query("within_depth", """
SELECT o_orderkey, order_index AS depth FROM (SELECT item_id AS o_orderkey, order_index FROM v_items) i
WHERE order_index <= 3""")
def _(view):
    items = view("v_items").select(F.col("item_id").alias("o_orderkey"), F.col("order_index").alias("depth"))
    return frontier.within_depth(items, 3)


@query("is_html_response", """
SELECT event_id FROM v_fetch_log WHERE status BETWEEN 200 AND 299 AND contains(content_type, 'text/html')""")
def _(view):
    return crawl_log.is_html_response(view("v_fetch_log")).select("event_id")


@query("classify_fetch_errors", """
SELECT event_id, CASE WHEN message = 'request timed out' THEN 'timeout' WHEN message LIKE 'dns%' THEN 'connect'
       WHEN message LIKE '%429%' THEN 'rate_limited' ELSE 'permanent' END AS error_class
FROM v_fetch_log WHERE NOT ok""")
def _(view):
    return crawl_log.classify_fetch_errors(view("v_fetch_log")).select("event_id", "error_class")


@query("retry_plan", """
WITH c AS (SELECT event_id, retry_count, CASE WHEN message = 'request timed out' THEN 2 WHEN message LIKE 'dns%' THEN 1
       WHEN message LIKE '%429%' THEN 2 ELSE 0 END AS max_retries FROM v_fetch_log WHERE NOT ok)
SELECT event_id, max_retries, cast(least(9000 * power(2, retry_count), 30000) AS bigint) AS delay_ms,
       retry_count < max_retries AS retry FROM c""")
def _(view):
    plan = crawl_log.retry_plan(view("v_fetch_log"), max_retries=2, base_ms=9000)
    return plan.select("event_id", "max_retries", "delay_ms", "retry")


@query("politeness_wait", f"""
WITH {_RULES}, p AS (SELECT f.event_id, f.host, f.ts, lag(f.ts) OVER (PARTITION BY f.host ORDER BY f.ts, f.event_id) AS prev
    FROM v_fetch_log f)
SELECT p.event_id, round(CASE WHEN prev IS NULL THEN 0 ELSE
    greatest(0, coalesce(r.crawl_delay, 30.0) - (epoch_us(ts) - epoch_us(prev)) / 1e6) END, 6) AS wait_seconds
FROM p LEFT JOIN rules r ON p.host = r.host""")
def _(view):
    rules = robots.parse_robots(view("v_robots"), "TestBot")
    out = crawl_log.politeness_wait(view("v_fetch_log"), rules, default_delay=30.0)
    return out.select("event_id", F.round("wait_seconds", 6).alias("wait_seconds"))


@query("crawl_schedule", r"""
SELECT item_id, 2e0 * (row_number() OVER (PARTITION BY regexp_extract(url, '^https://([^/?#]*)', 1) ORDER BY item_id) - 1)
       AS start_seconds FROM v_items""")
def _(view):
    items = view("v_items").select("item_id", "url", F.col("item_id").alias("seq"))
    return frontier.crawl_schedule(items, default_delay=2.0).select("item_id", "start_seconds")


@query("crawl_summary", """
SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_secs, count(*) FILTER (WHERE ok) AS pages_crawled,
       count(*) AS fetch_count, count(*) FILTER (WHERE NOT ok) AS fetch_errors,
       count(*) FILTER (WHERE retry_count > 0) AS retries,
       (SELECT count(DISTINCT url) FROM pages) AS urls_discovered, (SELECT count(*) FROM pages WHERE url LIKE 'http:%')
       AS robots_blocked
FROM v_fetch_log""")
def _(view):
    seen = view("pages").select("url", (~F.startswith("url", F.lit("http:"))).alias("allowed"))
    return crawl_log.crawl_summary(view("v_fetch_log"), seen)


@query("throughput", """
SELECT count(*) FILTER (WHERE ok) AS pages,
       round(count(*) FILTER (WHERE ok) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS pages_per_second
FROM v_fetch_log""")
def _(view):
    out = crawl_log.throughput(view("v_fetch_log"))
    return out.select("pages", F.round("pages_per_second", 9).alias("pages_per_second"))


@query("peak_concurrency", """
WITH s AS (SELECT epoch_us(ts) AS t, 1 AS delta FROM v_fetch_log
           UNION ALL SELECT epoch_us(ts) + cast(floor(seconds * 60 * 1e6) AS bigint), -1 FROM v_fetch_log),
lv AS (SELECT sum(delta) OVER (ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT cast(max(n) AS bigint) AS peak FROM lv""")
def _(view):
    log = view("v_fetch_log").withColumn("seconds", F.floor(F.col("seconds") * 60 * 1e6) / 1e6)
    return crawl_log.peak_concurrency(log)


@query("error_rate_windows", """
WITH w AS (SELECT time_bucket(interval '2 seconds', ts) AS b, count(*) FILTER (WHERE NOT ok) AS errors, count(*) AS fetches
           FROM v_fetch_log GROUP BY 1)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, errors, fetches, errors / fetches AS error_rate,
       CASE WHEN errors / fetches > 0.2 THEN 'back_off' WHEN errors / fetches < 0.05 THEN 'speed_up' ELSE 'hold' END AS signal
FROM w""")
def _(view):
    out = crawl_log.error_rate_windows(view("v_fetch_log"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("error_rate_days", """
WITH w AS (SELECT time_bucket(interval '1 day', ts) AS b, count(*) FILTER (WHERE NOT ok) AS errors, count(*) AS fetches
           FROM v_fetch_log GROUP BY 1)
SELECT strftime(b, '%Y-%m-%d') AS day, errors, fetches, errors / fetches AS error_rate,
       CASE WHEN errors / fetches > 0.2 THEN 'back_off' WHEN errors / fetches < 0.05 THEN 'speed_up' ELSE 'hold' END AS signal
FROM w""")
def _(view):
    out = crawl_log.error_rate_windows(view("v_fetch_log"), width="1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "errors", "fetches", "error_rate", "signal")


@query("fresh_links", """
SELECT dst AS url, min(CASE WHEN src LIKE 's%' THEN 2 ELSE 1 END) AS depth FROM v_edges
WHERE dst NOT IN (SELECT 'p' || cast(p_partkey AS varchar) FROM part WHERE p_size > 25) GROUP BY dst""")
def _(view):
    links = view("v_edges").select(
        F.col("dst").alias("url"), F.when(F.startswith("src", F.lit("s")), 2).otherwise(1).alias("depth"))
    visited = view("part").where("p_size > 25").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url"))
    return frontier.fresh_links(links, visited)


_BFS = """
WITH RECURSIVE walk AS (
  SELECT 'r' || cast(r_regionkey AS varchar) AS url, 0 AS depth FROM region
  UNION
  SELECT e.dst, w.depth + 1 FROM walk w JOIN v_edges e ON e.src = w.url WHERE w.depth < 4),
best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)"""


def _seeds(view):
    return view("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url"))


@query("expand_frontier", f"{_BFS} SELECT url, depth FROM best")
def _(view):
    return frontier.expand_frontier(view("v_edges"), _seeds(view), max_depth=4)


@query("expand_frontier_budget", f"""{_BFS}
SELECT url, depth FROM (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS n FROM best) b
WHERE n <= (SELECT count(*) FROM customer) + 500""")
def _(view):
    budget = view("customer").count() + 500
    return frontier.expand_frontier(view("v_edges"), _seeds(view), max_depth=4, max_pages=budget)


@query("max_pages_budget", """
SELECT url, depth FROM (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS n
  FROM (SELECT dst AS url, min(CASE WHEN src LIKE 'o%' THEN 2 ELSE 1 END) AS depth FROM v_edges GROUP BY dst) d) b
WHERE n <= (SELECT count(*) FROM orders)""")
def _(view):
    links = view("v_edges").groupBy(F.col("dst").alias("url")).agg(
        F.min(F.when(F.startswith("src", F.lit("o")), 2).otherwise(1)).alias("depth"))
    return frontier.max_pages_budget(links, view("orders").count())


@query("page_frontier", r"""
WITH e AS (SELECT url, unnest(regexp_extract_all(html, 'href="(/[^"#]*)', 1)) AS href FROM pages)
SELECT count(DISTINCT url) AS n_pages, count(DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href) AS n_links FROM e
WHERE NOT regexp_matches(lower(href), '\.(png|jpg|js|json|css|xml|pdf|zip|doc|gz)(\?|$)')""")
def _(view):
    edges = extract.link_edges(extract.extract_pages(view("pages")))
    return edges.agg(F.count_distinct("src_url").alias("n_pages"), F.count_distinct("dst_url").alias("n_links"))
