"""Inputs for the registered queries, derived from the driver tables.

Each view is one SQL text in the dialect Spark and DuckDB share, so both sides of a
correctness check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}

VIEWS = {
    # A text corpus: documents as crawled pages.
    "v_corpus": """
        SELECT doc_id, 'https://corpus.example/' || source || '/' || cast(doc_id AS string) AS url,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN lang = 'en' THEN NULL ELSE lang || ' ' || source END AS description,
               text AS content
        FROM documents""",
    "v_queries": "SELECT item_id AS query_id, text AS q FROM benchmark",
    # The crawled-page table; a page counts as indexed when it carries a label.
    "v_crawled": """
        SELECT c.doc_id AS id, c.url, c.title, c.description, c.content,
               timestamp '2024-01-01 00:00:00' + cast(length(c.content) AS int) * interval '1' second AS crawled_at,
               l.doc_id IS NOT NULL AS indexed
        FROM v_corpus c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON c.doc_id = l.doc_id""",
    "v_page_embeddings": """
        SELECT vec_id AS page_id, CASE WHEN label < 8 THEN 0 ELSE 1 END AS chunk_index, embedding
        FROM embeddings""",
    "v_vectors": """
        SELECT e.vec_id AS page_id, 0 AS chunk_index, e.embedding, e.label,
               'https://corpus.example/v/' || cast(e.vec_id AS string) AS url
        FROM embeddings e""",
    # A batch of changes: every labelled page again (twice, with different text) plus new pages.
    "v_page_batch": """
        SELECT seq, url, title, description, content, crawled_at, indexed FROM (
          SELECT c.id * 2 AS seq, c.url, 'v2 ' || c.title AS title, c.description,
                 'changed ' || c.content AS content, c.crawled_at, FALSE AS indexed
          FROM v_crawled c WHERE c.indexed
          UNION ALL
          SELECT c.id * 2 + 1, c.url, 'v3 ' || c.title, c.description, 'later ' || c.content, c.crawled_at, FALSE
          FROM v_crawled c WHERE c.indexed
          UNION ALL
          SELECT p.page_id + 10000000, p.url, p.url, NULL, p.html, timestamp '2024-02-01 00:00:00', FALSE
          FROM pages p) b""",
    "v_activity": """
        SELECT event_id AS id, cast(user_id AS string) AS session_id, event_type AS action_type,
               props AS details, ts AS created_at
        FROM events""",
    "v_fetch_log": """
        SELECT event_id, 'h' || cast(user_id AS string) AS host, ts, event_type <> 'error' AS ok,
               CASE WHEN event_type <> 'error' THEN NULL
                    WHEN k < 20 THEN 'request timed out'
                    WHEN k < 40 THEN 'dns lookup failed for host'
                    WHEN k < 55 THEN 'HTTP 429 Too Many Requests'
                    WHEN k < 80 THEN 'HTTP 500 Internal Server Error'
                    ELSE 'malformed url' END AS message,
               CASE WHEN value < 5 THEN 0 WHEN value < 15 THEN 1 WHEN value < 25 THEN 2 ELSE 3 END AS retry_count,
               CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 301 ELSE 200 END AS status,
               CASE WHEN event_type = 'purchase' THEN 'application/json'
                    WHEN event_type = 'view' THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type,
               value AS seconds
        FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events) e""",
    "v_robots": """
        SELECT 'h' || cast(c_custkey AS string) AS host,
               '# rules of ' || c_name || chr(10) || 'User-agent: *' || chr(10) ||
               'Disallow: /' || lower(substring(c_mktsegment, 1, 1)) || chr(10) || 'Disallow:' || chr(10) ||
               CASE WHEN c_acctbal > 0 THEN 'Crawl-delay: ' || cast(c_nationkey * 60 AS string)
                    WHEN c_acctbal > -500 THEN 'crawl-delay: -3' || chr(10) || 'Crawl-Delay: 90'
                    ELSE '# none' END || chr(10) || 'Allow: /' || chr(10) || 'no colon here' || chr(10) ||
               'User-Agent: ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'TestBot' ELSE 'OtherBot' END || chr(10) ||
               'Disallow: /private' || chr(10) || '  DISALLOW : /' || lower(c_mktsegment) || '  ' || chr(10) ||
               'User-agent: a' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /late' AS content
        FROM customer""",
    # Workspaces: customers own them, orders are the items saved in them.
    "v_workspaces": """
        SELECT c_custkey AS workspace_id, cast(c_nationkey AS string) AS session_id, c_name AS name,
               timestamp '2023-01-01 00:00:00' + c_nationkey * interval '1' day AS created_at,
               timestamp '2024-01-01 00:00:00' + cast(abs(c_acctbal) AS int) * interval '1' minute AS updated_at
        FROM customer""",
    "v_items": """
        SELECT o_orderkey AS item_id, o_custkey AS workspace_id,
               'https://' || CASE WHEN o_orderstatus = 'F' THEN 'www.' ELSE '' END ||
                 replace(lower(substring(o_orderpriority, 3)), ' ', '-') || '.example.org/item/' ||
                 cast(o_orderkey AS string) ||
                 CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN '.PNG?w=1' ELSE '' END AS url,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Item ' || cast(o_orderkey AS string) END AS title,
               CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority || ' order' END AS snippet,
               CASE WHEN o_totalprice > 300000 THEN 'https://img.example/' || cast(o_orderkey AS string) || '.png'
                    END AS media_url,
               cast(substring(o_orderpriority, 1, 1) AS int) AS order_index,
               o_orderdate AS created_at
        FROM orders""",
    "v_notes": """
        SELECT doc_id AS note_id, cast(substring(source, 4) AS bigint) AS workspace_id,
               split_part(text, chr(10), 1) AS title, text AS content
        FROM documents""",
    "v_images": """
        SELECT p_partkey AS image_id, cast(p_size AS bigint) AS workspace_id, p_name AS caption,
               p_brand AS brand, 'https://img.example/p/' || cast(p_partkey AS string) || '.png' AS url
        FROM part""",
    "v_videos": """
        SELECT s_suppkey AS video_id, cast(s_nationkey AS bigint) AS workspace_id, s_name AS title,
               'https://youtu.be/v' || cast(s_suppkey AS string) AS url
        FROM supplier""",
    "v_taggings": """
        SELECT quality * 2 + toxic AS tag_id,
               CASE WHEN toxic = 1 THEN 'note' ELSE 'item' END AS taggable_type, doc_id AS taggable_id
        FROM labels""",
    "v_chat": """
        SELECT conv_id AS workspace_id, conv_id * 1000 + turn AS message_id, turn, role, text AS content,
               CASE WHEN role = 'assistant'
                    THEN '[{"url":"https://c.example/' || cast(conv_id AS string) || '","title":"T' ||
                         cast(turn AS string) || '"}]'
                    WHEN turn > 3 THEN '{broken' END AS sources_json
        FROM conversations""",
    "v_read_events": """
        SELECT event_id, cast(user_id AS string) AS session_id,
               'https://r.example/' || regexp_extract(props, '[0-9]+', 0) AS url,
               CASE WHEN event_type = 'click' THEN 'T' || cast(event_id AS string) END AS title,
               CASE WHEN event_type = 'view' THEN 'article' END AS source,
               CASE WHEN value < 50 THEN NULL ELSE user_id END AS workspace_id, ts
        FROM events""",
    "v_read_status": """
        SELECT user_id AS read_id, ts, event_id,
               CASE event_type WHEN 'view' THEN 'reading' WHEN 'purchase' THEN 'completed' ELSE 'unread' END AS status
        FROM events""",
    "v_bulk_requests": """
        SELECT o_custkey AS workspace_id, o_orderkey AS seq, '  HTTPS://R.example/' ||
               o_orderpriority AS url FROM orders
        UNION ALL
        SELECT l_suppkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey,
               'https://r.example/part/' || cast(l_partkey AS string) FROM lineitem""",
    "v_bulk_existing": """
        SELECT c_custkey AS workspace_id, 'https://R.EXAMPLE/1-URGENT' AS url FROM customer WHERE c_acctbal > 2000
        UNION ALL
        SELECT l_suppkey, 'https://r.example/part/' || cast(l_partkey AS string) FROM lineitem
        WHERE l_quantity > 49""",
    # Link graph with layers and cycles: region > nation > customer > order > part, supplier > nation.
    "v_edges": """
        SELECT DISTINCT src, dst FROM (
          SELECT 'r' || cast(n_regionkey AS string) AS src, 'n' || cast(n_nationkey AS string) AS dst FROM nation
          UNION ALL SELECT 'n' || cast(c_nationkey AS string), 'c' || cast(c_custkey AS string) FROM customer
          UNION ALL SELECT 'c' || cast(o_custkey AS string), 'o' || cast(o_orderkey AS string) FROM orders
          UNION ALL SELECT 'o' || cast(l_orderkey AS string), 'p' || cast(l_partkey AS string) FROM lineitem
          UNION ALL SELECT 'o' || cast(l_orderkey AS string), 's' || cast(l_suppkey AS string) FROM lineitem
          UNION ALL SELECT 's' || cast(s_suppkey AS string), 'n' || cast(s_nationkey AS string) FROM supplier) e""",
    # Search results of two kinds for merge and facet operators: position by key, hosts from the pages.
    "v_results": """
        SELECT query_id, pos, url, title, snippet, category, img_src, thumbnail FROM (
          SELECT l_suppkey AS query_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos,
                 CASE WHEN l_returnflag = 'A' THEN 'https://en.wikipedia.org/wiki/P'
                      WHEN l_returnflag = 'R' THEN 'https://www.reddit.com/r/P'
                      WHEN l_shipmonth < 4 THEN 'https://data.census.gov/P'
                      WHEN l_shipmonth < 8 THEN 'https://forum.example.com/p'
                      ELSE 'https://shop.example.com/P' END || cast(l_partkey AS string) AS url,
                 'Part ' || cast(l_partkey AS string) AS title,
                 CASE WHEN l_linenumber = 1 THEN 'Official Website of part'
                      WHEN l_linenumber = 2 THEN 'A study shows parts' ELSE NULL END AS snippet,
                 CASE WHEN l_linestatus = 'F' THEN 'science' WHEN l_discount > 0.08 THEN 'QA boards'
                      WHEN l_discount > 0.06 THEN 'images' WHEN l_discount > 0.04 THEN 'videos'
                      WHEN l_discount > 0.02 THEN 'news' END AS category,
                 CASE WHEN l_tax > 0.04 THEN 'https://img.example/' || cast(l_partkey AS string) END AS img_src,
                 CASE WHEN l_tax < 0.02 THEN 'https://th.example/' || cast(l_partkey AS string) END AS thumbnail
          FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) l) r""",
}


def _needs(text: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", text)]


def _ordered(names: list[str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _needs(VIEWS[name]):
            visit(other)
        done.append(name)

    for name in names:
        visit(name)
    return done


def _ctes(text: str) -> str:
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ordered(_needs(text)))


def oracle(text: str) -> str:
    """Oracle SQL with the views it mentions put in front as CTEs."""
    text = text.strip()
    ctes = _ctes(text)
    if not ctes:
        return text
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return f"{head}{ctes},\n{text[len(head):]}"
    return f"WITH {ctes}\n{text}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame."""
    if name in BASE_SCHEMAS:
        return table(spark, sf_dir, name)
    text = f"SELECT * FROM {name}"
    ctes = _ctes(text)
    for base in BASE_SCHEMAS:
        if re.search(rf"\b{base}\b", ctes):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(f"WITH {ctes} {text}")
