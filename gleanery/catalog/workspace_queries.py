"""Registered queries: workspaces, station objects, canvas and ordering."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.operators import canvas, workspace as ws
from gleanery.operators.bm25 import top_k


@query("require_workspace", """
SELECT item_id, workspace_id FROM v_items WHERE workspace_id IN
  (SELECT workspace_id FROM v_workspaces WHERE session_id IN (SELECT cast(n_nationkey AS varchar) FROM nation WHERE n_regionkey = 1))""")
def _(view):
    sessions = view("nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("session_id"))
    return ws.require_workspace(view("v_items"), view("v_workspaces"), sessions).select("item_id", "workspace_id")


@query("workspace_search", """
SELECT workspace_id, 'item' AS object_type, item_id AS object_id, coalesce(title, '') AS title, snippet, url FROM v_items
WHERE contains(lower(title), 'gent') OR contains(lower(snippet), 'gent')
UNION ALL
SELECT workspace_id, 'note', note_id, title, content, NULL FROM v_notes
WHERE contains(lower(title), 'gent') OR contains(lower(content), 'gent')""")
def _(view):
    return ws.workspace_search(view("v_items"), view("v_notes"), "GENT")


_ALL = """
src AS (SELECT item_id AS object_id, 'page' AS source_type, workspace_id, title, snippet, cast(NULL AS varchar) AS caption, url FROM v_items
  UNION ALL SELECT image_id, 'image', workspace_id, NULL, NULL, caption, url FROM v_images
  UNION ALL SELECT video_id, 'video', workspace_id, title, NULL, NULL, url FROM v_videos)"""


def _sources(view):
    return ws.all_sources(view("v_items"), view("v_images"), view("v_videos"))


_SRC_COLS = ["object_id", "source_type", "workspace_id", "title", "snippet", "caption", "url"]


@query("all_sources", f"WITH {_ALL} SELECT * FROM src")
def _(view):
    return _sources(view).select(_SRC_COLS)


@query("station_filter", f"""
WITH {_ALL} SELECT * FROM src WHERE contains(lower(title), '#00000001') OR contains(lower(coalesce(snippet, caption)), 'ed')""")
def _(view):
    merged = ws.station_filter(_sources(view), "ED").select(_SRC_COLS)
    named = ws.station_filter(_sources(view), "#00000001").select(_SRC_COLS)
    return merged.unionByName(named).distinct()


@query("tagged_objects", """
SELECT tag_id, item_id, coalesce(title, '') AS title, snippet, url FROM v_taggings t JOIN v_items i ON t.taggable_id = i.item_id
WHERE taggable_type = 'item'""")
def _(view):
    return ws.tagged_objects(view("v_taggings"), view("v_items"))


@query("unique_tagging", "SELECT DISTINCT tag_id, taggable_type, taggable_id FROM v_taggings")
def _(view):
    return ws.unique_tagging(view("v_taggings").unionByName(view("v_taggings")))


@query("workspace_item_counts", """
SELECT w.workspace_id, count(i.item_id) AS item_count FROM v_workspaces w LEFT JOIN v_items i
ON w.workspace_id = i.workspace_id GROUP BY 1""")
def _(view):
    return ws.workspace_item_counts(view("v_workspaces"), view("v_items")).select("workspace_id", "item_count")


def _parts(view):
    def by(table, key):
        return view(table).select(F.col(key).cast("long").alias("workspace_id"))

    return {
        "sources": by("v_items", "workspace_id"), "reads": by("events", "user_id"), "summaries": by("pages", "page_id"),
        "notes": by("v_notes", "workspace_id"), "pins": by("lineitem", "l_suppkey"), "images": by("v_images", "workspace_id"),
        "videos": by("v_videos", "workspace_id"), "comparisons": by("benchmark", "item_id"),
        "highlights": by("conversations", "conv_id"), "tags": by("labels", "doc_id"),
    }


_PARTS = {
    "sources": ("v_items", "workspace_id"), "reads": ("events", "user_id"), "summaries": ("pages", "page_id"),
    "notes": ("v_notes", "workspace_id"), "pins": ("lineitem", "l_suppkey"), "images": ("v_images", "workspace_id"),
    "videos": ("v_videos", "workspace_id"), "comparisons": ("benchmark", "item_id"),
    "highlights": ("conversations", "conv_id"), "tags": ("labels", "doc_id"),
}
_STATS = "SELECT w.workspace_id, " + ", ".join(f"coalesce({p}.n, 0) AS {p}" for p in _PARTS) + " FROM v_workspaces w " + \
    " ".join(f"LEFT JOIN (SELECT {key} AS k, count(*) AS n FROM {t} GROUP BY 1) {p} ON {p}.k = w.workspace_id"
             for p, (t, key) in _PARTS.items())


@query("station_stats", _STATS)
def _(view):
    return ws.station_stats(view("v_workspaces"), _parts(view))


@query("load_all", "SELECT part, sum(n) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS part, count(*) AS n FROM {t} WHERE {key} IN (SELECT workspace_id FROM v_workspaces)"
    for p, (t, key) in _PARTS.items()) + " UNION ALL SELECT 'stats', count(*) FROM v_workspaces) u GROUP BY part")
def _(view):
    out = None
    for name, df in ws.load_all(_parts(view), view("v_workspaces")).items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("domain_pills", r"""
WITH h AS (SELECT workspace_id, regexp_replace(regexp_extract(url, '^https://([^/]*)', 1), '^www\.', '') AS host,
           min(item_id) AS first_at FROM v_items GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY first_at) AS n, count(*) OVER (PARTITION BY workspace_id) AS c FROM h)
SELECT workspace_id, string_agg(host, ' ' ORDER BY first_at) AS domains, greatest(max(c) - 4, 0) AS overflow
FROM r WHERE n <= 4 GROUP BY workspace_id""")
def _(view):
    return ws.domain_pills(view("v_items")).withColumn("domains", F.array_join("domains", " "))


_NODES = """
nodes AS (SELECT l_orderkey * 10 + l_linenumber AS node_id, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'R' THEN 'image' ELSE 'video' END
          AS object_type, CASE l_returnflag WHEN 'A' THEN l_orderkey WHEN 'R' THEN l_partkey ELSE l_suppkey END AS object_id FROM lineitem),
edges AS (SELECT l_orderkey * 10 + l_linenumber AS source_node_id,
          l_orderkey * 10 + cast(floor(l_quantity / 7) AS int) AS target_node_id FROM lineitem)"""


def _nodes(view):
    flag = F.col("l_returnflag")
    return view("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node_id"),
        F.when(flag == "A", "source").when(flag == "R", "image").otherwise("video").alias("object_type"),
        F.when(flag == "A", F.col("l_orderkey")).when(flag == "R", F.col("l_partkey")).otherwise(F.col("l_suppkey"))
        .alias("object_id"))


def _edges(view):
    return view("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_node_id"),
        (F.col("l_orderkey") * 10 + F.floor(F.col("l_quantity") / 7)).alias("target_node_id"))


def _objects(view):
    return canvas.typed_objects({
        "source": view("v_items").withColumnRenamed("item_id", "object_id"),
        "note": view("v_notes").withColumnRenamed("note_id", "object_id"),
        "image": view("v_images").withColumnRenamed("image_id", "object_id"),
        "video": view("v_videos").withColumnRenamed("video_id", "object_id"),
    })


_OBJECTS = r"""
objects AS (SELECT 'source' AS object_type, item_id AS object_id, coalesce(title, regexp_extract(url, '^https://([^/]*)', 1)) AS label FROM v_items
  UNION ALL SELECT 'note', note_id, coalesce(nullif(title, ''), 'Untitled') FROM v_notes
  UNION ALL SELECT 'image', image_id, caption FROM v_images UNION ALL SELECT 'video', video_id, title FROM v_videos)"""


@query("nodes_by_type", f"WITH {_NODES} SELECT object_type, count(*) AS n FROM nodes GROUP BY 1")
def _(view):
    return ws.nodes_by_type(_nodes(view))


@query("unplaced_objects", f"""
WITH {_NODES}, {_OBJECTS} SELECT object_type, object_id, label FROM objects o
WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.object_type = o.object_type AND n.object_id = o.object_id)""")
def _(view):
    return canvas.unplaced_objects(_objects(view), _nodes(view)).select("object_type", "object_id", "label")


@query("resolve_canvas_objects", f"""
WITH {_NODES}, {_OBJECTS} SELECT n.node_id, n.object_type, n.object_id, o.label FROM nodes n
LEFT JOIN objects o ON n.object_type = o.object_type AND n.object_id = o.object_id""")
def _(view):
    return canvas.resolve_canvas_objects(_nodes(view), _objects(view)).select("node_id", "object_type", "object_id", "label")


@query("edge_endpoints", f"""
WITH {_NODES} SELECT source_node_id, target_node_id FROM edges WHERE source_node_id <> target_node_id
AND source_node_id IN (SELECT node_id FROM nodes) AND target_node_id IN (SELECT node_id FROM nodes)""")
def _(view):
    return canvas.edge_endpoints(_edges(view), _nodes(view))


@query("delete_nodes", f"""
WITH {_NODES}, gone AS (SELECT node_id FROM nodes WHERE object_type = 'image')
SELECT source_node_id, target_node_id FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM gone)
AND target_node_id NOT IN (SELECT node_id FROM gone)""")
def _(view):
    return ws.delete_nodes(_edges(view), _nodes(view).where("object_type = 'image'"))


@query("cascade_delete", """
SELECT item_id FROM v_items WHERE workspace_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)""")
def _(view):
    gone = view("customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("workspace_id"))
    return ws.cascade_delete(view("v_items"), gone, "workspace_id").select("item_id")


@query("set_null_on_delete", """
SELECT item_id, CASE WHEN workspace_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000) THEN NULL ELSE workspace_id END
AS workspace_id FROM v_items""")
def _(view):
    gone = view("customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("workspace_id"))
    return ws.set_null_on_delete(view("v_items"), gone, "workspace_id").select("item_id", "workspace_id")


@query("partial_update", """
SELECT i.item_id, coalesce(CASE WHEN o_totalprice > 100000 THEN 'new ' || o_orderpriority END, i.title) AS title,
       coalesce(CASE WHEN o_orderstatus = 'F' THEN 'patched' END, i.snippet) AS snippet
FROM v_items i LEFT JOIN (SELECT * FROM orders WHERE o_custkey < 1000000 AND o_orderstatus <> 'O') o ON i.item_id = o.o_orderkey""")
def _(view):
    patch = view("orders").where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("new "), "o_orderpriority")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.lit("patched")).alias("snippet"))
    return ws.partial_update(view("v_items"), patch, "item_id").select("item_id", "title", "snippet")


_GROUPS = """
g AS (SELECT event_id, r.workspace_id, CASE WHEN r.workspace_id IS NULL THEN 'noWorkspace' ELSE w.name END AS group_name
      FROM v_read_events r LEFT JOIN (SELECT * FROM v_workspaces WHERE session_id <> '7') w ON r.workspace_id = w.workspace_id
      WHERE r.workspace_id IS NULL OR w.workspace_id IS NOT NULL)"""


@query("group_by_workspace", f"WITH {_GROUPS} SELECT event_id, workspace_id, group_name FROM g")
def _(view):
    grouped = ws.group_by_workspace(view("v_read_events"), view("v_workspaces").where("session_id <> '7'"))
    return grouped.select("event_id", "workspace_id", "group_name")


@query("group_sizes", f"WITH {_GROUPS} SELECT workspace_id, group_name, count(*) AS n FROM g GROUP BY ALL")
def _(view):
    return ws.group_sizes(ws.group_by_workspace(view("v_read_events"), view("v_workspaces").where("session_id <> '7'")))


@query("pin_order", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS order_index
FROM lineitem""")
def _(view):
    pins = view("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("workspace_id"),
                                   ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))
    return ws.pin_order(pins, "seq").select("l_orderkey", "l_linenumber", "order_index")


@query("reorder", """
WITH p AS (SELECT o_custkey AS workspace_id, o_orderkey AS pin_id,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS order_index,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS recent FROM orders)
SELECT workspace_id, pin_id, CASE WHEN recent <= 3 THEN recent ELSE order_index END AS order_index FROM p""")
def _(view):
    orders = view("orders").select(
        F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("pin_id"), "o_orderdate")
    pins = ws.pin_order(orders, "pin_id")
    newest = top_k(orders, 3, key="workspace_id", score="o_orderdate", tie="pin_id")
    listed = newest.groupBy("workspace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "pin_id"))), lambda s: s["pin_id"]).alias("pin_ids"))
    return ws.reorder(pins, listed).select("workspace_id", "pin_id", "order_index")


_BULK = """
ex AS (SELECT workspace_id, lower(trim(url)) AS n FROM v_bulk_existing),
cnt AS (SELECT workspace_id, count(*) AS c FROM ex GROUP BY 1),
rq AS (SELECT workspace_id, seq, lower(trim(url)) AS n FROM v_bulk_requests),
f AS (SELECT workspace_id, n, min(seq) AS first FROM rq GROUP BY ALL),
fresh AS (SELECT f.*, row_number() OVER (PARTITION BY f.workspace_id ORDER BY first) AS r FROM f
          WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.workspace_id = f.workspace_id AND ex.n = f.n)),
st AS (SELECT rq.workspace_id, rq.seq, CASE WHEN fr.n IS NULL THEN 'duplicate'
         WHEN fr.r > 60 - coalesce(c, 0) THEN 'rejected' WHEN fr.first = rq.seq THEN 'created' ELSE 'duplicate' END AS status
       FROM rq LEFT JOIN fresh fr ON rq.workspace_id = fr.workspace_id AND rq.n = fr.n
       LEFT JOIN cnt ON rq.workspace_id = cnt.workspace_id)"""


@query("bulk_add_items", f"WITH {_BULK} SELECT * FROM st")
def _(view):
    out = ws.bulk_add_items(view("v_bulk_existing"), view("v_bulk_requests"), cap=60)
    return out.select("workspace_id", "seq", "status")


@query("bulk_add_totals", f"""
WITH {_BULK} SELECT st.workspace_id, count(*) FILTER (WHERE status = 'created') AS created,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'rejected') AS rejected,
  coalesce(max(c), 0) + count(*) FILTER (WHERE status = 'created') AS workspace_total
FROM st LEFT JOIN cnt ON st.workspace_id = cnt.workspace_id GROUP BY st.workspace_id""")
def _(view):
    existing = view("v_bulk_existing")
    return ws.bulk_add_totals(existing, ws.bulk_add_items(existing, view("v_bulk_requests"), cap=60))


@query("list_items_order", "SELECT item_id, order_index FROM v_items ORDER BY order_index, created_at DESC")
def _(view):
    return ws.list_items_order(view("v_items")).select("item_id", "order_index")


@query("list_workspaces_order", "SELECT workspace_id, name FROM v_workspaces ORDER BY updated_at DESC")
def _(view):
    return ws.list_workspaces_order(view("v_workspaces")).select("workspace_id", "name")


@query("home_workspaces_order", """
SELECT w.workspace_id, count(i.item_id) AS item_count FROM v_workspaces w LEFT JOIN v_items i ON w.workspace_id = i.workspace_id
GROUP BY w.workspace_id, w.created_at ORDER BY w.created_at DESC, item_count DESC""")
def _(view):
    counted = ws.workspace_item_counts(view("v_workspaces"), view("v_items"))
    return ws.home_workspaces_order(counted).select("workspace_id", "item_count")


@query("list_users_order", "SELECT workspace_id AS user_id FROM v_workspaces ORDER BY created_at DESC")
def _(view):
    return ws.list_users_order(view("v_workspaces")).select(F.col("workspace_id").alias("user_id"))


@query("profiles_order", """
SELECT session_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_active FROM v_activity GROUP BY 1 ORDER BY max(created_at) DESC""")
def _(view):
    from gleanery.operators.history import profile_last_active

    ordered = ws.profiles_order(profile_last_active(view("v_activity")))
    return ordered.select("session_id", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss").alias("last_active"))


@query("profiles_by_name", """
SELECT c_custkey, row_number() OVER (ORDER BY n, c_custkey) AS place FROM (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'anonymous' ELSE
    lower(c_mktsegment) || ' ' || lpad(cast(length(d) AS varchar), 10, '0') || d END AS n FROM (SELECT *, cast(cast(floor(c_acctbal) AS bigint) AS varchar) AS d FROM customer) c) u""")
def _(view):
    from gleanery.operators.running import ordered_index

    name = F.when(F.col("c_acctbal") >= 0, F.concat_ws(" ", "c_mktsegment", F.col("c_acctbal").cast("int").cast("string")))
    users = view("customer").select("c_custkey", ws.profile_name_key(name).alias("name_key"))
    return ordered_index(users, ["name_key", "c_custkey"], "place").select("c_custkey", "place")


@query("recent_sources", """
WITH s AS (SELECT item_id AS object_id, workspace_id, coalesce(CASE WHEN order_index > 3 THEN created_at + interval '100' day END, created_at) AS t FROM v_items)
SELECT workspace_id, object_id, row_number() OVER (PARTITION BY workspace_id ORDER BY t DESC, object_id DESC) - 1 AS rank
FROM s QUALIFY rank < 4""")
def _(view):
    items = view("v_items").select(
        F.col("item_id").alias("object_id"), "workspace_id", "created_at",
        F.when(F.col("order_index") > 3, F.col("created_at") + F.expr("interval '100' day")).alias("updated_at"))
    return ws.recent_sources(items).select("workspace_id", "object_id", "rank")


@query("recent_reads", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank, pos, url FROM v_results WHERE img_src IS NOT NULL
QUALIFY rank < 3""")
def _(view):
    rows = view("v_results").withColumn("loading", F.col("img_src").isNull())
    return ws.recent_finished(rows, "query_id").select("query_id", "rank", "pos", "url")


@query("recent_media", """
SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY item_id) - 1 AS rank, item_id, media_url AS src
FROM v_items WHERE media_url IS NOT NULL QUALIFY rank < 6""")
def _(view):
    return ws.recent_media(view("v_items")).select("workspace_id", "rank", "item_id", "src")
