"""Registered queries: session history."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.operators import history


def _ts(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


_FMT = "'%Y-%m-%d %H:%M:%S'"


def _latest(table: str, key: str, order: str, k: int, cols: str) -> str:
    return f"""SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS rank FROM {table} QUALIFY rank < {k}"""


@query("coalescing_upsert", f"""
SELECT session_id, url, arg_max(title, (ts, event_id)) FILTER (WHERE title IS NOT NULL) AS title,
       arg_max(source, (ts, event_id)) FILTER (WHERE source IS NOT NULL) AS source,
       arg_max(workspace_id, (ts, event_id)) FILTER (WHERE workspace_id IS NOT NULL) AS workspace_id,
       strftime(min(ts), {_FMT}) AS saved_at
FROM v_read_events GROUP BY ALL""")
def _(view):
    out = history.coalescing_upsert(
        view("v_read_events"), ["session_id", "url"], ["title", "source", "workspace_id"], ["ts", "event_id"], "ts")
    return out.select("session_id", "url", "title", "source", "workspace_id", _ts("saved_at"))


@query("rename_latest", """
SELECT session_id, arg_max(title, (ts, event_id)) FILTER (WHERE title IS NOT NULL) AS title,
       arg_max(source, (ts, event_id)) FILTER (WHERE source IS NOT NULL) AS source
FROM v_read_events GROUP BY session_id""")
def _(view):
    return history.rename_latest(view("v_read_events"), ["title", "source"], ["ts", "event_id"])


@query("profile_last_active", f"""
SELECT session_id, strftime(min(created_at), {_FMT}) AS created_at, strftime(max(created_at), {_FMT}) AS last_active
FROM v_activity GROUP BY 1""")
def _(view):
    return history.profile_last_active(view("v_activity")).select("session_id", _ts("created_at"), _ts("last_active"))


@query("latest_overview", """
SELECT session_id, action_type AS query, arg_max(details, (created_at, id)) AS overview FROM v_activity GROUP BY ALL""")
def _(view):
    saves = view("v_activity").withColumnRenamed("action_type", "query").withColumnRenamed("details", "overview")
    return history.latest_overview(saves, ["created_at", "id"])


@query("read_status_times", f"""
SELECT read_id, strftime(min(ts) FILTER (WHERE status = 'reading'), {_FMT}) AS started_at,
       strftime(min(ts) FILTER (WHERE status = 'completed'), {_FMT}) AS completed_at,
       arg_max(status, (ts, event_id)) AS status FROM v_read_status GROUP BY read_id""")
def _(view):
    return history.read_status_times(view("v_read_status")).select("read_id", _ts("started_at"), _ts("completed_at"), "status")


@query("task_completed_at", f"""
WITH l AS (SELECT read_id, ts, status, lag(status) OVER (PARTITION BY read_id ORDER BY ts, event_id) AS was FROM v_read_status)
SELECT read_id AS task_id, strftime(max(ts) FILTER (WHERE status = 'completed' AND coalesce(was, '') <> 'completed'), {_FMT})
  AS completed_at FROM l GROUP BY 1""")
def _(view):
    events = view("v_read_status").withColumnRenamed("read_id", "task_id")
    return history.task_completed_at(events).select("task_id", _ts("completed_at"))


@query("search_history", _latest("v_activity", "session_id", "created_at DESC, id DESC", 50, "session_id, id"))
def _(view):
    return history.search_history(view("v_activity")).select("session_id", "id", "rank")


@query("activity_log", _latest("v_activity", "session_id", "created_at DESC, id DESC", 100, "session_id, id, details"))
def _(view):
    return history.activity_log(view("v_activity")).select("session_id", "id", "details", "rank")


@query("reading_list", f"""
WITH r AS (SELECT session_id, url, min(ts) AS saved_at FROM v_read_events GROUP BY ALL)
{_latest('r', 'session_id', 'saved_at DESC, url DESC', 50, 'session_id, url')}""")
def _(view):
    rows = history.coalescing_upsert(view("v_read_events"), ["session_id", "url"], ["title"], ["ts", "event_id"], "ts")
    return history.reading_list(rows).select("session_id", "url", "rank")


@query("timeline", _latest("(SELECT *, action_type AS workspace_id FROM v_activity) a", "workspace_id",
                           "created_at DESC, id DESC", 200, "workspace_id, id"))
def _(view):
    return history.timeline(view("v_activity").withColumn("workspace_id", F.col("action_type"))).select(
        "workspace_id", "id", "rank")


@query("chat_order", _latest("v_chat", "workspace_id", "turn, message_id", 100, "workspace_id, message_id, content"))
def _(view):
    return history.chat_order(view("v_chat")).select("workspace_id", "message_id", "content", "rank")
