"""Session history: reading lists, profiles, status times and overviews from event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import time_block, with_previous
from gleanery.operators.workspace import latest_k

# Rows shown per key.
SEARCHES_SHOWN = 50
READS_SHOWN = 50
SUMMARIES_SHOWN = 50
ACTIVITY_SHOWN = 100
TIMELINE_SHOWN = 200
CHAT_SHOWN = 100


def coalescing_upsert(events: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str],
                      saved: str) -> DataFrame:
    """One row per key: each column its last non-null value, ``saved_at`` the first event's time.

    Aggregates only, so repeats of a hot key combine before the shuffle.
    """
    at = F.struct(*order)
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    return events.groupBy(*keys).agg(*lasts, F.min(saved).alias("saved_at"))


def rename_latest(updates: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Profile fields per session after all updates: the last non-null value of each."""
    at = F.struct(*order)
    return updates.groupBy("session_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def profile_last_active(events: DataFrame, ts: str = "created_at") -> DataFrame:
    """Profile creation and last activity per session."""
    return events.groupBy("session_id").agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_active"))


def latest_overview(saves: DataFrame, order: Sequence[str]) -> DataFrame:
    """(session_id, query) → the overview saved last."""
    return saves.groupBy("session_id", "query").agg(F.max_by("overview", F.struct(*order)).alias("overview"))


def read_status_times(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """(read_id, status, ts) → first reading time, first completion time, last status."""
    return events.groupBy("read_id").agg(
        F.min(F.when(F.col("status") == "reading", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
        F.max_by("status", F.struct(*order)).alias("status"))


def task_completed_at(events: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "event_id"),
                      block_seconds: int = 86_400) -> DataFrame:
    """Time of the latest change into completed from another status."""
    previous = with_previous(events, [key], order, time_block("ts", block_seconds), F.col("status"), "__was")
    entered = (F.col("status") == "completed") & (F.coalesce("__was", F.lit("")) != "completed")
    return previous.groupBy(key).agg(F.max(F.when(entered, F.col("ts"))).alias("completed_at"))


def search_history(rows: DataFrame, k: int = SEARCHES_SHOWN) -> DataFrame:
    return latest_k(rows, "session_id", k, ["created_at", "id"])


def activity_log(rows: DataFrame, k: int = ACTIVITY_SHOWN) -> DataFrame:
    return latest_k(rows, "session_id", k, ["created_at", "id"])


def reading_list(rows: DataFrame, key: str = "session_id", k: int = READS_SHOWN) -> DataFrame:
    return latest_k(rows, key, k, ["saved_at", "url"])


def timeline(rows: DataFrame, k: int = TIMELINE_SHOWN) -> DataFrame:
    return latest_k(rows, "workspace_id", k, ["created_at", "id"])


def chat_order(messages: DataFrame, k: int = CHAT_SHOWN) -> DataFrame:
    """The first ``k`` messages of each workspace, oldest first."""
    from gleanery.operators.bm25 import top_k

    return top_k(messages.withColumn("__neg", -F.col("turn")), k, key="workspace_id", score="__neg",
                 tie="message_id").drop("__neg")
