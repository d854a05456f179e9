"""Workspace objects: membership, search, counts, ordering and referential rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.text import blank_to_null, natural_sort_key, trim_space
from gleanery.functions.urls import strip_www, url_host
from gleanery.operators.bm25 import top_k
from gleanery.operators.running import running_total

# Limits of the workspace views.
MAX_ITEMS = 1000
#: Requests and items that one task of a bulk add takes, on average.
TASK_ROWS = 1 << 18
DOMAIN_PILLS = 4
RECENT_SOURCES = 4
RECENT_READS = 3
RECENT_MEDIA = 6

STATION_PARTS = ("sources", "reads", "summaries", "notes", "pins", "images", "videos", "comparisons",
                 "highlights", "tags")


def require_workspace(objects: DataFrame, workspaces: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Objects of workspaces that exist, or that one of ``sessions`` (session_id) owns."""
    owned = workspaces if sessions is None else workspaces.join(sessions.select("session_id"), "session_id", "left_semi")
    return objects.join(owned.select("workspace_id"), "workspace_id", "left_semi")


def _holds(column: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def workspace_search(items: DataFrame, notes: DataFrame, q: str, note_chars: int | None = None) -> DataFrame:
    """Items by title or snippet, notes by title or content; case-insensitive substring.

    A note shows its whole content, or its first ``note_chars`` characters.
    """
    shown = F.col("content") if note_chars is None else F.substring("content", 1, note_chars)
    found = items.where(_holds(F.col("title"), q) | _holds(F.col("snippet"), q)).select(
        "workspace_id", F.lit("item").alias("object_type"), F.col("item_id").alias("object_id"),
        F.coalesce("title", F.lit("")).alias("title"), "snippet", "url")
    noted = notes.where(_holds(F.col("title"), q) | _holds(F.col("content"), q)).select(
        "workspace_id", F.lit("note").alias("object_type"), F.col("note_id").alias("object_id"), "title",
        shown.alias("snippet"), F.lit(None).cast("string").alias("url"))
    return found.unionByName(noted)


def all_sources(items: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
    """Pages, images and videos as one tagged list (object_id, source_type, …)."""
    pages = items.withColumnRenamed("item_id", "object_id").withColumn("source_type", F.lit("page"))
    pics = images.withColumnRenamed("image_id", "object_id").withColumn("source_type", F.lit("image"))
    clips = videos.withColumnRenamed("video_id", "object_id").withColumn("source_type", F.lit("video"))
    return pages.unionByName(pics, allowMissingColumns=True).unionByName(clips, allowMissingColumns=True)


def station_filter(sources: DataFrame, q: str) -> DataFrame:
    """Sources whose title or snippet (else caption) holds ``q``; all of them when it is blank."""
    if not q.strip():
        return sources
    shown = F.coalesce(blank_to_null(F.col("snippet")), F.col("caption"))
    return sources.where(_holds(F.col("title"), q) | _holds(shown, q))


def tagged_objects(taggings: DataFrame, items: DataFrame) -> DataFrame:
    """Items behind item taggings; dangling ones drop out."""
    refs = taggings.where(F.col("taggable_type") == "item").select(
        "tag_id", F.col("taggable_id").alias("item_id"))
    return refs.join(items, "item_id").select(
        "tag_id", "item_id", F.coalesce("title", F.lit("")).alias("title"), "snippet", "url")


def unique_tagging(taggings: DataFrame) -> DataFrame:
    return taggings.dropDuplicates(["tag_id", "taggable_type", "taggable_id"])


def workspace_item_counts(workspaces: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("workspace_id").agg(F.count("*").alias("item_count"))
    return workspaces.join(counts, "workspace_id", "left").na.fill(0, ["item_count"])


def station_stats(workspaces: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per workspace with a zero-filled count per object kind.

    Each kind is counted on its own before the shuffle; only the counts are combined.
    """
    tagged = None
    for name, df in parts.items():
        one = df.groupBy(F.col("workspace_id").cast("long").alias("workspace_id")).agg(
            F.count("*").alias("n")).withColumn("part", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    wide = tagged.groupBy("workspace_id").pivot("part", list(STATION_PARTS)).agg(F.sum("n"))
    return workspaces.select("workspace_id").join(wide, "workspace_id", "left").na.fill(0, list(STATION_PARTS))


def domain_pills(items: DataFrame, k: int = DOMAIN_PILLS, order: str = "item_id") -> DataFrame:
    """The first ``k`` distinct hosts of each workspace in first-seen order, and how many more there are."""
    host = strip_www(url_host(F.col("url")))
    seen = items.select("workspace_id", host.alias("host"), order).where(F.col("host").isNotNull()).groupBy(
        "workspace_id", "host").agg(F.min(order).alias("at"))
    overflow = seen.groupBy("workspace_id").agg(F.greatest(F.count("*") - k, F.lit(0)).alias("overflow"))
    first = top_k(seen.withColumn("__neg", -F.col("at")), k, key="workspace_id", score="__neg", tie="host")
    # at most k hosts per list
    pills = first.groupBy("workspace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "host"))), lambda s: s["host"]).alias("domains"))
    return pills.join(overflow, "workspace_id")


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("object_type").agg(F.count("*").alias("n"))


def group_by_workspace(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Rows labelled with their group; no workspace is a group of its own, a deleted one drops its rows.

    Groups may be of any size, so they stay rows; :func:`group_sizes` counts them.
    """
    named = workspaces.select("workspace_id", F.col("name").alias("group_name"))
    loose = rows.where(F.col("workspace_id").isNull()).withColumn("group_name", F.lit("noWorkspace"))
    kept = rows.join(named, "workspace_id")
    return kept.unionByName(loose)


def group_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("workspace_id", "group_name").agg(F.count("*").alias("n"))


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Children left after their parents were deleted."""
    gone = deleted.select(F.col(parent_key or key).alias(key)).distinct()
    return children.join(gone, key, "left_anti")


def delete_nodes(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges left after nodes were deleted at either end."""
    return cascade_delete(cascade_delete(edges, deleted, "source_node_id", "node_id"), deleted,
                          "target_node_id", "node_id")


def set_null_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Clear references to deleted parents."""
    gone = deleted.select(F.col(key), F.lit(True).alias("__gone")).dropDuplicates([key])
    marked = children.join(gone, key, "left")
    return marked.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone").select(children.columns)


def partial_update(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Overwrite only the columns a patch row sets."""
    changed = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    return base.join(renamed, key, "left").select([
        F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


# --- order -------------------------------------------------------------------------------------

def list_items_order(items: DataFrame) -> DataFrame:
    return items.orderBy(F.asc("order_index"), F.desc("created_at"), F.asc("item_id"))


def list_workspaces_order(workspaces: DataFrame) -> DataFrame:
    return workspaces.orderBy(F.desc("updated_at"), F.asc("workspace_id"))


def home_workspaces_order(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.desc("created_at"), F.desc("item_count"), F.asc("workspace_id"))


def list_users_order(users: DataFrame) -> DataFrame:
    return users.orderBy(F.desc("created_at"), F.asc("session_id"))


def profiles_order(profiles: DataFrame) -> DataFrame:
    """Most recently active first."""
    return profiles.orderBy(F.desc("last_active"), F.asc("session_id"))


def profile_name_key(username: Column) -> Column:
    """Natural, case-insensitive sort key; nameless profiles sort as Anonymous."""
    return natural_sort_key(F.coalesce(blank_to_null(username), F.lit("Anonymous")))


def profiles_by_name(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(profile_name_key(F.col("username")), "session_id")


def latest_k(rows: DataFrame, key: str, k: int, order: Sequence[str]) -> DataFrame:
    """The ``k`` newest rows of each key by descending ``order``, ranked from 0."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).withColumn(
        "rank", (F.col("rank") - 1).cast("long"))


def recent_sources(sources: DataFrame, k: int = RECENT_SOURCES) -> DataFrame:
    """Latest by update, else creation."""
    stamped = sources.withColumn("touched_at", F.coalesce("updated_at", "created_at"))
    return latest_k(stamped, "workspace_id", k, ["touched_at", "object_id"])


def recent_finished(rows: DataFrame, key: str, k: int = RECENT_READS) -> DataFrame:
    """First ``k`` of a list (by pos) that are not loading."""
    ready = rows.where(~F.col("loading")).withColumn("__neg", -F.col("pos"))
    return top_k(ready, k, key=key, score="__neg", tie="url").drop("__neg")


def recent_media(items: DataFrame, k: int = RECENT_MEDIA, order: str = "item_id") -> DataFrame:
    """First ``k`` items of each workspace that have a picture."""
    src = F.coalesce(*[blank_to_null(F.col(c)) for c in ("media_url", "thumbnail", "img_src") if c in items.columns])
    pictured = items.withColumn("src", src).where(F.col("src").isNotNull()).withColumn("__neg", -F.col(order))
    return top_k(pictured, k, key="workspace_id", score="__neg", tie="url").drop("__neg")


def pin_order(pins: DataFrame, order: str) -> DataFrame:
    """New pins get the next index of their workspace: count so far + 1."""
    return running_total(pins, ["workspace_id"], [order], F.lit(1), "order_index")


def reorder(pins: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` is (workspace_id, pin_ids ARRAY): its pins get 1 … n, the others keep their index."""
    places = listed.select("workspace_id", F.posexplode("pin_ids").alias("__i", "pin_id")).groupBy(
        "workspace_id", "pin_id").agg(F.max("__i").alias("__i"))
    return pins.join(places, ["workspace_id", "pin_id"], "left").withColumn(
        "order_index", F.coalesce((F.col("__i") + 1).cast("long"), F.col("order_index").cast("long"))).drop("__i")


def bulk_add_items(existing: DataFrame, batch: DataFrame, cap: int = MAX_ITEMS, order: str = "seq") -> DataFrame:
    """Status of each request (workspace_id, seq, url): created, duplicate or rejected.

    Requests count in order. A URL (trimmed, lower-cased) already in the workspace is a duplicate;
    a new URL is created while there is room; a repeat shares the fate of its first request,
    as a duplicate of a created one or rejected again.
    """
    norm = F.lower(trim_space(F.col("url")))
    # tasks follow the number of rows, so that what one of them sorts or holds does not grow
    least = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-(batch.count() + existing.count()) // TASK_ROWS))
    key = ["workspace_id", "__n"]
    have = existing.select("workspace_id", norm.alias("__n")).repartition(parts, *key).distinct()
    counts = existing.groupBy("workspace_id").agg(F.count("*").alias("__count"))
    requests = batch.withColumn("__n", norm).repartition(parts, *key)
    firsts = requests.groupBy(*key).agg(F.min(order).alias("__first"))
    fresh = firsts.join(have, key, "left_anti")
    ranked = running_total(fresh, ["workspace_id"], ["__first"], F.lit(1), "__r", parts=parts)
    # behind the cap nothing fits, whatever the count: those rows are spread, so a workspace brings a task no more than the cap
    late = F.when(F.col("__r") > cap, F.col("__r")).otherwise(0)
    known = counts.withColumn("__late", F.lit(0).cast("long")).repartition(parts, "workspace_id", "__late")
    room = F.lit(cap) - F.coalesce("__count", F.lit(0))
    fate = ranked.withColumn("__late", late.cast("long")).repartition(parts, "workspace_id", "__late").join(
        known, ["workspace_id", "__late"], "left").select(
        "workspace_id", "__n", "__first", (F.col("__r") <= room).alias("__fits")).repartition(parts, *key)
    status = (
        F.when(F.col("__fits").isNull(), F.lit("duplicate"))
        .when(~F.col("__fits"), F.lit("rejected"))
        .when(F.col(order) == F.col("__first"), F.lit("created"))
        .otherwise(F.lit("duplicate"))
    )
    return requests.join(fate, key, "left").withColumn("status", status).drop(
        "__n", "__first", "__fits")


def bulk_add_totals(existing: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per workspace: created, duplicates, rejected and items in all."""
    counts = existing.groupBy("workspace_id").agg(F.count("*").alias("__count"))
    summed = statuses.groupBy("workspace_id").agg(
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "rejected").alias("rejected"))
    return summed.join(counts, "workspace_id", "left").select(
        "workspace_id", "created", "duplicates", "rejected",
        (F.coalesce("__count", F.lit(0)) + F.col("created")).alias("workspace_total"))


def load_all(parts: Mapping[str, DataFrame], workspaces: DataFrame, sessions: DataFrame | None = None,
             ) -> dict[str, DataFrame]:
    """Every object list restricted to visible workspaces, plus their stats."""
    loaded = {name: require_workspace(df, workspaces, sessions) for name, df in parts.items()}
    owned = workspaces if sessions is None else workspaces.join(sessions.select("session_id"), "session_id", "left_semi")
    loaded["stats"] = station_stats(owned, parts)
    return loaded
