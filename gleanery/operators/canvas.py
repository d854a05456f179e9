"""Canvas graph: nodes that point at objects, and edges between nodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import blank_to_null
from gleanery.functions.urls import url_host

# Name shown for an object without one.
DEFAULT_LABELS = {"source": "Untitled", "note": "Untitled", "image": "Image", "video": "Video",
                  "comparison": "Comparison"}


def typed_objects(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Object frames (workspace_id, object_id[, title][, caption][, url]) by type → one labelled list."""
    out = None
    for kind, df in parts.items():
        names = [blank_to_null(F.col(c)) for c in ("title", "caption") if c in df.columns]
        if kind == "source":
            names.append(url_host(F.col("url")))
        label = F.coalesce(*names, F.lit(DEFAULT_LABELS[kind]))
        one = df.select("workspace_id", F.lit(kind).alias("object_type"), "object_id", label.alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def unplaced_objects(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Objects with no node on the canvas."""
    return objects.join(nodes.select("object_type", "object_id"), ["object_type", "object_id"], "left_anti")


def resolve_canvas_objects(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """Nodes with the label of the object they point at; null where it is gone."""
    return nodes.join(objects.select("object_type", "object_id", "label"), ["object_type", "object_id"], "left")


def edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different known nodes."""
    src = nodes.select(F.col("node_id").alias("source_node_id"))
    dst = nodes.select(F.col("node_id").alias("target_node_id"))
    return edges.where(F.col("source_node_id") != F.col("target_node_id")).join(
        src, "source_node_id", "left_semi").join(dst, "target_node_id", "left_semi")
