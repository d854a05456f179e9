"""Connected components of an edge table by alternating star contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialize


def _contract(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): the neighbours of a node meet its smallest neighbour.

    The large step moves neighbours greater than the node, the small step those not greater. The smallest
    neighbour is an aggregate that combines before the shuffle, so a star of any size is spread over tasks.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        moved = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is joined with, for every node of an edge.

    Edges lead both ways; loops, repeats and null ends add nothing. An empty table gives an empty result.
    Each round is written once to the shared folder, so lost executors cost a read. The rounds grow with the
    logarithm of the longest path.
    """
    whole = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(b)).filter("node is not null").distinct()
    now = materialize(ends.filter("u <> v").distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = materialize(_contract(_contract(now, large=True), large=False), "edges")
        before, state = state, _state(now)
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
