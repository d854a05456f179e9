"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import materialize

WORDS = "[^\\x20\\x09-\\x0D]+"
#: Steps of the rank's logarithm in which running totals are first taken.
CELLS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Per source its size and target: weights repeat over sources by code point, null last; the words to share
    out are ``share`` of all; a target stops at ``most`` times the source, and the excess goes to the others
    by weight. One row per source; the level at which the others stand is found from running sums."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    caps = ranked.withColumn("cap", F.col("source_size") * most).withColumn("bound", F.col("cap") / F.col("weight"))
    rising = W.orderBy("bound", "rank")
    levels = caps.withColumn("place", F.row_number().over(rising)).withColumn(
        "level",
        (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
         - F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)),
    )
    level = F.min_by(F.when(F.col("level") <= F.col("bound"), F.col("level")),
                     F.when(F.col("level") <= F.col("bound"), F.col("place"))).over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double")))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def _chance(seed: int) -> Column:
    """A number between 0 and 1 that depends on the seed, the document id and the size alone."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Whole copies, and the Pareto rank of the rest: random odds over inclusion odds (null: nothing is left)."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u, odds = F.col("u"), F.col("fraction")
    return (
        rows.withColumn("whole", F.floor(copies)).withColumn("fraction", copies - F.col("whole")).withColumn("u", _chance(seed))
        .withColumn("x", F.when(odds > 0, (u * (1 - odds)) / ((1 - u) * odds)))
    )


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7,
                sizes: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source), ``copies`` and ``taken``.

    Every document of a source gets the whole copies that target / source size allows. One more copy goes
    to the first documents by Pareto rank until their words come as near as they can to what is left of
    the target. No document exceeds ``most`` copies, and reruns agree.

    Null text has size 0. A null source is a source of its own, the last. Rows that agree in id and size tie and
    are taken or left together. Columns of ``docs`` named like a result give way. An empty table gives an empty
    result. ``sizes`` may hand in written ``doc_id``, ``source``, ``size`` rows to save a reading of the texts.
    """
    own = docs.drop("source_size", "target", "copies", "taken")
    if sizes is None:
        own = own.drop("size").withColumn("size", word_count(F.col("text")))
        sizes = materialize(own.select("doc_id", "source", "size"), "sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    by_source = targets.select(F.col("source").alias("t_source"), "rank", "source_size", "target")

    # where the sample ends, per source: sums per cell of the rank, then one cell row by row
    rows = _ranked(sizes.join(by_source, same), seed).filter("x is not null").select(
        "rank", "x", "doc_id", "size", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.floor(F.log("x") * CELLS).alias("cell"))
    cells = rows.groupBy("rank", "cell").agg(F.sum("size").alias("n"))
    bases = cells.select("rank", "cell", F.coalesce(
        F.sum("n").over(W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = W.partitionBy("rank", "cell").orderBy("x", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = rows.join(bases, ["rank", "cell"]).filter(F.col("base") <= F.col("left")).withColumn("before", before)
    last = taken.filter(F.col("before") + F.col("size") / 2 <= F.col("left")).groupBy("rank").agg(F.max("x").alias("last_x"))
    marks = materialize(by_source.join(last, "rank", "left"), "marks")

    found = _ranked(own.join(marks, same), seed)
    copies = (F.col("whole") + F.coalesce((F.col("x") <= F.col("last_x")).cast("long"), F.lit(0))).cast("long")
    return found.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(
        "t_source", "rank", "whole", "fraction", "u", "x", "last_x")
