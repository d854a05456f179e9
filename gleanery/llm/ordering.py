"""Row numbers within keys of any size, without a task that sees a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import materialize


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """The null-safe condition that the named columns of two frames agree."""
    out = F.lit(True)
    for name in names:
        out &= left[name].eqNullSafe(right[name])
    return out


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null agrees with null; the named columns are those of ``left``."""
    theirs = right.select(*(F.col(c).alias(f"__r_{c}" if c in names else c) for c in right.columns))
    on = F.lit(True)
    for name in names:
        on &= F.col(name).eqNullSafe(F.col(f"__r_{name}"))
    return left.join(theirs, on, how).drop(*(f"__r_{c}" for c in names))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0 within ``keys``, in ``order``, nulls first) and ``n``, the rows of the key.

    Rows are range-partitioned by keys and order, so one key may fill any number of partitions. They are written
    once, which fixes their places; only one row per key and partition is summed up in a window. Rows that agree in
    all columns of ``order`` are numbered in any order.
    """
    columns = [*keys, *order]
    rows = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = materialize(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), name)
    parts = rows.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of_key = W.partitionBy(*keys)
    before = of_key.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select(
        *keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"), F.sum("__n").over(of_key).alias("n"))
    joined = null_safe_join(rows, base, [*keys, "__part"])
    return joined.withColumn("rank", F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")
