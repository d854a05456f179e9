"""Running totals and previous-row lookups that stay parallel inside one hot key.

A plain window puts every row of a key into one task. Here each key is cut into blocks
by an order-preserving ``block`` expression (an hour, a thousand ids). Rows are windowed
per (key, block); only one summary row per block is windowed per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import materialize

_B = "__block"


def _ranged(df: DataFrame, columns: Sequence[str], parts: int | None) -> DataFrame:
    """Rows with their range-partition number as block. Written once, so the number is fixed."""
    ranged = df.repartitionByRange(*columns) if parts is None else df.repartitionByRange(parts, *columns)
    return materialize(ranged.withColumn(_B, F.spark_partition_id()), "ranged")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  block: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over the rows of ``keys`` up to and including this one.

    Without a ``block`` expression the rows are range-partitioned by (keys, order) and each
    partition is a block, whatever the spread of the values. ``parts`` is the number of tasks, if Spark's own does not
    follow the number of rows.
    """
    keys = list(keys)
    rows = df.withColumn("__v", value)
    rows = _ranged(rows, [*keys, *order], parts) if block is None else rows.withColumn(_B, block)
    sums = rows.groupBy(*keys, _B).agg(F.sum("__v").alias("__s"))
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, _B, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*keys, _B).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    if parts is not None:
        rows, base = rows.repartition(parts, *keys, _B), base.repartition(parts, *keys, _B)
    return (
        rows.join(base, [*keys, _B])
        .withColumn(out, F.col("__base") + F.sum("__v").over(inside))
        .drop(_B, "__v", "__base")
    )


def ordered_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out`` = 1, 2, 3 … over the whole frame in ``order``, without one task seeing it all."""
    return running_total(df, [], order, F.lit(1), out)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column,
                  out: str) -> DataFrame:
    """Adds ``out`` = ``value`` of the row just before this one within ``keys`` (null for the first)."""
    keys = list(keys)
    rows = df.withColumn(_B, block).withColumn("__v", F.struct(value.alias("x")))
    last = rows.groupBy(*keys, _B).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    by_block = W.partitionBy(*keys).orderBy(_B)
    carried = last.select(*keys, _B, F.lag("__last").over(by_block).alias("__carry"))
    inside = W.partitionBy(*keys, _B).orderBy(*order)
    return (
        rows.join(carried, [*keys, _B])
        .withColumn(out, F.coalesce(F.lag("__v").over(inside), F.col("__carry"))["x"])
        .drop(_B, "__v", "__carry")
    )


def time_block(column: str, seconds: int) -> Column:
    """Blocks of ``seconds`` of wall time."""
    return F.floor(F.unix_timestamp(F.col(column).cast("timestamp")) / F.lit(seconds))
