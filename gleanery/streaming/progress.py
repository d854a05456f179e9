"""Progress counters of a running crawl: one row per micro-batch, running totals at read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTERS = "pages BIGINT, errors BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP, batch BIGINT"


def count_batch(log: DataFrame, root: str, batch_id: int) -> None:
    """Write the counters of one micro-batch of the fetch log (ts, ok). A batch that runs again replaces its row."""
    log.agg(
        F.count_if("ok").alias("pages"), F.count_if(~F.col("ok")).alias("errors"),
        F.min(F.col("ts").cast("timestamp")).alias("first_ts"), F.max(F.col("ts").cast("timestamp")).alias("last_ts"),
    ).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def stream_progress(log: DataFrame, root: str, checkpoint: str, available_now: bool = False, seconds: float = 0.5) -> StreamingQuery:
    """Count every micro-batch of a live fetch log (ts, ok) into the table below ``root``; see ``progress``.

    What a batch writes is one row, and there is no state, so the stream runs on as long as the crawl does.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{int(seconds * 1000)} milliseconds"}
    return log.writeStream.foreachBatch(lambda batch, batch_id: count_batch(batch, root, batch_id)).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


def progress(spark: SparkSession, root: str, max_pages: int | None = None) -> DataFrame:
    """Totals after each micro-batch → (batch, pages, errors, elapsed_secs, pages_per_second, share).

    Elapsed time is event time. The rate is null before any time has passed, the share of the page budget
    without a budget. A batch without rows repeats the totals before it. The table has a row per micro-batch.
    """
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    elapsed = F.timestamp_diff("MICROSECOND", F.min("first_ts").over(so_far), F.max("last_ts").over(so_far)) / F.lit(1e6)
    totals = spark.read.schema(COUNTERS).parquet(root).select(
        "batch", F.sum("pages").over(so_far).alias("pages"), F.sum("errors").over(so_far).alias("errors"),
        F.coalesce(elapsed, F.lit(0.0)).alias("elapsed_secs"))
    rate = F.when(F.col("elapsed_secs") > 0, F.col("pages") / F.col("elapsed_secs"))
    return totals.withColumns({"pages_per_second": rate, "share": F.col("pages") / F.lit(max_pages).cast("double")})
