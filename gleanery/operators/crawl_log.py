"""Analytics over the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import running_total, time_block, with_previous
from gleanery.sources.pages import one_row

HOUR = 3600
MAX_RETRY_DELAY_MS = 30_000


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def is_html_response(log: DataFrame) -> DataFrame:
    """Successful responses whose content type says HTML."""
    return log.where(F.col("status").between(200, 299) & F.contains("content_type", F.lit("text/html")))


def error_class(message: Column) -> Column:
    """Class of an error message; the first matching class wins."""
    text = F.lower(message)
    return (
        F.when(text.rlike("timeout|timed out"), F.lit("timeout"))
        .when(text.rlike("connect|dns"), F.lit("connect"))
        .when(text.rlike("429|503|retry after"), F.lit("rate_limited"))
        .otherwise(F.lit("permanent"))
    )


def classify_fetch_errors(log: DataFrame) -> DataFrame:
    """Failed fetches with their error class."""
    return log.where(~F.col("ok")).withColumn("error_class", error_class(F.col("message")))


def retry_plan(log: DataFrame, max_retries: int = 3, base_ms: int = 500) -> DataFrame:
    """Failed fetches with allowed retries, delay before the next try, and the decision."""
    allowed = (
        F.when(F.col("error_class") == "connect", F.lit(min(1, max_retries)))
        .when(F.col("error_class").isin("timeout", "rate_limited"), F.lit(max_retries))
        .otherwise(F.lit(0))
    )
    delay = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("retry_count")), F.lit(float(MAX_RETRY_DELAY_MS)))
    return (
        classify_fetch_errors(log)
        .withColumn("max_retries", allowed)
        .withColumn("delay_ms", delay.cast("long"))
        .withColumn("retry", F.col("retry_count") < F.col("max_retries"))
    )


def politeness_wait(requests: DataFrame, rules: DataFrame | None = None, default_delay: float = 1.0,
                    block_seconds: int = HOUR) -> DataFrame:
    """Adds ``wait_seconds``: what is left of the host's delay since its previous request."""
    previous = with_previous(
        requests, ["host"], ["ts", "event_id"], time_block("ts", block_seconds), F.col("ts"), "__prev")
    delay = F.lit(default_delay)
    if rules is not None:
        previous = previous.join(rules.select("host", "crawl_delay"), "host", "left")
        delay = F.coalesce(F.col("crawl_delay"), delay)
    wait = F.greatest(F.lit(0.0), delay - seconds_between(F.col("__prev"), F.col("ts")))
    return previous.withColumn(
        "wait_seconds", F.when(F.col("__prev").isNull(), F.lit(0.0)).otherwise(wait)
    ).drop("__prev", "crawl_delay")


def crawl_summary(log: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """One row of crawl counters. ``frontier`` (url, allowed) adds discovery and robots counts."""
    totals = log.agg(
        seconds_between(F.min("ts"), F.max("ts")).alias("elapsed_secs"),
        F.count_if("ok").alias("pages_crawled"),
        F.count("*").alias("fetch_count"),
        F.count_if(~F.col("ok")).alias("fetch_errors"),
        F.count_if(F.col("retry_count") > 0).alias("retries"),
    )
    if frontier is None:
        return totals
    seen = frontier.agg(
        F.count_distinct("url").alias("urls_discovered"), F.count_if(~F.col("allowed")).alias("robots_blocked"))
    return one_row(totals, seen)


def throughput(log: DataFrame) -> DataFrame:
    """Crawled pages per second of elapsed time."""
    elapsed = seconds_between(F.min("ts"), F.max("ts"))
    return log.agg(F.count_if("ok").alias("pages"), (F.count_if("ok") / elapsed).alias("pages_per_second"))


def peak_concurrency(log: DataFrame, block_seconds: int = HOUR) -> DataFrame:
    """Most fetches in flight at once, from (ts, seconds); an end frees its place before a start takes one."""
    start = log.select("ts", F.lit(1).alias("delta"))
    micros = (F.col("seconds") * 1e6).cast("long")
    end = log.select((F.col("ts") + F.make_dt_interval(secs=micros / F.lit(1e6))).alias("ts"),
                     F.lit(-1).alias("delta"))
    steps = start.unionByName(end).groupBy("ts", "delta").agg(F.sum("delta").alias("step"))
    level = running_total(steps, [], ["ts", "delta"], F.col("step"), "in_flight", time_block("ts", block_seconds))
    return level.agg(F.max("in_flight").alias("peak"))


def error_rate_windows(log: DataFrame, width: str = "2 seconds", high: float = 0.20, low: float = 0.05) -> DataFrame:
    """Errors, fetches and the concurrency signal per tumbling window."""
    rate = F.col("errors") / F.col("fetches")
    return (
        log.groupBy(F.window("ts", width).alias("w"))
        .agg(F.count_if(~F.col("ok")).alias("errors"), F.count("*").alias("fetches"))
        .select(
            F.col("w.start").alias("window_start"), "errors", "fetches", rate.alias("error_rate"),
            F.when(rate > high, F.lit("back_off")).when(rate < low, F.lit("speed_up"))
            .otherwise(F.lit("hold")).alias("signal"),
        )
    )
