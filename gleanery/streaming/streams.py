"""Structured Streaming forms of ingest, de-duplication, indexing and crawl monitoring."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.crawl_log import error_rate_windows
from gleanery.plans.index_log import append_batch
from gleanery.sources.page_log import append_pages

# Write cadence of the page stream and lifetimes of cached answers, in seconds.
FLUSH_SECONDS = 5
CACHE_TTL = {"search": 300, "summary": 3600, "reader": 3600, "overview": 1800}
#: Groups that the keys of a cache are dealt to.
TTL_BUCKETS = 4096


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
                name_filter: str | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def _start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{FLUSH_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def stream_ingest(pages: DataFrame, root: str, checkpoint: str, order: str = "seq", available_now: bool = False) -> StreamingQuery:
    """Append every micro-batch of pages to the page log below ``root``; see ``page_log.newest_pages``."""
    return _start(pages, lambda batch, batch_id: append_pages(batch, root, batch_id, order), checkpoint, available_now)


def stream_index(pages: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every micro-batch of documents (doc_id, url, title, description, content) to the index log below ``root``."""
    return _start(pages, lambda batch, batch_id: append_batch(batch, root, batch_id), checkpoint, available_now)


def stream_new_urls(urls: DataFrame) -> DataFrame:
    """Each URL once, ever. The state is the set of URLs seen and grows with it, by definition."""
    return urls.select("url").dropDuplicates(["url"])


def dedupe_within_ttl(events: DataFrame, keys: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Events that a cache with this lifetime would have to compute → (keys…, ts).

    The first event of a key is computed; later ones are served until ``ttl_seconds`` have passed
    since that computation; the next one computes again. The state of a key is one time, let go once the watermark
    has passed its end of life. Keys are dealt to ``TTL_BUCKETS`` groups whose states hold the times of all their keys:
    a call per key would cost more than the work on it.
    """
    ttl = ttl_seconds * 1_000_000

    def compute(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            codes, names = pd.factorize(rows["__key"])
            micros = rows["__micros"].to_numpy()
            order = np.lexsort((micros, codes))
            micros = micros[order].tolist()
            ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
            found, computed = [], []
            for name, start, end in zip(names, [0, *ends], ends):
                last = held.get(name)
                at = start if last is None else bisect_left(micros, last + ttl, start, end)
                while at < end:
                    last = micros[at]
                    found.append(name)
                    computed.append(last)
                    at = bisect_left(micros, last + ttl, at, end)
                held[name] = last
            if computed:
                yield pd.DataFrame({"__key": found, "__micros": computed})
        now = state.getCurrentWatermarkMs()
        held = {name: last for name, last in held.items() if (last + ttl) // 1000 >= now}
        if not held:
            state.remove()
            return
        state.update((list(held), list(held.values())))
        state.setTimeoutTimestamp(max((min(held.values()) + ttl) // 1000, now) + 1)

    # text that gives each key back as it was
    forms = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key = F.to_json(F.struct(*keys), forms | {"ignoreNullFields": "false"})
    rows = events.withWatermark(ts, f"{ttl_seconds} seconds").select(
        F.pmod(F.xxhash64(key), F.lit(TTL_BUCKETS)).alias("__bucket"), ts, key.alias("__key"), F.unix_micros(F.col(ts)).alias("__micros"))
    out = rows.groupBy("__bucket").applyInPandasWithState(
        compute, "__key STRING, __micros BIGINT", "keys ARRAY<STRING>, last ARRAY<BIGINT>", "append", GroupStateTimeout.EventTimeTimeout)
    back = F.from_json("__key", T.StructType([events.schema[k] for k in keys]), forms)
    return out.select(back.alias("__key"), F.timestamp_micros("__micros").alias(ts)).select(*[F.col("__key")[k].alias(k) for k in keys], ts)


def stream_error_rate(log: DataFrame, width: str = "2 seconds", lateness: str | None = None) -> DataFrame:
    """The error-rate windows of a live log. Late rows count; with ``lateness`` windows are closed and let go."""
    return error_rate_windows(log if lateness is None else log.withWatermark("ts", lateness), width)


_WAITS = "host STRING, event_id BIGINT, wait_seconds DOUBLE"


def stream_politeness(requests: DataFrame, default_delay: float = 1.0) -> DataFrame:
    """Wait of each request (event_id, host, ts[, crawl_delay]) from per-host state: the time of the last one."""

    def wait(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Arrow batches of a group come in no order
        pdf = pd.concat(list(batches)).sort_values(["micros", "event_id"], ignore_index=True)
        gaps = pdf["micros"].diff()
        if last is not None:
            gaps.iloc[0] = pdf["micros"].iloc[0] - last
        # a late request came before the last one: nothing has passed since
        gaps = gaps.clip(lower=0)
        waits = (pdf["delay"].fillna(default_delay) - gaps / 1e6).clip(lower=0.0).fillna(0.0)
        newest = int(pdf["micros"].iloc[-1])
        state.update((newest if last is None else max(last, newest),))
        yield pd.DataFrame({"host": key[0], "event_id": pdf["event_id"], "wait_seconds": waits})

    delay = F.col("crawl_delay") if "crawl_delay" in requests.columns else F.lit(None)
    rows = requests.select(
        "host", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        delay.cast("double").alias("delay"))
    return rows.groupBy("host").applyInPandasWithState(
        wait, _WAITS, "last BIGINT", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet below ``root``, and read the result.

    In ``complete`` mode a batch replaces the ones before it.
    """
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/data").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/data" if mode == "complete" else f"{root}/data/batch={batch_id}")

        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")
