"""Robots rules: parsing and checking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.text import trim_space


def parse_robots(df: DataFrame, agent: str) -> DataFrame:
    """(host, content) → (host, disallows, crawl_delay) for one user agent.

    Every user-agent line opens its own group. The first group naming the agent wins, else
    the first ``*`` group, else everything is allowed. One row in, one row out.
    """
    lines = F.transform(F.split("content", r"\r?\n"), trim_space)
    lines = F.filter(lines, lambda ln: ~F.startswith(ln, F.lit("#")) & F.contains(ln, F.lit(":")))
    entries = F.transform(lines, lambda ln: F.struct(
        F.lower(trim_space(F.substring_index(ln, ":", 1))).alias("key"),
        trim_space(F.regexp_replace(ln, "^[^:]*:", "")).alias("value"),
    ))
    groups = F.filter(
        F.transform(F.col("__e"), lambda e, i: F.struct(
            i.alias("at"), e["key"].alias("key"), F.lower(e["value"]).alias("agent"))),
        lambda g: g["key"] == "user-agent",
    )

    def first_of(name: str):
        return F.get(F.filter(F.col("__g"), lambda g: g["agent"] == name), F.lit(0))["at"]

    until = F.get(F.filter(F.col("__g"), lambda g: g["at"] > F.col("__at")), F.lit(0))["at"]
    length = F.coalesce(until, F.size("__e")) - F.col("__at") - 1
    body = F.when(F.col("__at").isNotNull(), F.slice(F.col("__e"), F.col("__at") + 2, length))
    delays = F.transform(
        F.filter(F.col("__body"), lambda e: e["key"] == "crawl-delay"), lambda e: e["value"].try_cast("double"))
    disallows = F.transform(
        F.filter(F.col("__body"), lambda e: (e["key"] == "disallow") & (e["value"] != "")), lambda e: e["value"])
    return (
        df.select("host", entries.alias("__e"))
        .withColumn("__g", groups)
        .withColumn("__at", F.coalesce(first_of(agent.lower()), first_of("*")))
        .withColumn("__body", body)
        .select(
            "host",
            F.coalesce(disallows, F.array().cast("array<string>")).alias("disallows"),
            F.get(F.filter(delays, lambda d: d >= 0), F.lit(0)).alias("crawl_delay"),
        )
    )


def robots_allows(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: false when the path starts with a non-empty disallow prefix of its host."""
    keyed = pages.withColumn("__host", urls.url_host(F.col(url))).withColumn("__path", urls.url_path(F.col(url)))
    prefixes = rules.select(F.col("host").alias("__host"), F.col("disallows").alias("__dis"))
    blocked = F.exists("__dis", lambda p: (p != "") & F.startswith(F.col("__path"), p))
    return (
        keyed.join(prefixes, "__host", "left")
        .withColumn("allowed", ~F.coalesce(blocked, F.lit(False)))
        .drop("__host", "__path", "__dis")
    )
