"""Line dedup by overlapping windows of three lines, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))


def _windows(text: Column) -> Column:
    """(h1, h2, at) of every window: a 128-bit name of three consecutive lines and the rank of the first."""

    def named(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: x.rlike(WORD))
        pairs = F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q")))

        def at(hashes: Column) -> Column:
            starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW))

            def one(i: Column) -> Column:
                got = [F.get(hashes, i + j) for j in range(WINDOW)]
                return F.struct(
                    F.xxhash64(*(g["p"] for g in got)).alias("h1"), F.xxhash64(*(g["q"] for g in got)).alias("h2"), i.alias("at"))

            return F.transform(starts, one)

        return _let(pairs, at)

    return _let(_lines(text), named)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated passages of three or more lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are split at ``\\n``; those without a word are in no window and always stay. Windows of three
    consecutive lines with words are compared over the whole table. The first, by document id (null first),
    text name and place, stays; the lines of every later one go, also where windows overlap. ``n_lines`` counts
    lines with a word, before.

    Null text stays null and has no lines. Rows with the same id and text are one document, and share its
    result. Columns named ``n_lines`` or ``n_removed`` give way. An empty table gives an empty result.
    """
    keyed = docs.drop("n_lines", "n_removed").withColumns({
        "__id": F.col("doc_id"), "__p": F.xxhash64("text"), "__q": F.xxhash64(F.lit(1), F.col("text"))})
    seen = keyed.select("__id", "__p", "__q", F.explode(_windows(F.col("text"))).alias("w")).select("__id", "__p", "__q", "w.*")
    # a document's rows count once
    occurrences = seen.distinct()
    firsts = (
        occurrences.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("__id", "__p", "__q", "at")).alias("first"))
        .filter("n > 1").select("h1", "h2", "first")
    )
    later = occurrences.join(firsts, ["h1", "h2"]).filter(F.struct("__id", "__p", "__q", "at") != F.col("first"))
    gone = later.groupBy("__id", "__p", "__q").agg(F.collect_set("at").alias("starts")).select(
        F.col("__id").alias("g_id"), F.col("__p").alias("g_p"), F.col("__q").alias("g_q"), "starts")
    same = F.col("__id").eqNullSafe(F.col("g_id")) & (F.col("__p") == F.col("g_p")) & (F.col("__q") == F.col("g_q"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*(s + j for j in range(WINDOW))))))

    def kept_text(lines: Column) -> Column:
        def from_places(places: Column) -> Column:
            out = F.transform(covered, lambda i: F.get(places, i))
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
            return _let(stay, lambda s: F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n"))

        return _let(_filled(lines), from_places)

    n_lines = _let(_lines(F.col("text")), lambda lines: F.size(F.filter(lines, lambda x: x.rlike(WORD))))
    rows = keyed.join(gone, same, "left").withColumns({
        "n_lines": n_lines.cast("long"),
        "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
    }).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(_let(_lines(F.col("text")), kept_text))
    return rows.withColumn("text", text).drop("__id", "__p", "__q", "g_id", "g_p", "g_q", "starts")
