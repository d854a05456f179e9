"""Quality rules with adaptive cutoffs: per language and source, from mergeable quantile sketches.

The sketch of a metric is a histogram over whole thousandths: integer counts per bin, so sketches of
(language, source) merge to those of a language and of the corpus by adding counts, in any order and
with the same result. A quantile is exact in rank and off by less than a bin in value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import words as wd
from gleanery.session import materialize

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: A document is an outlier beyond the third quartile plus FENCE times the spread of the quartiles,
#: or as far below the first; spreads count as SLACK thousandths at least, so an even group rejects nobody.
FENCE = 3
SLACK = {"m_length": 500, "m_symbols": 20, "m_dup_lines": 100, "m_repeats": 60}
#: Groups with fewer documents use the sketch of their language, then that of the corpus.
MIN_GROUP = 200

_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[starts[1:]] - total[starts[:-1]]


def _repeats(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words of each row that lie in a window of k words found twice or more in the row."""
    n_rows = len(first) - 1
    row = np.repeat(np.arange(n_rows), np.diff(first))
    win = wd.windows(hashes, k)
    if not len(win):
        return np.zeros(n_rows, np.int64)
    inside = row[: len(win)] == row[k - 1 :]
    with np.errstate(over="ignore"):
        key = win ^ wd.mix(row[: len(win)].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, order[again], 1)
    np.add.at(change, order[again] + k, -1)
    covered = np.cumsum(change)[:-1] > 0
    return _per_row(covered, first)


def _measure(text: pa.Array) -> dict[str, np.ndarray]:
    data, starts = wd.joined(text)
    begin, end = wd.bounds(data)
    first = np.searchsorted(begin, starts)
    plain = ~wd.IS_SPACE[data]
    lines, repeated = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    raw = data.tobytes()
    for i in range(len(text)):
        with_word = [x for x in raw[starts[i] : starts[i + 1] - 1].split(b"\n") if x.strip()]
        lines[i] = len(with_word)
        repeated[i] = len(with_word) - len(set(with_word))
    return {
        "n_words": np.diff(first),
        "word_chars": _per_row(plain & ((data & 0xC0) != 0x80), starts),
        "n_symbols": _per_row(_IS_SYMBOL[data], starts),
        "n_lines": lines,
        "n_dup_lines": repeated,
        "n_repeat_words": _repeats(wd.hashes(data, begin, end), first, REPEAT_WINDOW),
    }


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with word, symbol, line and repetition counts of the whole ``text`` (null: none).

    Columns of ``docs`` named like a count give way to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in wd.chunks(batch.column(0)):
                part = batch.slice(start, stop - start)
                found = _measure(part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(pa.array(x, pa.int64()) for x in found.values())],
                    names=[*names, *found],
                )

    names = [c for c in keep if f" {c} long" not in f" {_STATS}"]
    rows = docs.select(F.col("text").cast("string"), *(F.col(f"`{c}`") for c in names))
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return rows.mapInArrow(run, kept + _STATS)


def _metrics(stats: DataFrame) -> DataFrame:
    """Whole thousandths; 0 where there is nothing to divide by."""

    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.expr(f"(1000 * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")

    return stats.withColumns({
        "m_length": share("word_chars", "n_words"),
        "m_symbols": share("n_symbols", "word_chars"),
        "m_dup_lines": share("n_dup_lines", "n_lines"),
        "m_repeats": share("n_repeat_words", "n_words"),
    })


def sketches(metrics: DataFrame) -> DataFrame:
    """One row per (language, source, metric, bin): the sketch as plain, addable counts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in SLACK)))
    return (
        metrics.filter(~F.col("base_failed"))
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.metric", "p.bin").agg(F.count("*").alias("n"))
    )


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to ``keys``: per metric the lowest and highest value that is no outlier."""
    merged = counts.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))
    quartiles = ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
    )
    spread = F.greatest(F.col("q3") - F.col("q1"), slack[F.col("metric")].cast("long")) * FENCE
    limits = quartiles.withColumn("limits", F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")))
    return limits.groupBy(*keys).agg(
        F.max("total").alias("n_group"),
        *(F.max(F.when(F.col("metric") == m, F.col("limits"))).alias(f"f_{m}") for m in SLACK),
    )


def quality_filter(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts per document with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated
    windows. The others are kept unless the mean word length, or the share of symbols, repeated lines or
    repeated words lies beyond the fence of their (language, source); small groups fall back to the language,
    then to the corpus. Documents that fail the base rules do not shape the fences.

    Null text has no words and fails. Null language or source is a group of its own. Repeated rows count
    each. An empty table gives an empty result. Further columns of ``docs`` are ignored.
    """
    stats = _metrics(text_statistics(docs, ["doc_id", "lang", "source"])).withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    stats = materialize(stats, "quality")
    # written as well: three merges read it
    counts = materialize(sketches(stats), "sketches")
    by_group, by_lang, over_all = fences(counts, ["lang", "source"]), fences(counts, ["lang"]), fences(counts, [])
    rows = stats
    for level, table, keys in (("g", by_group, ["lang", "source"]), ("l", by_lang, ["lang"])):
        table = table.select(*(F.col(k).alias(f"{level}_{k}") for k in keys), F.struct(F.col("n_group"), *(f"f_{m}" for m in SLACK)).alias(level))
        same = [F.col(k).eqNullSafe(F.col(f"{level}_{k}")) for k in keys]
        rows = rows.join(table, same, "left").drop(*(f"{level}_{k}" for k in keys))
    # one row by construction
    rows = rows.join(F.broadcast(over_all.select(F.struct(F.col("n_group"), *(f"f_{m}" for m in SLACK)).alias("a"))), how="left")
    used = F.when(F.col("g.n_group") >= MIN_GROUP, F.col("g")).when(F.col("l.n_group") >= MIN_GROUP, F.col("l")).otherwise(F.col("a"))
    rows = rows.withColumn("used", used)
    fits = [F.coalesce(F.col(m).between(F.col(f"used.f_{m}.low"), F.col(f"used.f_{m}.high")), F.lit(True)) for m in SLACK]
    verdict = fits[0]
    for x in fits[1:]:
        verdict = verdict & x
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"),
    )
