"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 200

# Signs of a page that only says "turn scripts on".
BOILERPLATE_PATTERNS = (
    r"javascript\s+is\s+(?:disabled|blocked|required)",
    r"enable\s+javascript",
    r"not\s+compatible\s+with\s+your\s+web\s+browser",
    r"this\s+page\s+will\s+not\s+work\s+without",
    r"peer[-\s]?tube\s+is\s+not\s+compatible",
)

# Phrases of a model reply that holds no summary.
FILLER_PHRASES = (
    "please provide", "i need access", "please state", "could you share",
    "you haven't provided", "no content was provided", "the webpage content was not provided",
    "please share", "i don't have access", "cannot summarize", "i'm unable to",
    "i do not have", "you did not provide", "no text was provided",
)
FILLER_MIN_LENGTH = 20

# Where the footer of a video description begins.
VIDEO_FOOTER_MARKERS = (
    "About Press Copyright",
    "Terms Privacy Policy",
    "© 20",
    "Share your videos with friends, family, and the world",
)

# Openings of a stored summary that records a failure.
FAILED_SUMMARY_PREFIXES = ("Summary generation failed", "Failed to fetch page", "No readable content")

SPACE = r"[\s\x0b\x{85}\x{a0}]"


def tokenize(text: Column, max_bytes: int | None = None) -> Column:
    """Lower-cased alphanumeric runs in text order; with ``max_bytes`` only the shorter ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return words if max_bytes is None else F.filter(words, lambda w: F.octet_length(w) < max_bytes)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def collapse_keep_newlines(text: Column) -> Column:
    """Runs of blanks become one space, runs of blanks holding a newline become one newline.

    A blank before a newline stays, a blank after one goes: the same as a left-to-right scan.
    """
    squeezed = F.regexp_replace(trim_space(text), r"[^\S\n]+", " ")
    return F.regexp_replace(squeezed, r"\n(?:[^\S\n]*\n)*[^\S\n]*", "\n")


def is_boilerplate(text: Column, window: int | None = None) -> Column:
    """Signs of a scripts-only page anywhere in the text, or in its first ``window`` characters."""
    pattern = "(?i)" + "|".join(BOILERPLATE_PATTERNS)
    return (text if window is None else F.substring(text, 1, window)).rlike(pattern)


def is_filler_response(text: Column) -> Column:
    lowered = trim_space(F.lower(text))
    return (F.length(lowered) < FILLER_MIN_LENGTH) | lowered.rlike("|".join(FILLER_PHRASES))


def keep_summary(summary: Column) -> Column:
    """True when a stored summary can be served again."""
    failed = F.lit(False)
    for prefix in FAILED_SUMMARY_PREFIXES:
        failed = failed | F.startswith(summary, F.lit(prefix))
    return F.coalesce((summary != "") & ~failed, F.lit(False))


def reading_time_seconds(text: Column, wpm: int = WORDS_PER_MINUTE) -> Column:
    """Whole minutes, at least one, half-even rounding, in seconds."""
    words = F.regexp_count(text, F.lit(rf"[^\s\x0b\x{{85}}\x{{a0}}]+"))
    minutes = F.bround(words / F.lit(float(wpm)), 0)
    return (F.greatest(F.lit(1.0), minutes) * 60).cast("long")


def clean_video_description(text: Column) -> Column:
    out = text
    for marker in VIDEO_FOOTER_MARKERS:
        out = F.substring_index(out, marker, 1)
    return trim_space(out)


def truncate(text: Column, limit: int | None, tail: str = "...") -> Column:
    """Text cut at ``limit`` characters with ``tail`` appended when something was cut; whole without a limit."""
    if limit is None:
        return text
    cut = F.concat(F.substring(text, 1, limit), F.lit(tail))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def natural_sort_key(text: Column) -> Column:
    """Lower-cased text with every digit run led by its length, so that 'a10' sorts after 'a9'.

    Leading zeros do not count; runs of any length keep their order.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = F.transform(runs, lambda r: F.regexp_replace(r, "^0+(?=[0-9])", ""))
    return F.array_join(F.transform(bare, lambda r: F.when(
        r.rlike("^[0-9]"), F.concat(F.lpad(F.length(r).cast("string"), 10, "0"), r)).otherwise(r)), "")
