"""Media type and duration functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import trim_space

# Image file endings and video page addresses.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico")
VIDEO_PATTERN = r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/)([\w-]+)"

_IMAGE = r"\.(?:" + "|".join(IMAGE_EXTENSIONS) + r")$"


def content_type(url: Column) -> Column:
    """``image`` by path ending, ``video`` by address pattern, else ``article``."""
    path = F.lower(F.substring_index(url, "?", 1))
    return (
        F.when(path.rlike(_IMAGE), F.lit("image"))
        .when(url.rlike(VIDEO_PATTERN), F.lit("video"))
        .otherwise(F.lit("article"))
    )


def content_extra(url: Column) -> Column:
    """Image URL or video id; null for articles."""
    kind = content_type(url)
    return F.when(kind == "image", url).when(kind == "video", F.regexp_extract(url, VIDEO_PATTERN, 1))


def video_thumbnail(url: Column) -> Column:
    """Still-image address of a video page."""
    video_id = F.nullif(F.regexp_extract(url, VIDEO_PATTERN, 1), F.lit(""))
    return F.concat(F.lit("https://img.youtube.com/vi/"), video_id, F.lit("/hqdefault.jpg"))


def _clean(value: Column) -> Column:
    return F.nullif(trim_space(value), F.lit(""))


def _clock(parts: Column) -> Column:
    """Seconds from [m, s] or [h, m, s]; null for anything else or a part that is no number."""
    weights = F.when(F.size(parts) == 2, F.array(F.lit(60), F.lit(1))).when(
        F.size(parts) == 3, F.array(F.lit(3600), F.lit(60), F.lit(1)))
    terms = F.zip_with(parts, weights, lambda part, weight: part.try_cast("long") * weight)
    return F.aggregate(terms, F.lit(0).cast("long"), lambda total, term: total + term)


def parse_duration(value: Column) -> Column:
    """Seconds from ``123``, ``123.4``, ``m:ss`` or ``h:mm:ss``; null when it is none of these."""
    text = _clean(value)
    plain = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"),
                   text.try_cast("double").cast("long"))
    return F.coalesce(plain, _clock(F.split(text, ":")))


def raw_duration(value: Column) -> Column:
    """The text itself when it could not be read as a duration."""
    return F.when(parse_duration(value).isNull(), _clean(value))


def format_duration(seconds: Column) -> Column:
    """``m:ss``; null unless positive."""
    minutes = F.floor(seconds / 60).cast("long")
    rest = F.floor(F.pmod(seconds.cast("double"), F.lit(60.0)) + 0.5).cast("long")
    return F.when(
        seconds > 0,
        F.concat(minutes.cast("string"), F.lit(":"), F.when(rest < 10, F.lit("0")).otherwise(F.lit("")),
                 rest.cast("string")),
    )
