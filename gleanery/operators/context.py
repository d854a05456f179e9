"""Bounded text context for language models, assembled per workspace or query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions.media import content_type
from gleanery.functions.text import blank_to_null, is_filler_response, keep_summary, trim_space, truncate
from gleanery.operators.bm25 import top_k

# How many sources go into a context.
CHAT_SOURCES = 5
STUDY_SOURCES = 4

# Prompt texts. {text}, {sources} and {question} are filled in.
ARTICLE_PROMPT = (
    "Summarize this webpage.\n\n"
    "## What this page is about\n"
    "One or two sentences describing the overall topic and purpose.\n\n"
    "## Main content\n"
    "A paragraph covering the key subjects and information.\n\n"
    "## Key points\n"
    "3-6 bullet points of the most important takeaways.\n\n"
    "OUTPUT ONLY THE SUMMARY. NO greetings, no meta-commentary, no sign-offs.\n\n"
    "WEBPAGE CONTENT:\n{text}"
)
VIDEO_PROMPT = (
    "Summarize this video based on its title and description.\n\n"
    "## What this video is about\n"
    "One or two sentences describing the video's topic and purpose.\n\n"
    "## Main content\n"
    "A paragraph describing the key content and information presented.\n\n"
    "## Key points\n"
    "3-6 bullet points of the most important takeaways.\n\n"
    "OUTPUT ONLY THE SUMMARY. NO greetings, no meta-commentary, no sign-offs.\n\n"
    "VIDEO:\n{text}"
)
IMAGE_PROMPT = (
    "Describe this image based on its title and any available metadata.\n\n"
    "## What this image is\n"
    "One or two sentences identifying the subject.\n\n"
    "## Details\n"
    "A paragraph describing what can be inferred about the image.\n\n"
    "## Key points\n"
    "Any notable elements visible or inferred from the image.\n\n"
    "OUTPUT ONLY THE SUMMARY. NO greetings, no meta-commentary, no sign-offs.\n\n"
    "IMAGE CONTEXT:\n{text}"
)
CHAT_PROMPT = (
    "Answer the question based on these sources.\n\n"
    "SOURCES:\n{sources}\n\n"
    "QUESTION: {question}\n\n"
    "Provide a clear answer. Reference source numbers like [1] when using information from a source."
)
NO_CONTENT = "(Content not available)"
IMAGE_NOTICE = "(Image — visual content, no text available)"
NO_SUMMARY = "Could not generate a meaningful summary from the available information."


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def fill(template: str, **parts: Column) -> Column:
    """A template with its named gaps filled by columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.index("{" + name + "}"), name) for name in parts if "{" + name + "}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), parts[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def chat_context(items: DataFrame, contents: DataFrame, k: int = CHAT_SOURCES, chars: int | None = None) -> DataFrame:
    """(workspace_id, context, n_sources) from the first ``k`` items of each workspace, texts whole unless ``chars`` is given.

    ``contents`` is (url, content, success). Only chosen items meet their text.
    """
    listed = items.withColumn("__neg", F.struct((-F.col("order_index")).alias("o"), F.col("created_at").alias("c")))
    chosen = top_k(listed, k, key="workspace_id", score="__neg", tie="item_id")
    texts = contents.select("url", F.when(F.col("success"), blank_to_null(F.col("content"))).alias("__text"))
    joined = chosen.join(texts, "url", "left")
    kind = content_type(F.col("url"))
    title = F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled"))
    label = F.when(kind == "image", F.concat(F.lit("[Image] "), title)).when(
        kind == "video", F.concat(F.lit("[Video] "), title)).otherwise(title)
    body = (
        F.when(kind == "image", F.lit(IMAGE_NOTICE))
        .when(kind == "video", F.coalesce(blank_to_null(F.col("snippet")), title))
        .otherwise(F.coalesce(truncate(F.col("__text"), chars), F.lit(NO_CONTENT)))
    )
    block = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), label, F.lit(" ("), F.col("url"),
                     F.lit(")\n"), body)
    # at most k blocks per workspace
    return joined.groupBy("workspace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]),
                     "\n\n").alias("context"),
        F.count("*").alias("n_sources"))


def chat_prompt(context: Column, question: Column) -> Column:
    return fill(CHAT_PROMPT, sources=context, question=question)


def study_context(results: DataFrame, contents: DataFrame, k: int = STUDY_SOURCES, chars: int | None = None) -> DataFrame:
    """(query_id, context) from those of the first ``k`` results whose page could be read."""
    first = results.where(F.col("rank") < k)
    texts = contents.where("success").select("url", blank_to_null(F.col("content")).alias("__text")).where(
        F.col("__text").isNotNull())
    block = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nURL: "), F.col("url"),
                     F.lit("\n\nContent:\n"), _head(F.col("__text"), chars))
    # at most k blocks per query
    return first.join(texts, "url").groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]),
                     "\n\n---\n\n").alias("context"))


def summary_prompt(content: Column, max_chars: int | None = None) -> Column:
    return fill(ARTICLE_PROMPT, text=truncate(content, max_chars))


def video_prompt(title: Column, description: Column, transcript: Column, max_chars: int | None = None) -> Column:
    """Title, then description and transcript where there are any."""
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit("Unknown"))),
        F.concat(F.lit("Description: "), blank_to_null(description)),
        F.concat(F.lit("Transcript:\n"), _head(blank_to_null(transcript), max_chars)))
    return fill(VIDEO_PROMPT, text=text)


def image_prompt(url: Column, title: Column, snippet: Column) -> Column:
    """Title and snippet, or a stand-in when both are blank."""
    described = trim_space(F.concat(
        F.coalesce(title, F.lit("")), F.coalesce(F.concat(F.lit(" "), blank_to_null(snippet)), F.lit(""))))
    text = F.coalesce(blank_to_null(described), F.concat(
        F.lit("An image at "), url, F.lit(" (no text description available).")))
    return fill(IMAGE_PROMPT, text=text)


def flag_summaries(df: DataFrame, summary: str = "summary") -> DataFrame:
    """Adds ``success``; filler replies are replaced by a standard message."""
    trimmed = trim_space(F.col(summary))
    text = F.coalesce(blank_to_null(trimmed), F.lit("No summary generated."))
    filler = is_filler_response(text)
    return df.withColumn("success", ~filler).withColumn(
        "message", F.when(filler, F.lit(NO_SUMMARY)).otherwise(text))


def reusable_summaries(items: DataFrame) -> DataFrame:
    """Adds ``reuse``: the stored summary can be served again."""
    return items.withColumn("reuse", keep_summary(F.col("summary")))


def chat_history(messages: DataFrame) -> DataFrame:
    """Messages with their source list parsed; unreadable lists are empty."""
    return messages.withColumn("sources", F.coalesce(
        F.from_json("sources_json", schemas.CHAT_SOURCES), F.array().cast(schemas.CHAT_SOURCES)))
