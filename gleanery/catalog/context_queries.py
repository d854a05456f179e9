"""Registered queries: context assembly for language models."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.catalog.retrieval_queries import _BM25, _index, _ranked
from gleanery.operators import bm25, context


def _sql_text(template: str, **parts: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in parts.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_DOC_ITEMS = """
it AS (SELECT doc_id AS item_id, cast(substring(source, 4) AS bigint) AS workspace_id, CASE WHEN length(content) > 4000
         THEN url || '.JPG' WHEN length(content) > 3000 THEN 'https://youtu.be/d' || cast(doc_id AS varchar) ELSE url END AS url,
         CASE WHEN length(content) < 300 THEN NULL ELSE title END AS title, description AS snippet, content,
         cast(floor(length(content) / 1000) AS int) AS order_index, length(content) > 450 AS success
       FROM (SELECT c.*, d.source FROM v_corpus c JOIN documents d ON c.doc_id = d.doc_id) c)"""


def _doc_items(view):
    docs = view("v_corpus").join(view("documents").select("doc_id", "source"), "doc_id")
    n = F.length("content")
    return docs.select(
        F.col("doc_id").alias("item_id"), F.substring("source", 4, 10).cast("long").alias("workspace_id"),
        F.when(n > 4000, F.concat("url", F.lit(".JPG")))
        .when(n > 3000, F.concat(F.lit("https://youtu.be/d"), F.col("doc_id").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(n >= 300, F.col("title")).alias("title"), F.col("description").alias("snippet"), "content",
        F.floor(n / 1000).cast("int").alias("order_index"), (n > 450).alias("success"),
        F.lit(0).alias("created_at"))


@query("chat_context", f"""
WITH {_DOC_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY order_index, item_id) AS n,
    coalesce(nullif(title, ''), 'Untitled') AS t FROM it QUALIFY n <= 5),
b AS (SELECT workspace_id, n, '[' || cast(n AS varchar) || '] ' || CASE WHEN url LIKE '%.JPG' THEN '[Image] ' WHEN url LIKE 'https://youtu%'
        THEN '[Video] ' ELSE '' END || t || ' (' || url || ')' || chr(10) ||
      CASE WHEN url LIKE '%.JPG' THEN '(Image — visual content, no text available)'
           WHEN url LIKE 'https://youtu%' THEN coalesce(nullif(snippet, ''), t)
           WHEN NOT success OR content = '' THEN '(Content not available)'
           ELSE content END AS block FROM r)
SELECT workspace_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS n_sources FROM b GROUP BY 1""")
def _(view):
    items = _doc_items(view)
    return context.chat_context(items, items.select("url", "content", "success"))


@query("chat_prompt", "SELECT item_id, " + _sql_text(context.CHAT_PROMPT, sources="text", question="cast(item_id AS varchar)")
       + " AS prompt FROM benchmark")
def _(view):
    return view("benchmark").select(
        "item_id", context.chat_prompt(F.col("text"), F.col("item_id").cast("string")).alias("prompt"))


@query("study_context", f"""
WITH {_BM25}, {_ranked('scores', 'r', 5)}
SELECT query_id, string_agg('Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || chr(10) || 'Content:' || chr(10) ||
  content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM r JOIN v_corpus c ON r.doc_id = c.doc_id WHERE rank < 4 AND length(content) > 300 GROUP BY query_id""")
def _(view):
    built = _index(view)
    hits = bm25.bm25_search(built, view("v_queries"), k=5).join(built.docs.select("doc_id", "url", "title"), "doc_id")
    contents = view("v_corpus").select("url", "content", (F.length("content") > 300).alias("success"))
    return context.study_context(hits, contents)


@query("summary_prompt", "SELECT doc_id, " + _sql_text(
    context.ARTICLE_PROMPT, text="text")
    + " AS prompt FROM documents")
def _(view):
    return view("documents").select("doc_id", context.summary_prompt(F.col("text")).alias("prompt"))


@query("video_prompt", "SELECT doc_id, " + _sql_text(context.VIDEO_PROMPT, text=(
    "'Title: ' || title || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || chr(10) || 'Description: ' || description "
    "ELSE '' END || chr(10) || chr(10) || 'Transcript:' || chr(10) || content"))
    + " AS prompt FROM v_corpus WHERE content <> ''")
def _(view):
    prompt = context.video_prompt(F.col("title"), F.col("description"), F.col("content"))
    return view("v_corpus").where("content <> ''").select("doc_id", prompt.alias("prompt"))


@query("image_prompt", "SELECT item_id, " + _sql_text(context.IMAGE_PROMPT, text=(
    "CASE WHEN title IS NULL AND snippet IS NULL THEN 'An image at ' || url || ' (no text description available).' "
    "ELSE trim(coalesce(title, '') || coalesce(' ' || snippet, '')) END")) + " AS prompt FROM v_items")
def _(view):
    prompt = context.image_prompt(F.col("url"), F.col("title"), F.col("snippet"))
    return view("v_items").select("item_id", prompt.alias("prompt"))


_REPLY = "CASE WHEN turn > 5 THEN '  ' WHEN turn > 4 THEN 'Sorry, I cannot summarize ' || text ELSE text END"


@query("flag_summaries", f"""
WITH r AS (SELECT conv_id, turn, trim({_REPLY}, chr(10) || ' ') AS s FROM conversations),
f AS (SELECT *, length(s) < 20 OR contains(lower(s), 'cannot summarize') AS bad FROM (
  SELECT conv_id, turn, CASE WHEN s = '' THEN 'No summary generated.' ELSE s END AS s FROM r) x)
SELECT conv_id, turn, NOT bad AS success, CASE WHEN bad THEN
  'Could not generate a meaningful summary from the available information.' ELSE s END AS message FROM f""")
def _(view):
    replies = view("conversations").selectExpr("conv_id", "turn", f"{_REPLY} AS summary")
    return context.flag_summaries(replies).select("conv_id", "turn", "success", "message")


@query("keep_summary", """
SELECT doc_id, s <> '' AND NOT starts_with(s, 'Failed to fetch page') AS reuse FROM (
  SELECT doc_id, CASE WHEN lang = 'de' THEN 'Failed to fetch page.' WHEN lang = 'fr' THEN '' ELSE text END AS s FROM documents) d""")
def _(view):
    summary = F.when(F.col("lang") == "de", "Failed to fetch page.").when(F.col("lang") == "fr", "").otherwise(F.col("text"))
    return context.reusable_summaries(view("documents").withColumn("summary", summary)).select("doc_id", "reuse")


@query("chat_history", """
SELECT message_id, role, content, CASE WHEN role = 'assistant' THEN 'https://c.example/' || cast(workspace_id AS varchar) ELSE '' END AS first_url,
       cast(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS int) AS n_sources FROM v_chat""")
def _(view):
    out = context.chat_history(view("v_chat"))
    return out.select("message_id", "role", "content",
                      F.coalesce(F.get("sources", F.lit(0))["url"], F.lit("")).alias("first_url"),
                      F.size("sources").alias("n_sources"))
