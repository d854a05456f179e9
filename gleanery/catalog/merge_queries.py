"""Registered queries: result merging, facets and suggestions."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.catalog.retrieval_queries import _SIDES, _sides
from gleanery.operators import merge
from gleanery.session import scratch_path
from gleanery.sources import metasearch


@query("interleave_merge", f"""
WITH {_SIDES}, turns AS (SELECT query_id, doc_id, 2 * rank AS turn FROM b
    UNION ALL SELECT query_id, doc_id, 2 * rank + 1 FROM v),
f AS (SELECT query_id, doc_id, min(turn) AS turn FROM turns GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn) - 1 AS rank, c.url,
       CASE WHEN turn % 2 = 0 THEN 'left' ELSE 'right' END AS side
FROM f JOIN v_corpus c ON f.doc_id = c.doc_id""")
def _(view):
    left, right = (s.join(view("v_corpus").select("doc_id", "url"), "doc_id") for s in _sides(view))
    return merge.interleave_merge(left, right, page_size=40)


_T = """
p AS (SELECT *, CASE category WHEN 'images' THEN 1 WHEN 'videos' THEN 2 ELSE 0 END AS priority FROM v_results
      WHERE coalesce(category, '') <> 'news')"""


@query("collect_transfer_sources", f"""
WITH {_T}
SELECT query_id, priority, pos, url, title, coalesce(snippet, '') AS snippet,
       CASE WHEN priority = 0 THEN img_src ELSE coalesce(img_src, thumbnail) END AS media_url
FROM p QUALIFY row_number() OVER (PARTITION BY query_id, lower(url) ORDER BY priority, pos) = 1""")
def _(view):
    r = view("v_results")
    kind = F.coalesce("category", F.lit(""))
    main = r.where(~kind.isin("images", "videos", "news"))
    return merge.collect_transfer_sources(main, r.where(kind == "images"), r.where(kind == "videos"))


_LISTS = """
loc AS (SELECT DISTINCT url, title FROM v_results WHERE category = 'science'),
rem AS (SELECT url, title, bool_and(img_src IS NULL) AS loading FROM v_results WHERE coalesce(category, '') <> 'science' GROUP BY ALL)"""


def _lists(view):
    r = view("v_results")
    science = F.coalesce("category", F.lit("")) == "science"
    local = r.where(science).select("url", "title").distinct()
    remote = r.where(~science).groupBy("url", "title").agg(F.bool_and(F.col("img_src").isNull()).alias("loading"))
    return local, remote


@query("merge_lists_by_url", f"""
WITH {_LISTS} SELECT url, title, 0 AS part FROM loc
UNION ALL SELECT url, title, 1 FROM rem WHERE NOT loading AND url NOT IN (SELECT url FROM loc)""")
def _(view):
    return merge.merge_lists_by_url(*_lists(view))


@query("add_to_front", f"""
WITH {_LISTS} SELECT url, title, 0 AS part FROM rem
UNION ALL SELECT url, title, 1 FROM loc WHERE url NOT IN (SELECT url FROM rem)""")
def _(view):
    local, remote = _lists(view)
    return merge.add_to_front(local, remote)


@query("append_page", """
SELECT query_id, pos, url, 1 AS page FROM v_results WHERE category = 'science'
UNION ALL SELECT query_id, pos, url, 2 FROM v_results WHERE category = 'images' AND img_src IS NOT NULL""")
def _(view):
    r = view("v_results")
    first = r.where("category = 'science'").withColumn("page", F.lit(1))
    return merge.append_page(first, r.where("category = 'images'"), 2, images=True).select("query_id", "pos", "url", "page")


_H = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_TXT = "lower(title || ' ' || coalesce(snippet, ''))"


@query("facet", f"""
SELECT query_id, pos, coalesce(category, '') = 'science' OR contains({_H}, 'wikipedia') OR contains({_TXT}, 'study shows') AS is_research,
       contains(lower(coalesce(category, '')), 'qa') OR contains({_H}, 'reddit') OR contains({_H}, 'forum') AS is_discussion,
       ends_with({_H}, '.gov') OR contains({_TXT}, 'official website') AS is_official
FROM v_results""")
def _(view):
    return merge.facet(view("v_results")).select("query_id", "pos", "is_research", "is_discussion", "is_official")


@query("has_thumbnail", """
SELECT query_id, pos, coalesce(img_src, thumbnail) AS thumb FROM v_results
WHERE coalesce(img_src, thumbnail) IS NOT NULL AND coalesce(img_src, thumbnail) NOT IN
  (SELECT 'https://img.example/' || cast(p_partkey AS varchar) FROM part WHERE p_size > 40)""")
def _(view):
    failed = view("part").where("p_size > 40").select(
        F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string")).alias("url"))
    return merge.has_thumbnail(view("v_results"), failed).select("query_id", "pos", "thumb")


@query("is_image_result", "SELECT query_id, pos, img_src FROM v_results WHERE img_src IS NOT NULL")
def _(view):
    return merge.image_results(view("v_results")).select("query_id", "pos", "img_src")


@query("split_verticals", """
WITH f AS (SELECT * FROM v_results WHERE category IN ('images', 'videos', 'news')
           QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY pos) <= 24)
SELECT query_id, category, pos, url, coalesce(img_src, thumbnail) AS thumb FROM f
WHERE coalesce(img_src, thumbnail) IS NOT NULL AND (category <> 'images' OR img_src IS NOT NULL)""")
def _(view):
    return merge.split_verticals(view("v_results")).select("query_id", "category", "pos", "url", "thumb")


@query("results_with_url", """
SELECT doc_id AS query_id, url, title, coalesce(nullif(snippet, ''), description, '') AS snippet FROM (
  SELECT doc_id, CASE WHEN length(content) > 3000 THEN NULL ELSE url END AS url, title,
         CASE WHEN length(content) < 1000 THEN '' ELSE title END AS snippet, description FROM v_corpus) c
WHERE url IS NOT NULL""")
def _(view):
    n = F.length("content")
    hits = view("v_corpus").select(
        F.col("doc_id").alias("query_id"), F.when(n <= 3000, F.col("url")).alias("url"), "title",
        F.when(n < 1000, F.lit("")).otherwise(F.col("title")).alias("snippet"), "description")
    return merge.results_with_url(hits)


@query("distinct_url_count", "SELECT query_id, count(DISTINCT url) AS unique_urls FROM v_results GROUP BY 1")
def _(view):
    return merge.distinct_url_count(view("v_results"))


@query("distinct_url_count_approx")
def _(view):
    return merge.distinct_url_count(view("v_results"), approximate=True)


_CAND = """
cand AS (SELECT user_id AS query_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2
           WHEN 'view' THEN 3 END AS prio, event_id AS pos,
         CASE WHEN value < 60 THEN '' ELSE event_type || ' ' || props END AS suggestion FROM events
         WHERE event_type <> 'error')"""


def _candidates(view):
    names = list(merge.SUGGESTION_SOURCES)
    source = (
        F.when(F.col("event_type") == "signup", names[0]).when(F.col("event_type") == "purchase", names[1])
        .when(F.col("event_type") == "click", names[2]).when(F.col("event_type") == "view", names[3])
    )
    text = F.when(F.col("value") < 60, F.lit("")).otherwise(F.concat_ws(" ", "event_type", "props"))
    return view("events").where("event_type <> 'error'").select(
        F.col("user_id").alias("query_id"), source.alias("source"), F.col("event_id").alias("pos"), text.alias("suggestion"))


def _suggest_sql(keep: str) -> str:
    return f"""
WITH {_CAND}, ok AS (SELECT *, min(prio) OVER (PARTITION BY query_id) AS best FROM cand WHERE suggestion <> '' AND {keep})
SELECT query_id, ['searxng_autocompleter', 'searxng_search', 'searxng_titles', 'engine'][prio + 1] AS source,
       row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank, suggestion
FROM ok WHERE prio = best QUALIFY rank < 10"""


@query("suggest", _suggest_sql("TRUE"))
def _(view):
    return merge.suggest(_candidates(view))


@query("suggest_engine", _suggest_sql("prio = 3"))
def _(view):
    return merge.suggest(_candidates(view), provider="engine")


# Responses: one per order, with its lines as results (at most seven).
def _responses(view):
    line = view("lineitem").select(
        F.col("l_orderkey"), "l_linenumber",
        F.struct(
            F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("title"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("https://p.example/"), F.col("l_partkey").cast("string")))
            .alias("url"),
            F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("content"),
            F.when(F.col("l_discount") > 0.05, F.lit("bing")).alias("engine"),
            F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":30")).alias("length"),
        ).alias("r"))
    return line.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "r"))), lambda s: s["r"]).alias("results")
    ).select(F.col("l_orderkey").cast("string").alias("query"),
             F.when(F.size("results") > 5, F.lit(1000)).otherwise(F.lit(0)).alias("number_of_results"), "results")


def _stored_responses(view):
    responses = _responses(view)
    spark = responses.sparkSession
    path = scratch_path(spark, "responses")
    responses.write.json(path)
    return metasearch.read_metasearch_json(spark, path)


@query("read_metasearch_json", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
             cast(l_partkey AS varchar), CASE WHEN l_tax > 0.02 THEN l_linestatus END NULLS FIRST, l_discount > 0.05,
             cast(cast(l_quantity AS int) AS varchar) || ':') - 1 AS pos
           FROM lineitem WHERE l_returnflag <> 'N')
SELECT cast(l_orderkey AS varchar) AS query, cast(pos AS int) AS pos, 'Line ' || cast(l_linenumber AS varchar) AS title,
       'https://p.example/' || cast(l_partkey AS varchar) AS url,
       CASE WHEN l_tax > 0.02 THEN l_linestatus ELSE '' END AS snippet,
       CASE WHEN l_discount > 0.05 THEN 'bing' ELSE 'searxng' END AS source,
       cast(cast(l_quantity AS int) * 60 + 30 AS int) AS length_seconds
FROM k""")
def _(view):
    return metasearch.metasearch_results(_stored_responses(view)).select(
        "query", "pos", "title", "url", "snippet", "source", "length_seconds")


@query("metasearch_totals", """
SELECT cast(l_orderkey AS varchar) AS query,
       CASE WHEN count(*) > 5 THEN 1000 ELSE least(count(*) FILTER (WHERE l_returnflag <> 'N'), 4) + 4 END AS total_results
FROM lineitem GROUP BY l_orderkey""")
def _(view):
    return metasearch.metasearch_totals(_stored_responses(view), page_size=4).select("query", "total_results")


@query("export_results", "SELECT query_id, pos, url, title, snippet, category FROM v_results")
def _(view):
    rows = view("v_results").select("query_id", "pos", "url", "title", "snippet", "category")
    path = scratch_path(rows.sparkSession, "export")
    metasearch.export_results(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
