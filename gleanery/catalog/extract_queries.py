"""Registered queries: page extraction, URL and media functions."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.functions import media, text, urls
from gleanery.operators import dom, extract

_LINK_CTES = r"""
raw AS (SELECT page_id, url,
    regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    unnest(regexp_extract_all(html, '(?i)href=[ \t\r\n\f]*("[^"]*"|''[^'']*'')', 1)) AS quoted FROM pages),
refs AS (SELECT page_id, url, scheme, host,
    regexp_replace(substring(quoted, 2, length(quoted) - 2), '#.*$', '') AS href,
    substring(quoted, 2, length(quoted) - 2) AS full_href FROM raw),
joined AS (SELECT page_id, url, host, full_href,
    CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN href
         WHEN href LIKE '/%' THEN scheme || '://' || lower(host) || href END AS target FROM refs),
links AS (SELECT DISTINCT page_id, url, host, list_aggregate(list_transform(string_split(target, ''),
    lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]|["<>`{}]') THEN url_encode(c) ELSE c END),
    'string_agg', '') AS link FROM joined WHERE target IS NOT NULL AND full_href <> ''),
kept AS (SELECT page_id, url, link FROM links
    WHERE (regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1) = lower(host)
           OR ends_with(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1), '.' || lower(host)))
      AND NOT regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)),
        '\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|pdf|doc|docx|xls|xlsx|ppt|pptx|css|js|json|xml|rss|atom|zip|tar|gz|rar|7z|mp3|mp4|avi|mov|wmv|flv|woff|woff2|ttf|eot)$'))
"""

_STRIPPED = r"""regexp_replace(regexp_replace(html,
    '(?is)<script([^a-z0-9>][^>]*)?>.*?(</script[^>]*(>|\z)|\z)', '', 'g'),
    '(?is)<style([^a-z0-9>][^>]*)?>.*?(</style[^>]*(>|\z)|\z)', '', 'g')"""
_SP = r"[\s\x0b\x{85}\x{a0}]"


def _visible(body: str) -> str:
    no_tags = rf"regexp_replace({body}, '<[^>]*(>|\z)', '', 'g')"
    flat = f"regexp_replace({no_tags}, '{_SP}+', ' ', 'g')"
    return rf"regexp_replace({flat}, '^{_SP}+|{_SP}+\z', '', 'g')"


_SPACED = (
    r"regexp_replace(" + _STRIPPED + r", '(?i)</?(address|article|aside|blockquote|dd|details|dialog|div|dl|dt|"
    r"figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tfoot|ul|"
    r"br|tr|td|th|title|option)([^a-z0-9>][^>]*)?>', ' ', 'g')"
)
_TITLE = r"nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)), '')"


@query("strip_html", f"SELECT page_id, {_visible(_SPACED)} AS content FROM pages")
def _(view):
    return view("pages").select("page_id", extract.strip_html(F.col("html")).alias("content"))


@query("strip_html_glued", f"SELECT page_id, {_visible(_STRIPPED)} AS content FROM pages")
def _(view):
    return view("pages").select("page_id", extract.strip_html(F.col("html"), glue=True).alias("content"))


@query("title_light", f"SELECT page_id, {_TITLE} AS title FROM pages")
def _(view):
    return view("pages").select("page_id", extract.title_light(F.col("html")).alias("title"))


@query("links_light", f"WITH {_LINK_CTES} SELECT page_id, link FROM kept")
def _(view):
    return extract.links_light(view("pages")).select("page_id", F.explode("outgoing_links").alias("link"))


@query("normalize_url", f"WITH {_LINK_CTES} SELECT DISTINCT page_id, link FROM links")
def _(view):
    pages = view("pages")
    hrefs = pages.select("page_id", "url", F.explode(extract.hrefs_light(F.col("html"))).alias("href"))
    return (
        hrefs.withColumn("base", urls.base_parts(F.col("url")))
        .select("page_id", urls.normalize_url(F.col("href"), F.col("base")).alias("link"))
        .where(F.col("link").isNotNull()).distinct()
    )


@query("extract_pages", f"""
WITH {_LINK_CTES}, grouped AS (SELECT page_id, string_agg(link, ' ' ORDER BY link) AS links, count(*) AS n_links
    FROM kept GROUP BY page_id)
SELECT p.page_id, p.url, {_TITLE} AS title, cast(NULL AS varchar) AS description, {_visible(_SPACED)} AS content,
       coalesce(g.links, '') AS links, coalesce(g.n_links, 0) AS n_links
FROM pages p LEFT JOIN grouped g ON p.page_id = g.page_id""")
def _(view):
    out = extract.extract_pages(view("pages"), lightweight=True)
    return out.select(
        "page_id", "url", "title", "description", "content",
        F.array_join("outgoing_links", " ").alias("links"), F.size("outgoing_links").cast("long").alias("n_links"),
    )


@query("extract_pages_dom")
def _(view):
    out = extract.extract_pages(view("pages"), lightweight=False)
    return out.select("page_id", "url", "title", "description", "content",
                      F.array_join("outgoing_links", " ").alias("links"))


@query("clean_text")
def _(view):
    return extract.extract_pages(view("pages"), lightweight=False).select("page_id", "content")


@query("readable_article")
def _(view):
    return dom.readable_article(view("pages")).select("page_id", "content")


@query("link_edges", f"WITH {_LINK_CTES} SELECT url AS src_url, link AS dst_url FROM kept")
def _(view):
    return extract.link_edges(extract.extract_pages(view("pages")))


@query("same_site", r"""
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
s AS (SELECT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site FROM h)
SELECT host, site, host = site OR ends_with(host, '.' || site) AS same, host = 'm.' || site AS swapped FROM s""")
def _(view):
    h = extract.hosts(view("pages")).withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    return h.select(
        "host", "site", urls.same_site(F.col("host"), F.col("site")).alias("same"),
        urls.same_site(F.concat(F.lit("m."), "site"), F.col("host")).alias("swapped"))


@query("crawlable_extension", r"""
SELECT item_id, NOT regexp_matches(lower(url), '^[^?]*\.png(\?|$)') AS crawlable FROM v_items""")
def _(view):
    return view("v_items").select("item_id", urls.crawlable_extension(F.col("url")).alias("crawlable"))


@query("hosts", r"""SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages""")
def _(view):
    return extract.hosts(view("pages"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
       lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
       regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS bare_host,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def _(view):
    u = F.col("url")
    return view("pages").select(
        "page_id", urls.url_scheme(u).alias("scheme"), urls.url_host(u).alias("host"),
        urls.strip_www(urls.url_host(u)).alias("bare_host"), urls.url_path(u).alias("path"))


_META = """replace(html, '<head>', CASE WHEN length(html) > 3000
    THEN '<head><meta property="og:description" content="' ELSE '<head><META content=''' END ||
    replace(replace(regexp_extract(html, '<title>([^<]*)<', 1), '"', ''), '''', '') ||
    CASE WHEN length(html) > 3000 THEN '  ">' ELSE ''' name=''description''>' END)"""


@query("meta_description", f"""
WITH m AS (SELECT page_id, {_META} AS html FROM pages)
SELECT page_id, trim(coalesce(
    nullif(regexp_extract(html, '(?i)<meta\\s+(property|name)=["''](og:)?description["'']\\s+content=["'']([^"'']+)["'']', 3), ''),
    nullif(regexp_extract(html, '(?i)<meta\\s+content=["'']([^"'']+)["'']\\s+(property|name)=["''](og:)?description["'']', 1), '')
  )) AS description FROM m""")
def _(view):
    pages = view("pages").selectExpr("page_id", f"{_META} AS html")
    return pages.select("page_id", extract.meta_description(F.col("html")).alias("description"))


@query("detect_content_type", r"""
SELECT item_id AS id, CASE WHEN regexp_matches(lower(split_part(url, '?', 1)), '\.(jpg|jpeg|png|gif|webp|svg|bmp|ico)$')
       THEN 'image' ELSE 'article' END AS content_type,
       CASE WHEN regexp_matches(lower(split_part(url, '?', 1)), '\.(jpg|jpeg|png|gif|webp|svg|bmp|ico)$')
       THEN url END AS extra FROM v_items
UNION ALL
SELECT video_id, 'video', regexp_extract(url, 'youtu\.be/([\w-]+)', 1) FROM v_videos""")
def _(view):
    both = view("v_items").select(F.col("item_id").alias("id"), "url").unionByName(
        view("v_videos").select(F.col("video_id").alias("id"), "url"))
    return both.select("id", media.content_type(F.col("url")).alias("content_type"),
                       media.content_extra(F.col("url")).alias("extra"))


@query("is_boilerplate", r"""
SELECT doc_id, regexp_matches(t, '(?i)javascript\s+is\s+(disabled|blocked|required)|enable\s+javascript|not\s+compatible\s+with\s+your\s+web\s+browser|this\s+page\s+will\s+not\s+work\s+without|peer[-\s]?tube\s+is\s+not\s+compatible') AS boilerplate
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' Please ENABLE  JavaScript ' || text
             ELSE text END AS t FROM documents) d""")
def _(view):
    t = F.when(F.col("lang") == "de", F.concat("text", F.lit(" Please ENABLE  JavaScript "), "text"))
    return view("documents").select("doc_id", text.is_boilerplate(t.otherwise(F.col("text"))).alias("boilerplate"))


@query("is_filler_response", r"""
SELECT conv_id, turn, length(trim(t)) < 20 OR contains(t, 'i''m unable to') OR contains(t, 'please provide') AS filler
FROM (SELECT conv_id, turn, lower(CASE WHEN turn > 4 THEN text || ' I''m unable to go on' ELSE text END) AS t
      FROM conversations) c""")
def _(view):
    t = F.when(F.col("turn") > 4, F.concat("text", F.lit(" I'm unable to go on"))).otherwise(F.col("text"))
    return view("conversations").select("conv_id", "turn", text.is_filler_response(t).alias("filler"))


@query("reading_time", rf"""
SELECT doc_id, cast(greatest(1, round_even(len(regexp_extract_all(text, '[^\s\x0b\x{{85}}\x{{a0}}]+')) / 200.0, 0)) * 60 AS bigint)
       AS seconds FROM documents""")
def _(view):
    return view("documents").select("doc_id", text.reading_time_seconds(F.col("text")).alias("seconds"))


@query("clean_video_description", r"""
SELECT doc_id, trim(split_part(split_part(t, 'Terms Privacy Policy', 1), '© 20', 1), chr(10) || ' ' || chr(9)) AS description
FROM (SELECT doc_id, text || CASE WHEN lang = 'en' THEN ' © 2024 Co Terms Privacy Policy' ELSE
      ' Terms Privacy Policy' END || text AS t FROM documents) d""")
def _(view):
    tail = F.when(F.col("lang") == "en", F.lit(" © 2024 Co Terms Privacy Policy")).otherwise(
        F.lit(" Terms Privacy Policy"))
    t = F.concat("text", tail, "text")
    return view("documents").select("doc_id", text.clean_video_description(t).alias("description"))


@query("read_pages_report", r"""
WITH d AS (SELECT doc_id, url, content AS html, content, CASE
             WHEN length(content) > 4000 THEN url || '.PNG?x=1'
             WHEN length(content) > 3000 THEN 'https://youtu.be/d' || cast(doc_id AS varchar)
             ELSE url END AS u,
           CASE WHEN length(content) < 200 THEN '' WHEN length(content) < 400 THEN 'You must enable javascript ' || content
                ELSE content END AS body FROM v_corpus),
k AS (SELECT *, CASE WHEN length(content) > 4000 THEN 'image' WHEN length(content) > 3000 THEN 'video'
             ELSE 'article' END AS kind FROM d)
SELECT doc_id, kind AS content_type,
       CASE WHEN kind = 'article' AND body = '' THEN 'No readable content found on the page.'
            WHEN kind = 'article' AND body LIKE 'You must%' THEN
              'This page requires JavaScript and cannot be read automatically.' END AS error,
       NOT (kind = 'article' AND (body = '' OR body LIKE 'You must%')) AS success,
       cast(CASE WHEN kind = 'article' AND body NOT LIKE 'You must%' THEN length(body) ELSE 0 END AS bigint) AS content_length_chars,
       cast(CASE WHEN kind = 'article' AND body <> '' AND body NOT LIKE 'You must%' THEN
         greatest(1, round_even(len(regexp_extract_all(body, '[^\s\x0b\x{85}\x{a0}]+')) / 200.0, 0)) * 60 ELSE 0 END AS bigint)
         AS reading_time_seconds,
       CASE kind WHEN 'image' THEN u WHEN 'video' THEN 'https://img.youtube.com/vi/d' || cast(doc_id AS varchar) ||
         '/hqdefault.jpg' END AS media_url
FROM k""")
def _(view):
    n = F.length("content")
    docs = view("v_corpus").select(
        "doc_id", F.col("content").alias("html"),
        F.when(n > 4000, F.concat("url", F.lit(".PNG?x=1")))
        .when(n > 3000, F.concat(F.lit("https://youtu.be/d"), F.col("doc_id").cast("string")))
        .otherwise(F.col("url")).alias("url"),
        F.when(n < 200, F.lit("")).when(n < 400, F.concat(F.lit("You must enable javascript "), "content"))
        .otherwise(F.col("content")).alias("content"))
    report = extract.read_pages_report(docs)
    doc_id = F.regexp_extract("url", r"([0-9]+)(?:\.PNG\?x=1)?$", 1).cast("long")
    return report.select(doc_id.alias("doc_id"), "content_type", "error", "success", "content_length_chars",
                         "reading_time_seconds", "media_url")


@query("read_pages_report_articles")
def _(view):
    return extract.read_pages_report(dom.readable_article(view("pages")))


@query("parse_duration", r"""
WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN cast(cast(l_quantity AS int) AS varchar)
    WHEN 2 THEN cast(cast(l_quantity AS int) AS varchar) || '.7'
    WHEN 3 THEN cast(cast(l_quantity AS int) AS varchar) || ':05'
    WHEN 4 THEN '1:' || cast(cast(l_quantity AS int) AS varchar) || ':09'
    WHEN 5 THEN 'about ' || cast(cast(l_quantity AS int) AS varchar)
    WHEN 6 THEN ' ' ELSE '1:2:3:4' END AS raw, cast(l_quantity AS bigint) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q * 60 + 5
       WHEN 4 THEN 3600 + q * 60 + 9 END AS seconds,
       CASE WHEN l_linenumber IN (5, 7) THEN raw END AS raw_text,
       CASE l_linenumber WHEN 1 THEN '0:' || lpad(cast(q AS varchar), 2, '0')
            WHEN 2 THEN '0:' || lpad(cast(q AS varchar), 2, '0') WHEN 3 THEN cast(q AS varchar) || ':05'
            WHEN 4 THEN cast(60 + q AS varchar) || ':09' END AS shown
FROM d""")
def _(view):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    raw = (
        F.when(n == 1, q).when(n == 2, F.concat(q, F.lit(".7"))).when(n == 3, F.concat(q, F.lit(":05")))
        .when(n == 4, F.concat(F.lit("1:"), q, F.lit(":09"))).when(n == 5, F.concat(F.lit("about "), q))
        .when(n == 6, F.lit(" ")).otherwise(F.lit("1:2:3:4"))
    )
    df = view("lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    seconds = media.parse_duration(F.col("raw"))
    return df.select("l_orderkey", "l_linenumber", seconds.alias("seconds"),
                     media.raw_duration(F.col("raw")).alias("raw_text"), media.format_duration(seconds).alias("shown"))
