"""DuckDB SQL over the given tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_METRICS = {"m_length": 500, "m_symbols": 20, "m_dup_lines": 100, "m_repeats": 60}


def _fences(name: str, keys: list[str]) -> str:
    """Common table expressions with the fences of the groups named by ``keys``."""
    cols = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {cols[:-2]}" if keys else ""
    limits = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN q1 - 3 * greatest(q3 - q1, {slack}) END) AS lo_{m}, "
        f"max(CASE WHEN metric = '{m}' THEN q3 + 3 * greatest(q3 - q1, {slack}) END) AS hi_{m}"
        for m, slack in _METRICS.items()
    )
    return f"""
{name}_ranked AS (
  SELECT {cols}metric, v, row_number() OVER (PARTITION BY {cols}metric ORDER BY v) AS r,
         count(*) OVER (PARTITION BY {cols}metric) AS total FROM long),
{name}_q AS (
  SELECT {cols}metric, max(total) AS total, min(CASE WHEN 4 * r >= total THEN v END) AS q1,
         min(CASE WHEN 4 * r >= 3 * total THEN v END) AS q3 FROM {name}_ranked GROUP BY {cols}metric),
{name} AS (SELECT {cols}max(total) AS n_group, {limits} FROM {name}_q {group})"""


def _inside(alias: str) -> str:
    return " AND ".join(f"coalesce(s.{m} BETWEEN {alias}.lo_{m} AND {alias}.hi_{m}, true)" for m in _METRICS)


SQL: dict[str, str] = {}

SQL["op10_quality_rules"] = rf"""
WITH split AS (
  SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
  FROM documents),
starts AS (SELECT doc_id, i, ws[i : i + 7] AS w FROM split, unnest(generate_series(1, len(ws) - 7)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM starts) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, unnest(generate_series(0, 7)) AS t(o) GROUP BY doc_id),
stats AS (
  SELECT s.doc_id, lang, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN repeated r USING (doc_id)),
s AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS m_length,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS m_symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS m_dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS m_repeats
  FROM stats),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM s WHERE NOT base_failed" for m in _METRICS)}),
{_fences("g", ["lang", "source"])}, {_fences("l", ["lang"])}, {_fences("a", [])}
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
       NOT s.base_failed AND CASE WHEN g.n_group >= 200 THEN {_inside("g")}
                                  WHEN l.n_group >= 200 THEN {_inside("l")} ELSE {_inside("a")} END AS kept
FROM s LEFT JOIN g ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""

#: The rules of op3 as (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# No page of the tables has a canonical link or a refresh, so the rules alone decide here; aliases are tested
# in tests/llm.
SQL["op3_url_filters"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rule, h, p) AS (VALUES {", ".join(
    f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
hits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, false AS via_alias
FROM parts LEFT JOIN hits USING (page_id)"""

SQL["op4_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, n, l, regexp_matches(l, '{_WORD}') AS filled
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
       unnest(ls) WITH ORDINALITY AS t(l, n)),
ranked AS (SELECT doc_id, n, l, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM lines WHERE filled),
win AS (
  SELECT doc_id, r, l, lead(l, 1) OVER w AS l2, lead(l, 2) OVER w AS l3 FROM ranked
  WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
later AS (
  SELECT doc_id, r FROM (
    SELECT doc_id, r, row_number() OVER (PARTITION BY l, l2, l3 ORDER BY doc_id, r) AS place FROM win WHERE l3 IS NOT NULL)
  WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, r + o AS r FROM later, unnest([0, 1, 2]) AS t(o)),
kept AS (
  SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.n) AS text
  FROM lines l LEFT JOIN ranked k ON k.doc_id = l.doc_id AND k.n = l.n
  LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.r = k.r WHERE g.r IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM ranked x WHERE x.doc_id = d.doc_id), 0) AS n_lines,
       coalesce((SELECT count(*) FROM gone x WHERE x.doc_id = d.doc_id), 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""

_MIX = rf"""
sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
caps AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS bound
  FROM (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight FROM ranked)),
levels AS (
  SELECT *, row_number() OVER w AS place,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM caps WINDOW w AS (ORDER BY bound, rank)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, place) FROM levels WHERE level <= bound)) AS target
  FROM levels),
copies AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS c,
         (('0x' || substr(md5('7|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, floor(c)::BIGINT AS whole, c - floor(c) AS f FROM copies),
pareto AS (SELECT *, CASE WHEN f > 0 THEN (u * (1 - f)) / ((1 - u) * f) END AS x FROM odds),
run AS (
  SELECT source, x, size, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY x, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM pareto WHERE x IS NOT NULL),
marks AS (SELECT source, max(x) AS last_x FROM run WHERE before + size / 2.0::DOUBLE <= rest GROUP BY source),
mixed AS (
  SELECT p.*, whole + CASE WHEN x <= last_x THEN 1 ELSE 0 END AS copies
  FROM pareto p LEFT JOIN marks m ON p.source IS NOT DISTINCT FROM m.source)"""

SQL["op7_mixing"] = f"WITH {_MIX} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
