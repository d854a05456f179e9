"""DuckDB SQL of conversation repair, the Merkle manifest and the exact top-k search."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned crc32 of a short ASCII string: the bytes are folded bit by bit with the reflected polynomial."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    shifted = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, d: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {shifted}))"


SQL: dict[str, str] = {}

_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE
convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_NAME)} % 20 AS kind FROM conversations),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit JOIN convs ON hit.conv_id IS NOT DISTINCT FROM convs.conv_id, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS p,
         regexp_matches(text, '[^\x20\x09-\x0D]') AS filled, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended FROM damaged),
marked AS (
  SELECT *, substr(role, 1, 1) AS letter, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY p) AS former,
         row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 AS repeated FROM placed),
faults AS (
  SELECT *, NOT filled AS blank, filled AND repeated AS duplicate, filled AND NOT repeated AND NOT ended AS truncated FROM marked),
inserts(was, mid, ins) AS (VALUES ('B', 'B', ''), ('B', 'U', 'I'), ('B', 'A', 'II'), ('S', 'S', ''), ('S', 'U', 'I'), ('S', 'A', 'II'),
                                 ('U', 'U', ''), ('U', 'A', 'I'), ('A', 'A', ''), ('A', 'U', 'I')),
follows(mid, letter, state) AS (VALUES ('B', 's', 'S'), ('B', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
moves(was, ins, op, letter, state) AS (
  SELECT was, ins, 'D', NULL, mid FROM inserts
  UNION ALL SELECT was, ins, 'K', letter, state FROM inserts JOIN follows USING (mid)
  UNION ALL SELECT was, ins, 'R', letter, state FROM inserts JOIN follows USING (mid) WHERE letter <> 's'),
search(c, p, state, best) AS (
  SELECT DISTINCT c, 0::BIGINT, 'B', {{'cost': 0::BIGINT, 'audit': ''}} FROM faults
  UNION ALL
  SELECT f.c, f.p, m.state, min({{
           'cost': s.best.cost + 3 * strlen(m.ins) + CASE m.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                   + CASE WHEN f.truncated AND m.op <> 'D' THEN 3 ELSE 0 END,
           'audit': s.best.audit || m.ins || m.op}})
  FROM search s JOIN faults f ON f.c = s.c AND f.p = s.p + 1 JOIN moves m ON m.was = s.state
  WHERE m.op = 'D' OR (NOT f.blank AND NOT f.duplicate AND (m.op = 'R' OR m.letter = f.letter))
  GROUP BY f.c, f.p, m.state),
ends AS (
  SELECT s.c, min({{'cost': s.best.cost + 3 * strlen(i.ins), 'audit': s.best.audit || i.ins}}) AS best
  FROM search s JOIN (SELECT c, max(p) AS p FROM faults GROUP BY c) USING (c, p) JOIN inserts i ON i.was = s.state WHERE i.mid IN ('B', 'A') GROUP BY s.c),
letters AS (SELECT c, i, substr(best.audit, i, 1) AS op FROM ends, unnest(range(1, strlen(best.audit) + 1)) AS t(i)),
edits AS (
  SELECT l.*, f.role, f.text, count(*) FILTER (WHERE op <> 'D') OVER (PARTITION BY l.c ORDER BY i) AS kept FROM (
    SELECT *, count(*) FILTER (WHERE op <> 'I') OVER (PARTITION BY c ORDER BY i) AS p FROM letters) l
  LEFT JOIN faults f ON f.c = l.c AND f.p = l.p AND l.op <> 'I'),
starts AS (SELECT *, max(CASE WHEN kept = 1 AND op = 'K' AND substr(role, 1, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS system FROM edits),
repaired AS (
  SELECT c, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (kept - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                              chr(10) ORDER BY i)) AS digest FROM starts WHERE op <> 'D' GROUP BY c),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE former IS NOT NULL AND former || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (c) LEFT JOIN ends USING (c) LEFT JOIN repaired USING (c)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_GROW = """SELECT {key}, level + 1, index // 3, sha256(string_agg(digest, '' ORDER BY index))
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS width FROM {name}) WHERE width > 1 GROUP BY {key}, level, index // 3"""

SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE
hashed AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS claim FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT h.*, s, row_number() OVER (ORDER BY s, doc_id NULLS FIRST, leaf, claim NULLS FIRST) AS name,
         row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, claim NULLS FIRST) - 1 AS place
  FROM hashed h JOIN sources ON h.source IS NOT DISTINCT FROM sources.source),
low(s, level, index, digest) AS (SELECT s, 0, place, leaf FROM leaves UNION ALL {_GROW.format(key='s', name='low')}),
subroots AS (SELECT s, max(level) AS height, arg_max(digest, level) AS subroot FROM low GROUP BY s),
high(t, level, index, digest) AS (SELECT 0, 0, s, subroot FROM subroots UNION ALL {_GROW.format(key='t', name='high')}),
tops AS (SELECT max(level) AS top, arg_max(digest, level) AS root FROM high),
paths AS (
  SELECT name, s, place, height, top, level, CASE WHEN level < height THEN place // (3::BIGINT ** level)::BIGINT ELSE s // (3::BIGINT ** (level - height))::BIGINT END AS own
  FROM leaves JOIN subroots USING (s), tops, unnest(range(height + top)) AS x(level)),
steps AS (
  SELECT p.name, p.level, p.own, coalesce(string_agg(n.digest, '' ORDER BY n.index) FILTER (WHERE n.index < own), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.index) FILTER (WHERE n.index > own), '') AS r
  FROM paths p JOIN (SELECT 0 AS tier, s, level, index, digest FROM low UNION ALL SELECT 1, NULL, level, index, digest FROM high) n
    ON n.index // 3 = own // 3 AND CASE WHEN p.level < height THEN n.tier = 0 AND n.s = p.s AND n.level = p.level
                                        ELSE n.tier = 1 AND n.level = p.level - height END
  GROUP BY p.name, p.level, p.own),
proofs AS (SELECT name, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY name),
climb(name, level, digest) AS (
  SELECT name, 0::BIGINT, coalesce(claim, leaf) FROM leaves
  UNION ALL SELECT c.name, c.level + 1, sha256(l || digest || r) FROM climb c JOIN steps USING (name, level)),
folded AS (SELECT name, arg_max(digest, level) AS folded_root FROM climb GROUP BY name)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (s) JOIN folded USING (name) LEFT JOIN proofs USING (name), tops"""

SQL["op13_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.place <> c.place AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM best WHERE rank <= 10"""
