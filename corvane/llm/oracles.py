"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from corvane.llm.chat import HEAD_END, OPEN, SHUT
from corvane.llm.line_dedup import LEAST_WORDS
from corvane.llm.url_filter import RULES

WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_ESCAPED = "replace(replace({}, '\\', '\\b'), '<', '\\l')"
_ROLE = "replace(replace(" + _ESCAPED.format("role") + ", '>', '\\g'), '\"', '\\q')"

OP7 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
f AS (SELECT *, {_ESCAPED.format("text")} AS body, {_ROLE} AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(head) + {len(OPEN) + len(HEAD_END) + len(SHUT)}) AS BIGINT) AS formatted_chars,
  CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT) AS expanded_tokens
FROM f GROUP BY conv_id
"""

_RULES = ", ".join(f"('{a}', '{r}')" for a, r in RULES)

#: The tables hold no redirect and no canonical link, so what no rule fits is allowed.
OP8 = rf"""
WITH r AS (SELECT action, rule, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM (VALUES {_RULES}) t(action, rule)),
u AS (SELECT page_id, url, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
x AS (SELECT *, row_number() OVER () AS n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
b AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM x LEFT JOIN b USING (n)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP10 = rf"""
WITH l AS (SELECT doc_id, line, i AS line_no, regexp_extract_all(line, '{WORD}') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, array_to_string(w, ' ') AS s, doc_id * 1000000 + line_no AS place FROM l),
c AS (SELECT s, any_value(w) AS w, min(place) AS first FROM k WHERE s <> '' GROUP BY s),
v AS (SELECT s, first, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS d FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c WHERE len(w) >= {LEAST_WORDS})),
near AS (
  SELECT v.s FROM v JOIN (SELECT d, i, min(first) AS e FROM v GROUP BY ALL) m ON m.d = v.d AND m.i = v.i WHERE v.first > e
  UNION SELECT CASE WHEN v.first > y.first THEN v.s ELSE y.s END FROM v JOIN c y ON y.s = v.d AND len(y.w) >= {LEAST_WORDS}
),
kept AS (SELECT first FROM c WHERE s NOT IN (SELECT s FROM near))
SELECT doc_id, CAST(count(*) FILTER (s <> '') AS INTEGER) AS n_lines, CAST(count(first) AS INTEGER) AS n_kept,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (s = '' OR first IS NOT NULL), '') AS clean_text
FROM k LEFT JOIN kept ON first = place GROUP BY doc_id
"""

ORACLE_SQL = {"op1_pivot_index": OP1, "op7_chat": OP7, "op8_url_filter": OP8, "op9_warc": OP9, "op10_line_dedup": OP10}
