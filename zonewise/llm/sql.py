"""DuckDB SQL for the operators that SQL can express, over the tables' whole rows."""

from __future__ import annotations

OP1 = """
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS turn, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS lim FROM r),
b AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
  sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM w),
c AS (SELECT *, lim::DOUBLE * weights <= (total - below)::DOUBLE * weight AS stopped FROM b),
e AS (SELECT *, (total - coalesce(sum(lim) FILTER (stopped) OVER (), 0))::BIGINT AS rest, (sum(weight) FILTER (NOT stopped) OVER ())::BIGINT AS open_weights FROM c),
t AS (SELECT source, source_size, rank, coalesce(CASE WHEN stopped THEN lim::DOUBLE ELSE (rest * weight)::DOUBLE / open_weights END, 0.0) AS target FROM e),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + d.size / 2 AS half
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size = 0 OR half > target THEN 0 WHEN half + source_size > target THEN 1 WHEN half + 2 * source_size > target THEN 2 ELSE 3 END AS copies FROM p),
u AS (SELECT *, CASE WHEN copies > 0 THEN half / target END AS u FROM k)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
  CASE rank % 3
    WHEN 0 THEN 0.0::DOUBLE + 2 * u / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
    WHEN 1 THEN CASE WHEN u < 0.625 THEN 0.0::DOUBLE + 2 * u / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * u)) ELSE 0.5::DOUBLE + 2 * (u - 0.625::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE - 2 * (u - 0.625::DOUBLE))) END
    ELSE CASE WHEN u < 0.375 THEN 0.0::DOUBLE + 2 * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * u)) ELSE 0.5::DOUBLE + 2 * (u - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2 * (u - 0.375::DOUBLE))) END
  END AS first_position
FROM u
"""

OP10 = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)),
hit AS (SELECT r, i, k, item_id FROM dwin JOIN win USING (k, s)),
nh AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS at FROM hit) GROUP BY r),
ni AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

#: The table holds no tool calls; should one turn up, this SQL fails rather than pass it over.
OP2 = """
WITH c AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*\\{') AND json_valid(text) THEN
  CASE WHEN json_exists(text, '$.tool_call_id') OR json_array_length(text, '$.tool_calls') > 0 THEN error('tool calls are not in this SQL') END END AS checked FROM conversations)
SELECT conv_id, turn, role, turn AS anchor, 0 AS depth, 0::BIGINT AS n_calls, coalesce(checked, '') AS status,
  CASE WHEN text IS NULL AND role IS NULL THEN '{}' WHEN text IS NULL THEN to_json({'role': role})::VARCHAR WHEN role IS NULL THEN to_json({'content': text})::VARCHAR ELSE to_json({'content': text, 'role': role})::VARCHAR END AS json
FROM c
"""

#: The conversations that ``queries.with_tools`` makes: links, cycles and the order's keys over all paths.
TOOL_CALLS = """
WITH RECURSIVE m AS (SELECT conv_id, turn, text, role AS was, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role,
  coalesce(role = 'assistant', false) AS is_call, coalesce(role = 'user' AND turn > 0, false) AS is_result,
  CASE WHEN conv_id % 5 = 2 THEN 'c' ELSE 'c' || (CASE WHEN role = 'assistant' THEN turn WHEN conv_id % 6 = 0 THEN turn + 1 ELSE turn - 1 END) END AS id,
  CASE WHEN conv_id % 5 <> 3 THEN text || CASE WHEN conv_id % 5 = 4 THEN ' ${c' || (turn - 2) || '}' ELSE '' END || CASE WHEN conv_id % 11 = 3 THEN ' ${c' || turn || '}' ELSE '' END END AS query,
  CASE WHEN conv_id % 5 = 0 THEN 0 ELSE turn + 1 END AS lim FROM conversations),
owner AS (SELECT conv_id, id, min(turn) AS turn FROM m WHERE is_call GROUP BY ALL),
answer AS (SELECT conv_id, id, min(turn) AS turn FROM m WHERE is_result GROUP BY ALL),
asked AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(query, '\\$\\{([^}]+)\\}', 1))) AS id FROM m WHERE is_call),
e AS (SELECT m.conv_id, o.turn AS b, m.turn AS a FROM m JOIN owner o USING (conv_id, id) WHERE is_result
  UNION SELECT s.conv_id, w.turn, s.turn FROM asked s JOIN answer w USING (conv_id, id)),
reach AS (SELECT conv_id, b, a FROM e UNION SELECT r.conv_id, r.b, e.a FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.b = r.a),
cyc AS (SELECT DISTINCT r.conv_id, r.a AS turn FROM reach r JOIN reach s ON s.conv_id = r.conv_id AND s.b = s.a AND s.a = r.b),
free AS (SELECT conv_id, turn FROM m ANTI JOIN cyc USING (conv_id, turn)),
path AS (SELECT conv_id, turn, turn AS anchor, 0 AS depth FROM free
  UNION SELECT p.conv_id, f.turn, greatest(f.turn, p.anchor), CASE WHEN f.turn > p.anchor THEN 0 ELSE p.depth + 1 END
  FROM path p JOIN e ON e.conv_id = p.conv_id AND e.b = p.turn JOIN free f ON f.conv_id = e.conv_id AND f.turn = e.a),
best AS (SELECT conv_id, turn, max({'a': anchor, 'd': depth}) AS k FROM path GROUP BY ALL),
n AS (SELECT m.*, o.turn AS first_turn, w.turn AS answered, c.turn IS NOT NULL AS cyclic FROM m LEFT JOIN owner o USING (conv_id, id) LEFT JOIN answer w USING (conv_id, id) LEFT JOIN cyc c ON c.conv_id = m.conv_id AND c.turn = m.turn),
s AS (SELECT *, list_sort(list_filter([
    CASE WHEN is_call AND conv_id % 5 = 1 THEN id || ':unknown_tool' END,
    CASE WHEN is_call AND conv_id % 5 <> 1 AND query IS NULL THEN id || ':missing:query' END,
    CASE WHEN is_call AND conv_id % 5 <> 1 AND lim < 1 THEN id || ':range:limit' END,
    CASE WHEN is_call AND first_turn <> turn THEN id || ':duplicate_id' WHEN is_call AND answered IS NULL THEN id || ':unanswered' END,
    CASE WHEN is_result AND first_turn IS NULL THEN id || ':unlinked' END], lambda x: x IS NOT NULL)) AS found FROM n)
SELECT conv_id, turn, role, coalesce(k.a, turn) AS anchor, coalesce(k.d, 0)::INT AS depth, is_call::BIGINT AS n_calls,
  array_to_string(CASE WHEN cyclic THEN found || ['cyclic'] ELSE found END, ',') AS status,
  CASE WHEN is_call THEN '{"role":"assistant","tool_calls":[{"arguments":{"limit":' || lim || CASE WHEN query IS NULL THEN '' ELSE ',"query":' || to_json(query)::VARCHAR END
      || '},"id":' || to_json(id)::VARCHAR || ',"name":"' || CASE WHEN conv_id % 5 = 1 THEN 'lookup' ELSE 'search' END || '"}]}'
    WHEN is_result THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR || ',' END || '"role":"tool","tool_call_id":' || to_json(id)::VARCHAR || '}'
    ELSE '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR END || CASE WHEN text IS NULL OR role IS NULL THEN '' ELSE ',' END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role)::VARCHAR END || '}' END AS json
FROM s LEFT JOIN best USING (conv_id, turn)
"""

ORACLES = {"op1_mix": OP1, "op2_chat_format": OP2, "chat_tool_calls": TOOL_CALLS, "op10_decontaminate": OP10}
