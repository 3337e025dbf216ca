"""DuckDB SQL for the registered queries, over the same Parquet tables.

The SQL is written on its own terms: RE2 has no look-ahead and no Unicode word
boundary, so streets are normalized by a pattern for the forms that the inputs take.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

WORDS = ("городской округ", "город. округ", "г.о.", "г.о", "муниципальный округ", "муниципальный район", "поселение", "пгт", "посёлок", "поселок", "село", "деревня", "город", "г.", "пос.", "с.", "д.", "п.", "обл.", "обл")


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def street(x: str) -> str:
    kinds = "улица|ул|проспект|пр-кт|переулок|пер|шоссе|набережная|наб"
    return strip(squeeze(rf"regexp_replace(lower({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}), '(^|\s)({kinds})\.?($|\s)', ' ', 'g')"))


def locality(x: str) -> str:
    out = rf"regexp_replace(lower({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}), '^[а-яё\- ]+\s+(обл|область|край|респ|республика)[.,]?\s*', '')"
    for w in WORDS:
        out = f"replace({out}, '{w}', ' ')"
    out = rf"regexp_replace(regexp_replace({out}, '[,;]', ' ', 'g'), '(^|\s)[гсдп](\s)', '\1\2', 'g')"
    return strip(squeeze(out))


def key(x: str) -> str:
    return f"replace({locality(x)}, 'ё', 'е')"


def keys_match(a: str, b: str) -> str:
    size = f"greatest(4, len({a}) - 2, len({b}) - 2)"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR ({size} <= least(len({a}), len({b})) AND left({a}, {size}) = left({b}, {size}))))"


def house(x: str) -> str:
    return strip(f"replace(lower(coalesce({x}, '')), ' ', '')")


def number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(coalesce({x}, ''), '[0-9]+'), '') AS INT)"


def number_list(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split(coalesce({x}, ''), ','), lambda i: trim(i) <> ''), lambda i: {house('i')}))"


def covers(h: str, r: str) -> str:
    """Whether the rule with prefix r covers house h."""
    n, t = number(h), house(h)
    return f"""CASE WHEN list_contains({number_list(f'{r}exceptions')}, {t}) THEN false
    WHEN lower(trim(coalesce({r}house_rule_raw, ''))) IN ('все', 'все дома') OR {r}rule_type = 'all' THEN true
    WHEN list_contains({number_list(f'{r}house_numbers')}, {t}) OR list_contains({number_list(f'{r}house_number')}, {t}) THEN true
    WHEN {n} IS NULL THEN false WHEN {r}parity = 'even' AND {n} % 2 <> 0 THEN false WHEN {r}parity = 'odd' AND {n} % 2 = 0 THEN false
    WHEN {r}rule_type = 'up_to' AND {r}house_to IS NOT NULL THEN {n} <= {r}house_to WHEN {r}rule_type = 'from_to_end' AND {r}house_from IS NOT NULL THEN {n} >= {r}house_from
    WHEN {r}house_from IS NOT NULL AND {r}house_to IS NOT NULL THEN {n} BETWEEN {r}house_from AND {r}house_to ELSE false END"""


def by(k: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


BASE = """WITH municipalities AS (SELECT n_nationkey::BIGINT AS id, n_nationkey || '_' || lower(r_name) AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
schools AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS municipality_id, s_name AS name, NULL::VARCHAR AS address FROM supplier),
decrees AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS municipality_id, 'D-' || n_nationkey AS number, '06.03.2025' AS date FROM nation),
owner AS (SELECT l_partkey, min(l_suppkey) AS school_id FROM lineitem GROUP BY l_partkey),
based AS (SELECT p.*, o.school_id, s.municipality_id, m.name AS town, CASE p_type WHEN 'ECONOMY' THEN 'range' WHEN 'LARGE' THEN 'up_to' WHEN 'MEDIUM' THEN 'from_to_end' WHEN 'PROMO' THEN 'exact_list' WHEN 'SMALL' THEN 'all' WHEN 'STANDARD' THEN 'all_except' END AS kind
  FROM part p JOIN owner o ON p_partkey = l_partkey JOIN schools s ON s.id = o.school_id JOIN municipalities m ON m.id = s.municipality_id),
rules AS (SELECT p_partkey AS id, school_id, municipality_id AS decree_id, CASE WHEN p_partkey % 3 = 0 THEN town || 'n' END AS locality,
  CASE p_partkey % 4 WHEN 0 THEN 'ул. ' WHEN 1 THEN 'пр-кт ' WHEN 2 THEN 'Шоссе ' ELSE '' END || p_name AS street,
  CASE kind WHEN 'range' THEN p_size || '-' || (p_size + 10) WHEN 'up_to' THEN 'до дома ' || (p_size + 10) WHEN 'from_to_end' THEN 'начиная с дома ' || p_size WHEN 'exact_list' THEN p_size || ',' || (p_size + 1) || 'а' WHEN 'all' THEN 'все' ELSE 'кроме д.' || p_size END
    || CASE WHEN kind IN ('all', 'all_except') THEN '' WHEN p_partkey % 5 = 0 THEN ' (четные)' WHEN p_partkey % 5 = 1 THEN ' (нечетные)' ELSE '' END AS house_rule_raw,
  kind AS rule_type, CASE p_partkey % 5 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' ELSE 'all' END AS parity,
  CASE WHEN kind IN ('range', 'from_to_end') THEN p_size END AS house_from, CASE WHEN kind IN ('range', 'up_to') THEN p_size + 10 END AS house_to,
  CASE WHEN kind = 'exact_list' THEN p_size || ',' || (p_size + 1) || 'а' END AS house_number, NULL::VARCHAR AS house_numbers, CASE WHEN kind IN ('all', 'all_except') THEN p_size::VARCHAR END AS exceptions FROM based),
addresses AS (SELECT o_orderkey AS address_id, m.name AS locality, 'ул ' || p_name AS street, (o_orderkey % 60 + 1) || CASE WHEN o_orderkey % 7 = 0 THEN 'а' ELSE '' END AS house
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN municipalities m ON m.id = c_nationkey JOIN part ON p_partkey = o_orderkey % 200)
"""

FOUND = f""",
sides AS (SELECT r.id AS rule_id, {street("r.street")} AS k, CASE WHEN coalesce(r.locality, '') <> '' THEN {key("r.locality")} ELSE '' END AS own, CASE WHEN coalesce(m.name, '') <> '' THEN {key("m.name")} ELSE '' END AS town,
  coalesce(r.locality, '') = '' AND coalesce(m.name, '') = '' AS anywhere, r.* EXCLUDE (id) FROM rules r LEFT JOIN schools s ON r.school_id = s.id LEFT JOIN municipalities m ON s.municipality_id = m.id),
targets AS (SELECT *, {street("street")} AS k, {key("locality")} AS place FROM wanted),
found AS (SELECT address_id, min(rule_id) AS rule_id FROM targets t JOIN sides s ON t.k = s.k
  WHERE (place = '' OR anywhere OR {keys_match("own", "place")} OR {keys_match("town", "place")}) AND {covers("t.house", "s.")} GROUP BY address_id)
"""
FIND = f"{BASE}, wanted AS (SELECT * FROM addresses){FOUND}"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("scan_rules", f"{BASE} SELECT * FROM rules")
oracle("rule_by_id", f"{BASE} SELECT * FROM rules WHERE id = 7")
oracle("ocr_routing", f"SELECT doc_id, CASE WHEN len({strip('text')}) >= 500 THEN 'native' ELSE 'ocr' END AS route, md5(CASE WHEN len({strip('text')}) >= 500 THEN text ELSE 'ocr ' || doc_id END) AS text_md5 FROM documents")
oracle("format_dispatch", f"WITH p AS (SELECT o_orderkey, lower({by('o_orderkey', *[repr(x) for x in ('.docx', '.PDF', '.doc', '.txt')])}) AS suffix FROM orders) SELECT o_orderkey, suffix, CASE WHEN suffix IN ('.docx', '.pdf', '.doc') THEN substr(suffix, 2) ELSE 'unsupported' END AS reader FROM p")
RECORDS = "WITH rec AS (SELECT DISTINCT l_orderkey::VARCHAR AS doc_id, l_linenumber AS page, (l_partkey % 4)::INT AS setting, (l_partkey % 5)::INT AS table_ix, l_suppkey::INT AS record_ix, CASE WHEN l_returnflag = 'R' THEN 'без имени ' || l_linenumber ELSE 'учреждение № ' || (l_suppkey % 7) END AS school_name, repeat('ул. ', l_quantity::INT) AS territory_text FROM lineitem)"
SCORED = f"{RECORDS}, sc AS (SELECT doc_id, page, setting, sum(CASE WHEN school_name LIKE '%учреждение%' THEN len(territory_text) ELSE 0 END)::BIGINT AS score FROM rec GROUP BY ALL)"
oracle("extraction_score", f"{SCORED} SELECT * FROM sc")
oracle("best_extraction_per_page", f"{SCORED}, best AS (SELECT doc_id, page, setting FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, setting) = 1) SELECT doc_id, page, setting, table_ix, record_ix, school_name, territory_text FROM rec SEMI JOIN best USING (doc_id, page, setting)")
oracle("meaningful_rows", f"{RECORDS} SELECT * FROM rec WHERE len(territory_text) >= 10 AND school_name LIKE '%учреждение%'")
oracle("dedupe_schools", f"{RECORDS} SELECT doc_id, school_name, territory_text FROM rec QUALIFY row_number() OVER (PARTITION BY doc_id, school_name ORDER BY len(territory_text) DESC, page, table_ix, record_ix) = 1")
oracle("engine_choice", "WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey) SELECT o_custkey AS doc_id, CASE WHEN a < 3 AND b > a THEN 'second' ELSE 'first' END AS engine FROM c")
oracle("zip_columns", """WITH p AS (SELECT *, (p_partkey % 3 + 1)::INT AS page FROM part) SELECT p_partkey::VARCHAR AS doc_id, page, 0 AS record_ix, 'МАОУ «Школа № ' || p_size || '»' AS school_name, 'ул. ' || p_name || ' дома 1, 2, 3, 4, 5, 6' AS territory_text FROM p WHERE page > 1
UNION ALL SELECT p_partkey::VARCHAR, page, 1, 'МБОУ «Лицей № ' || p_partkey || '»', 'проспект ' || p_name || ' дома 10, 12, 14, 16' FROM p WHERE page > 1""")
oracle("ocr_response_text", """WITH j AS (SELECT o_orderkey, '{"IsErroredOnProcessing": ' || CASE o_orderkey % 3 WHEN 2 THEN 'true' ELSE 'false' END || ', "ParsedResults": [{"ParsedText": "стр ' || o_custkey || '"}, {"ParsedText": ""}, {"ParsedText": "' || o_orderstatus || '"}]}' AS r FROM orders)
SELECT o_orderkey, CASE WHEN json_extract_string(r, '$.IsErroredOnProcessing') = 'false' THEN array_to_string(list_filter(json_extract_string(r, '$.ParsedResults[*].ParsedText'), lambda x: x <> ''), chr(10) || chr(10)) END AS text FROM j""")
oracle("suggest_projection", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), 'п ' || c_nationkey) AS city, c_name AS value FROM customer")
oracle("text_preview", "SELECT doc_id, left(text, 8000) AS preview FROM documents")
oracle("street_match", f"{BASE}, a AS (SELECT {street('street')} AS street, count(*) AS n_addresses FROM addresses GROUP BY 1), r AS (SELECT {street('street')} AS street, count(*) AS n_rules FROM rules GROUP BY 1) SELECT * FROM a JOIN r USING (street)")
HOUSES = f"{BASE}, h AS (SELECT l_orderkey, (l_orderkey % 60 + 1) || {by('l_orderkey', repr(''), repr('А'), repr(' а'), repr('/2'))} AS house, rules.* FROM lineitem JOIN rules ON l_partkey = rules.id)"
oracle("house_matches", f"{HOUSES} SELECT l_orderkey, id, house, {covers('house', '')} AS covered FROM h")
oracle("house_number", f"{HOUSES} SELECT l_orderkey, id, {number('CASE WHEN l_orderkey % 9 = 0 THEN ' + repr('нет') + ' ELSE house END')} AS number, {house('house')} AS house FROM h")
TOWNS = f"{BASE}, t AS (SELECT c_custkey, {by('c_custkey', 'm.name', repr('г. ') + ' || m.name', 'm.name || ' + repr('ы'), repr(''))} AS a, {by('c_custkey', 'n.name', 'm.name', repr('Московская обл, г ') + ' || m.name')} AS b FROM customer JOIN municipalities m ON c_nationkey = m.id JOIN municipalities n ON c_custkey % 25 = n.id)"
oracle("locality_match", f"{TOWNS} SELECT c_custkey, {keys_match('ka', 'kb')} AS matches FROM (SELECT c_custkey, {key('a')} AS ka, {key('b')} AS kb FROM t)")
oracle("normalize_locality", f"{TOWNS} SELECT c_custkey, {locality('a')} AS a, {locality('b')} AS b FROM t")
oracle("locality_applicable", f"""{BASE}, t AS (SELECT r.id, CASE WHEN r.id % 10 = 0 THEN '' ELSE x.name END AS target, r.locality, m.name AS town FROM rules r JOIN schools s ON s.id = r.school_id LEFT JOIN municipalities m ON m.id = s.municipality_id JOIN municipalities x ON x.id = r.id % 25),
k AS (SELECT *, {key('target')} AS kt, {key('locality')} AS kl, {key('town')} AS kn FROM t) SELECT id, target = '' OR {keys_match('kl', 'kt')} OR {keys_match('kn', 'kt')} AS applicable FROM k""")
oracle("header_rows", "SELECT p_partkey AS id, p_partkey % 10 = 0 AS header FROM part")
oracle("street_like", f"SELECT p_partkey, len({strip('x')}) BETWEEN 2 AND 80 AND lower({strip('x')}) NOT IN ('улица', 'ул.', 'район', '—', '-') AS street_like FROM (SELECT p_partkey, {by('p_partkey', 'p_name', repr('ул.'), repr(' Район '), 'repeat(p_name, 12)', repr('—'), 'left(p_name, 1)')} AS x FROM part)")
oracle("same_school", """WITH p AS (SELECT p_partkey, 'МАОУ «Школа № ' || p_size || '»' AS a, CASE p_partkey % 5 WHEN 0 THEN 'МАОУ «Школа № ' || p_size || '»' WHEN 1 THEN '«школа № ' || p_size || '» г. Пермь' WHEN 2 THEN '«Школа № ' || (p_size + 1) || '»' WHEN 3 THEN 'АНО «ШКОЛА № ' || p_size || '»' ELSE '' END AS b FROM part)
SELECT p_partkey, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR lower(regexp_extract(a, '(?i)«[^»]*школа[^»]*»')) = lower(regexp_extract(b, '(?i)«[^»]*школа[^»]*»'))) AS same FROM p""")
oracle("school_cells", """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'МАОУ «Школа № ' || p_size || '»' WHEN 1 THEN 'Наименование «Школа № ' || p_size || '»' WHEN 2 THEN 'Муниципальное учреждение ' || p_name WHEN 3 THEN 'Муниципальное ' || repeat(p_name, 40) ELSE p_name END AS x FROM part)
SELECT p_partkey, len(x) <= 600 AND NOT contains(x, 'Наименование') AND (regexp_matches(x, '(?i)«[^»]*школа[^»]*»') OR (regexp_matches(x, '(?i)^(муниципальн|маоу)') AND len(x) < 250)) AS school_cell, regexp_matches(x, '(?i)«[^»]*школа[^»]*»') OR regexp_matches(x, '(?i)^(муниципальн|маоу)') AS school_or_prefix FROM p""")
oracle("territory_cells", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 4) AS territory FROM part")
oracle("numbered_school_rows", "SELECT p_partkey, p_partkey % 3 < 2 AND p_size % 2 = 0 AS numbered FROM part")
oracle("droppable_rules", f"""{BASE}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN street ELSE ' ' END AS st, {by('id', repr(''), repr(' '), 'house_rule_raw')} AS raw, CASE WHEN id % 5 = 0 THEN 'all' ELSE 'range' END AS kind FROM rules)
SELECT id, trim(st) = '' OR (trim(coalesce(raw, '')) = '' AND coalesce(house_number, '') = '' AND coalesce(house_from, 0) = 0 AND coalesce(house_to, 0) = 0 AND kind <> 'all') AS droppable FROM x""")
MARKERS = ("timeout", "timed out", "429", "too many requests", "500", "502", "503", "504", "connection", "reset by peer", "disconnect", "ssl", "unexpected_eof", "handshake", "eof occurred", "protocol")
oracle("transient_errors", f"WITH x AS (SELECT event_id, lower({by('event_id', repr('HTTP ') + ' || (user_id % 7 + 498)', repr('Read timed out'), repr('bad JSON ') + ' || event_type', repr('SSL: UNEXPECTED_EOF'), repr('Connection reset by peer'))}) AS e FROM events) SELECT event_id, {' OR '.join(f'contains(e, {m!r})' for m in MARKERS)} AS transient FROM x")
oracle("rules_by_street", f"{BASE} SELECT id, street, house_rule_raw, parity, house_from, house_to FROM rules WHERE contains({street('street')}, 'red')")
oracle("rules_by_school", f"{BASE} SELECT r.id, s.name AS school_name, r.street, r.parity FROM rules r JOIN schools s ON r.school_id = s.id WHERE contains(lower(s.name), lower('SUPPLIER#00000001'))")
oracle("normalize_street", f"SELECT p_partkey, {street('x')} AS street FROM (SELECT p_partkey, {by('p_partkey', 'p_name', repr('ул. ') + ' || p_name', repr('Проспект  ') + ' || p_name', 'p_name || ' + repr(' улица'), repr('пр-кт ') + ' || p_name', repr(' наб. ') + ' || upper(p_name)', 'p_name || ' + repr(' шоссе'), repr(''))} AS x FROM part)")
oracle("house_list", f"SELECT p_partkey, p_size || '|' || (p_size + 1) || 'а' AS houses FROM part")
oracle("parse_address", f"{BASE} SELECT address_id, locality AS city, regexp_replace(street, '^ул ', '') AS street, house FROM addresses")
oracle("clean_cell", "SELECT p_partkey, p_name || ' ' || p_brand AS cell FROM part")
oracle("merge_cells", "SELECT p_partkey, p_name || CASE WHEN contains(p_name, p_brand) THEN '' ELSE ' ' || p_brand END AS row FROM part")
oracle("street_aliases", "SELECT p_partkey, 0 AS ix, p_name AS street FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, 1, p_brand FROM part WHERE p_partkey % 4 = 1")
oracle("parse_ranges", r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' - ' || (p_size + 8) WHEN 1 THEN p_size || '–' || p_partkey WHEN 2 THEN p_size::VARCHAR ELSE p_size || 'а-7' END AS t FROM part)
SELECT p_partkey, regexp_matches(t, '^\s*\d+\s*[-–]\s*\d+\s*$') AS is_range, TRY_CAST(nullif(regexp_extract(t, '^\s*(\d+)\s*[-–]\s*(\d+)\s*$', 1), '') AS INT) AS house_from, TRY_CAST(nullif(regexp_extract(t, '^\s*(\d+)\s*[-–]\s*(\d+)\s*$', 2), '') AS INT) AS house_to FROM x""")
oracle("house_tokens", r"SELECT p_partkey, array_to_string(regexp_extract_all('д. ' || p_size || 'а, ' || p_size || '/3; ' || p_partkey || '-' || p_size || 'ё', '\d+[а-яА-Яa-zA-Z]?(?:/\d+)?'), '|') AS tokens FROM part")


def parity(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, 'неч[её]т') AND regexp_matches(regexp_replace({x}, 'неч[её]т', '', 'g'), 'ч[её]т') THEN 'all' WHEN regexp_matches({x}, 'неч[её]т') THEN 'odd' WHEN regexp_matches({x}, 'ч[её]т') THEN 'even' END"


oracle("detect_parity", f"SELECT p_partkey, {parity('lower(x)')} AS parity FROM (SELECT p_partkey, {by('p_partkey', repr('Четные дома'), 'p_size || ' + repr(' (нечётные)'), repr('четные и нечетные'), 'p_name', repr('чётные'))} AS x FROM part)")
RAW = f"""{BASE}, raw AS (SELECT id, school_id, decree_id, locality, CASE WHEN id % 17 = 0 THEN '  ' ELSE street END AS street, CASE WHEN id % 13 = 0 THEN '  ' ELSE house_rule_raw END AS house_rule_raw, CASE WHEN id % 3 = 0 THEN NULL ELSE 'unknown' END AS parity FROM rules),
low AS (SELECT *, lower(coalesce(house_rule_raw, '')) AS w FROM raw),
marks AS (SELECT *, {parity('w')} AS said, regexp_extract(w, '(начиная с|от дома|от)\\s*(?:дома|д\\.)?\\s*(\\d+)', 2) AS f, regexp_extract(w, 'до\\s*(?:дома|д\\.)?\\s*(\\d+)', 1) AS u, regexp_extract_all(w, 'кроме\\s*(?:домов|дома|д\\.)?\\s*([\\d,\\sа-яА-Яa-zA-Z/]+)', 1) AS e,
  regexp_extract(w, '(\\d+)\\s*[-–]\\s*(\\d+)', 1) AS r1, regexp_extract(w, '(\\d+)\\s*[-–]\\s*(\\d+)', 2) AS r2, regexp_extract_all(w, '\\d+[а-яА-Яa-zA-Z]?(?:/\\d+)?') AS toks FROM low),
n AS (SELECT id, CASE WHEN f <> '' THEN 'from_to_end' WHEN u <> '' THEN 'up_to' WHEN len(e) > 0 THEN 'all_except' WHEN r1 <> '' THEN 'range' WHEN len(toks) > 0 AND contains(w, ',') THEN 'exact_list' WHEN w IN ('', 'все', 'все дома') THEN 'all' END AS rule_type,
  coalesce(said, parity) AS parity, CASE WHEN f <> '' THEN f::INT WHEN u <> '' OR len(e) > 0 THEN NULL WHEN r1 <> '' THEN r1::INT END AS house_from, CASE WHEN f <> '' THEN NULL WHEN u <> '' THEN u::INT WHEN len(e) > 0 THEN NULL WHEN r1 <> '' THEN r2::INT END AS house_to,
  CASE WHEN f = '' AND u = '' AND len(e) = 0 AND r1 = '' AND len(toks) > 0 AND contains(w, ',') THEN array_to_string(toks, ',') END AS house_numbers,
  CASE WHEN f = '' AND u = '' AND len(e) > 0 THEN array_to_string(flatten(list_transform(e, lambda x: regexp_extract_all(x, '\\d+[а-яА-Яa-zA-Z]?(?:/\\d+)?'))), ',') END AS exceptions FROM marks)"""
oracle("normalize_rules", f"{RAW} SELECT * FROM n")
BUILT = f"""{RAW}, built AS (SELECT r.id, r.school_id, r.decree_id, r.locality, trim(replace(replace(trim(r.street), 'ул. ', ''), 'пр-кт ', '')) AS street, trim(r.house_rule_raw) AS house_rule_raw, CASE WHEN n.parity IN ('all', 'even', 'odd', 'mixed', 'unknown') THEN n.parity ELSE 'unknown' END AS parity,
  coalesce(n.rule_type, 'unknown') AS rule_type, n.house_from, n.house_to, NULL::VARCHAR AS house_number, n.house_numbers, n.exceptions FROM raw r JOIN n USING (id)
  WHERE trim(r.street) <> '' AND NOT (trim(r.house_rule_raw) = '' AND n.house_from IS NULL AND n.house_to IS NULL AND coalesce(n.rule_type, '') <> 'all'))"""
oracle("build_rules", f"{BUILT} SELECT * EXCLUDE (school_id, decree_id), {street('street')} AS normalized_street FROM built")
oracle("sanitize_address", r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'г. Пермь, ул. ' || p_name || ', д. ' || p_size WHEN 1 THEN 'ул. ' || p_name || ', ' || p_size || ', 6' WHEN 2 THEN 'мкр. ' || p_name WHEN 3 THEN p_name || '; ' || p_size WHEN 4 THEN 'ул. A, д. ' || p_size || ', корп. 2' WHEN 5 THEN 'ул. A, ул. ' || p_name WHEN 6 THEN ' ' WHEN 7 THEN repeat(p_name, 30) ELSE p_size || ' 1 2' END AS t FROM part),
y AS (SELECT p_partkey, trim(t) AS t, len(regexp_extract_all(t, '\d+')) AS n FROM x)
SELECT p_partkey, CASE WHEN t = '' OR len(t) > 200 OR contains(t, ';') OR len(regexp_extract_all(lower(t), 'ул\.')) >= 2 OR contains(lower(t), 'мкр.') OR n > 2 OR (n >= 2 AND NOT regexp_matches(lower(t), '(^|[^а-яё])(д\.\s*\d|корп\.|стр\.)') AND NOT regexp_matches(lower(t), '(^|[^а-яё])(г\.|пос\.)|город|посёлок|поселок')) THEN NULL ELSE t END AS address FROM y""")
oracle("normalize_values", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'unknown' ELSE 'mixed' END AS parity, CASE p_partkey % 2 WHEN 0 THEN 'range' ELSE 'unknown' END AS rule_type,
CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 3 THEN 17 END AS n, p_size || ',' || p_brand AS items FROM part""")
oracle("street_keys", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'березовая ' || lower(p_name) ELSE lower(p_name) END AS street_key FROM part")
oracle("clean_street", f"{BASE} SELECT id, trim(replace(replace(street, 'ул. ', ''), 'пр-кт ', '')) AS street FROM rules")
oracle("decree_metadata", """SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey || '-п' ELSE '' END AS number, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d') || '.04.' || strftime(o_orderdate, '%Y') ELSE '' END AS date,
CASE o_orderkey % 3 WHEN 0 THEN 'Перми' WHEN 1 THEN 'Балашиха' ELSE 'Пушкинский' END AS municipality FROM orders""")
for name in ("number", "date", "municipality"):
    oracle(name if name == "municipality" else f"decree_{name}", f"SELECT doc_id, {name} FROM ({ORACLES['decree_metadata']})")
REPLIES = """WITH b AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::INT AS chunk, o_orderkey, o_custkey, '{"decree": {"number": "' || o_custkey || '", "date": null, "extra": 1}, "schools": [{"name": " СОШ № ' || o_custkey || ' ", "address": null, "rules": [{"street": "Мира", "house_rule_raw": null, "parity": "' || CASE o_orderkey % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'weird' ELSE 'all' END
|| '", "house_from": "' || o_custkey || '", "house_to": ' || CASE o_orderkey % 3 WHEN 0 THEN '"abc"' WHEN 1 THEN '17' ELSE 'null' END || ', "house_number": ' || CASE o_orderkey % 3 WHEN 0 THEN '["1", "2а", ""]' WHEN 1 THEN '"5"' ELSE 'null' END || ', },]}, ]}' AS body FROM orders),
c AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Вот ответ: ' || body || ' Готово.' WHEN 4 THEN 'ответа нет' ELSE body END AS content FROM b),
j AS (SELECT *, nullif(regexp_extract(replace(replace(trim(content), '```json', ''), '```', ''), '(?s)\\{.*\\}'), '') AS block FROM c),
r AS (SELECT *, regexp_replace(regexp_replace(block, ',\\s*}', '}', 'g'), ',\\s*]', ']', 'g') AS json FROM j)"""
oracle("json_repair", f"{REPLIES} SELECT doc_id, chunk, json, json IS NULL OR NOT json_valid(json) AS failed FROM r")
oracle("coerce_rules", f"""{REPLIES} SELECT doc_id, chunk, 0 AS school_ix, trim(json->>'$.schools[0].name') AS school_name, coalesce(json->>'$.schools[0].address', '') AS school_address, 0 AS rule_ix, '' AS locality, json->>'$.schools[0].rules[0].street' AS street, '' AS house_rule_raw,
CASE WHEN json->>'$.schools[0].rules[0].parity' IN ('all', 'even', 'odd', 'mixed', 'unknown') THEN json->>'$.schools[0].rules[0].parity' ELSE 'unknown' END AS parity, TRY_CAST(json->>'$.schools[0].rules[0].house_from' AS INT) AS house_from, TRY_CAST(json->>'$.schools[0].rules[0].house_to' AS INT) AS house_to,
CASE o_orderkey % 3 WHEN 0 THEN array_to_string(list_filter(json->>'$.schools[0].rules[0].house_number[*]', lambda x: x <> ''), ',') ELSE json->>'$.schools[0].rules[0].house_number' END AS house_number, '' AS comment FROM r WHERE json IS NOT NULL""")
oracle("flatten_decree", f"SELECT doc_id, chunk, school_ix, school_name, rule_ix, street FROM ({ORACLES['coerce_rules']})")
oracle("json_parse", f"""{REPLIES} SELECT doc_id, chunk, json IS NOT NULL AND json_valid(json) AS ok, CASE WHEN json_valid(json) THEN json->>'$.decree.number' END AS number, CASE WHEN json_valid(json) THEN json_array_length(json, '$.schools')::INT END AS n_schools FROM r""")
oracle("bad_replies", f"{REPLIES} SELECT doc_id, chunk, 'no_json' AS error, left(content, 500) AS preview FROM r WHERE json IS NULL")
oracle("classify_reply", "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'plain_text_list' ELSE 'unknown' END AS document_type, 0.5::DOUBLE AS confidence, o_orderstatus AS reason FROM orders")
oracle("prompts", "SELECT doc_id, 'Разбери текст:' || chr(10) || left(text, 4000) || chr(10) || 'Верни JSON.' AS prompt FROM documents")
oracle("find_school", f"{FIND} SELECT * FROM found")
oracle("search_result", f"{FIND} SELECT address_id, rule_id, coalesce(s.name, '—') AS school_name, s.address AS school_address, house_rule_raw, street, coalesce(d.number, '—') AS decree_number, coalesce(d.date, '—') AS decree_date FROM found JOIN rules r ON rule_id = r.id LEFT JOIN schools s ON r.school_id = s.id LEFT JOIN decrees d ON r.decree_id = d.id")
oracle("search_status", f"{BASE}, wanted AS (SELECT address_id, locality, street, CASE WHEN address_id % 50 = 0 THEN '' ELSE house END AS house FROM addresses){FOUND} SELECT address_id, CASE WHEN wanted.house = '' THEN 'incomplete' WHEN rule_id IS NULL THEN 'not_found' ELSE 'found' END AS status, CASE WHEN wanted.house = '' THEN 'Адрес распознан не полностью. Укажите улицу и дом.' END AS message FROM wanted LEFT JOIN found USING (address_id)")
oracle("search_text", f"{FIND} SELECT address_id, locality AS city, regexp_replace(street, '^ул ', '') AS street, house, rule_id FROM addresses LEFT JOIN found USING (address_id)")
oracle("check_address", f"{FIND} SELECT address_id, rule_id FROM addresses LEFT JOIN found USING (address_id) WHERE address_id % 20 <> 0")
oracle("locality_join", f"{BASE}, l AS (SELECT s.id, {key(by('s.id', 'm.name', repr('г. ') + ' || m.name || ' + repr('а')))} AS k FROM schools s JOIN municipalities m ON s.municipality_id = m.id), r AS (SELECT id, {key('name')} AS k FROM municipalities) SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r ON {keys_match('l.k', 'r.k')}")
oracle("admin_rules", f"{BASE} SELECT r.id, s.name AS school_name, d.number AS decree_number, street, house_rule_raw, rule_type, parity, house_from, house_to FROM rules r JOIN schools s ON r.school_id = s.id JOIN decrees d ON r.decree_id = d.id")
oracle("summary", f"{BASE} SELECT m.id, m.name, (SELECT count(*) FROM schools s WHERE s.municipality_id = m.id) AS schools, (SELECT count(*) FROM rules r JOIN schools s ON r.school_id = s.id WHERE s.municipality_id = m.id) AS rules FROM municipalities m")
oracle("totals", f"{BASE} SELECT 'schools' AS what, count(*) AS n FROM schools UNION ALL SELECT 'rules', count(*) FROM rules")


def numbers(r: str = "") -> str:
    listed = f"list_transform(list_filter(list_transform(string_split(coalesce({r}house_number, ''), ','), lambda i: trim(i)), lambda i: regexp_matches(i, '^[0-9]+$')), lambda i: i::INT)"
    span = f"list_filter(CASE WHEN {r}house_from <= {r}house_to THEN range({r}house_from, {r}house_to + 1)::INT[] ELSE []::INT[] END, lambda i: NOT (({r}parity = 'even' AND i % 2 <> 0) OR ({r}parity = 'odd' AND i % 2 = 0)))"
    return f"CASE WHEN lower(coalesce({r}house_rule_raw, '')) IN ('все', 'все дома') THEN range(1, 301)::INT[] ELSE list_sort(list_distinct(list_concat({listed}, {span}))) END"


oracle("rule_numbers", f"{BASE}, x AS (SELECT id, {numbers()} AS nums FROM rules) SELECT id, len(nums)::INT AS n, array_to_string(nums, ',') AS numbers FROM x")


def overlaps(table: str) -> str:
    return f"""sets AS (SELECT r.*, s.name AS school, lower(trim(coalesce(locality, ''))) || ':' || {street('street')} AS k, {numbers()} AS nums FROM {table} r LEFT JOIN schools s ON r.school_id = s.id),
pairs AS (SELECT 'error' AS level, 'intersection' AS type, 'Пересечение правил по улице ' || a.street || ': дома [' || array_to_string(list_sort(list_intersect(a.nums, b.nums))[1:10], ', ') || ']' AS message, a.id AS rule_id, b.id AS second_rule_id, coalesce(a.school, '—') AS school, coalesce(b.school, '—') AS second_school
  FROM sets a JOIN sets b ON a.k = b.k AND a.id < b.id AND a.school_id IS DISTINCT FROM b.school_id AND list_has_any(a.nums, b.nums))"""


oracle("intersections", f"{BASE}, {overlaps('rules')} SELECT * FROM pairs")
oracle("validate_rules", f"""{BASE}, changed AS (SELECT id, school_id, locality, CASE WHEN id % 50 = 0 THEN ' ' ELSE street END AS street, house_rule_raw, rule_type, CASE WHEN id % 40 = 0 THEN 'weird' ELSE parity END AS parity, CASE WHEN id % 30 = 0 THEN house_to + 5 ELSE house_from END AS house_from, house_to, house_number FROM rules),
{overlaps('changed')}
SELECT * FROM pairs
UNION ALL SELECT 'error', 'empty_street', 'У правила не указана улица', id, NULL, coalesce(school, '—'), NULL FROM sets WHERE trim(coalesce(street, '')) = ''
UNION ALL SELECT 'warning', 'empty_house_rule', 'У правила пустое описание домов', id, NULL, coalesce(school, '—'), NULL FROM sets WHERE trim(coalesce(house_rule_raw, '')) = ''
UNION ALL SELECT 'error', 'invalid_range', 'Некорректный диапазон: ' || house_from || '–' || house_to, id, NULL, coalesce(school, '—'), NULL FROM sets WHERE house_from <> 0 AND house_to <> 0 AND house_from > house_to
UNION ALL SELECT 'warning', 'unknown_parity', 'Неизвестная чётность: ' || coalesce(parity, 'None'), id, NULL, coalesce(school, '—'), NULL FROM sets WHERE parity NOT IN ('all', 'even', 'odd', 'mixed', 'unknown') OR parity IS NULL""")
oracle("merge_fallback", f"""{BASE}, x AS (SELECT school_id::VARCHAR AS doc_id, 's' AS school_name, id AS ord, street, house_rule_raw, {squeeze("replace(lower(trim(street)), 'ё', 'е')")} AS k FROM rules),
t AS (SELECT * FROM x WHERE ord % 3 > 0 AND k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY ord) = 1)
SELECT doc_id, school_name, ord, street, house_rule_raw, 'model' AS origin FROM x WHERE ord % 3 = 0 UNION ALL SELECT doc_id, school_name, ord, street, house_rule_raw, 'text' FROM t ANTI JOIN (SELECT * FROM x WHERE ord % 3 = 0) m USING (doc_id, k)""")
oracle("new_schools", f"""{BASE}, w AS (SELECT c_nationkey::BIGINT AS municipality_id, 'Supplier#' || lpad((c_custkey % 300)::VARCHAR, 9, '0') AS name, 'ул. A, д. ' || c_custkey AS address, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 300 ORDER BY c_custkey) = 1)
SELECT municipality_id, name, address FROM w ANTI JOIN schools USING (municipality_id, name)""")
TABLE = """WITH t AS (SELECT p_partkey AS id, (p_partkey % 40 + (p_partkey >> 9))::VARCHAR AS doc_id, (p_partkey >> 8)::INT AS page, ((p_partkey >> 6) % 4)::INT AS table_ix, (p_partkey % 10 + (p_partkey >> 5) % 2 * 10)::INT AS row_ix, p_partkey % 10 = 0 AS header,
CASE WHEN p_partkey % 4 = 1 THEN 'МАОУ «СОШ № ' || p_size || '»' END AS school, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' (' || upper(p_brand) || ')' ELSE p_name || ' (' || upper(p_name) || ')' END AS street,
CASE WHEN p_partkey % 11 = 3 THEN '—' ELSE p_size || ', ' || (p_size + 2) || '; ' || p_size || '-' || (p_size + 9) END AS houses FROM part),
f AS (SELECT id, doc_id, page, table_ix, row_ix, last_value(school IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, table_ix, row_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS school_name, street, houses FROM t WHERE NOT header)"""
oracle("fill_forward", f"{TABLE} SELECT * EXCLUDE (id) FROM f")
MULTI = rf"""{TABLE}, g AS (SELECT *, trim(regexp_extract(street, '^(.+?)\s*\(([^)]+)\)\s*$', 1)) AS main, trim(regexp_extract(street, '^(.+?)\s*\(([^)]+)\)\s*$', 2)) AS alias FROM f WHERE school_name IS NOT NULL AND regexp_matches(houses, '\d')),
m AS (SELECT doc_id, page, table_ix, row_ix, school_name, 0 AS alias_ix, CASE WHEN alias = '' THEN street ELSE main END AS street, houses FROM g UNION ALL SELECT doc_id, page, table_ix, row_ix, school_name, 1, alias, houses FROM g WHERE alias <> '' AND lower(alias) <> lower(main))"""
oracle("multi_column_rows", f"{MULTI} SELECT * FROM m")
oracle("rules_by_school_nested", f"{MULTI}, r AS (SELECT *, unnest(['exact_list', 'range']) AS kind, unnest([0, 1]) AS rule_ix FROM m) SELECT doc_id, school_name, count(*)::INT AS n_rules, string_agg(street || ':' || kind, '|' ORDER BY page, table_ix, row_ix, alias_ix, rule_ix) AS rules FROM r GROUP BY doc_id, school_name")
oracle("houses_to_rules", """WITH h AS (SELECT p_partkey AS id, p_size, p_partkey % 11 = 3 AS dash FROM part WHERE p_partkey % 10 <> 0)
SELECT id, 0 AS rule_ix, CASE WHEN dash THEN '—' ELSE p_size || ', ' || (p_size + 2) || '; ' || p_size || '-' || (p_size + 9) END AS house_rule_raw, NULL::INT AS house_from, NULL::INT AS house_to, CASE WHEN dash THEN '—' ELSE p_size || ',' || (p_size + 2) END AS house_number, 'exact_list' AS rule_type FROM h
UNION ALL SELECT id, 1, p_size || '-' || (p_size + 9), p_size, p_size + 9, NULL, 'range' FROM h WHERE NOT dash""")
oracle("detect_multi_column", f"""{TABLE}, x AS (SELECT doc_id, page, table_ix, bool_or(header AND row_ix < 3) AS h, bool_or(school IS NOT NULL AND NOT header) AS d, max(CASE WHEN row_ix = 0 THEN 4 END) AS wide FROM t WHERE page <= 15 AND row_ix < 5 GROUP BY ALL),
y AS (SELECT doc_id, bool_or(h) AS h, count(*) FILTER (d) AS n FROM x WHERE wide >= 4 GROUP BY doc_id) SELECT doc_id, coalesce(h OR n >= 3, false) AS multi_column FROM (SELECT DISTINCT doc_id FROM t) LEFT JOIN y USING (doc_id)""")
oracle("detect_two_column", "SELECT p_size::VARCHAR AS doc_id, bool_or(p_partkey % 7 = 0 AND p_partkey % 12 <= 10 AND p_partkey % 2 = 0) AS two_column FROM part GROUP BY p_size")
oracle("choose_strategy", "SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'multi_column_street_house' WHEN o_orderkey % 2 = 0 OR o_orderstatus = 'F' THEN 'two_column_school_territories' ELSE 'multi_column_street_house' END AS strategy FROM orders")
CHUNKS = "WITH c AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS chunk, CASE o_orderkey % 2 WHEN 0 THEN '' ELSE o_orderpriority END AS number, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS date, CASE o_orderkey % 2 WHEN 0 THEN o_orderstatus ELSE '' END AS municipality FROM orders)"
oracle("merge_chunks", f"{CHUNKS} SELECT doc_id, coalesce(arg_min(number, chunk) FILTER (number <> ''), '') AS number, coalesce(arg_min(date, chunk) FILTER (date <> ''), '') AS date, coalesce(arg_min(municipality, chunk) FILTER (municipality <> ''), '') AS municipality FROM c GROUP BY doc_id")
oracle("metadata_fill", f"{CHUNKS} SELECT chunk::VARCHAR AS doc_id, coalesce(nullif(number, ''), 'т' || chunk) AS number, coalesce(nullif(date, ''), '01.01.2000') AS date, coalesce(nullif(municipality, ''), '') AS municipality FROM c")
oracle("territory_rules", """WITH x AS (SELECT p_partkey::VARCHAR AS doc_id, 'Ивана ' || translate(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'абцдефгхийклмнопярстуввхуаАБЦДЕФГХИЙКЛМНОПЯРСТУВВХУА') AS street, p_size FROM part)
SELECT doc_id, 0 AS ix, street, p_size || ', ' || (p_size + 2) AS house_rule_raw FROM x UNION ALL SELECT doc_id, 1, 'Мира', '' FROM x UNION ALL SELECT doc_id, 2, 'Школьный', '(кроме д.' || p_size || ')' FROM x""")
oracle("split_by_size", f"WITH x AS (SELECT doc_id, {strip('substr(text, i * 4000 + 1, 4000)')} AS chunk, i FROM (SELECT doc_id, text, unnest(range(0, (len(text) + 3999) // 4000)) AS i FROM documents)), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ix FROM x WHERE chunk <> '') SELECT doc_id, ix::INT AS ix, chunk FROM y")
oracle("split_sections", f"""WITH b AS (SELECT p_partkey, p_name, trim(repeat(p_name || ' ', p_size + 20)) AS body, repeat(p_name, 600) AS big FROM part),
c AS (SELECT p_partkey, unnest(['1.', '2.1.']) || chr(10) || body AS chunk, unnest([0, 1]) AS i FROM b WHERE p_partkey % 2 = 0), k AS (SELECT * FROM c WHERE len(chunk) > 300)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INT AS ix, chunk FROM k
UNION ALL SELECT p_partkey, i::INT, trim(substr(big, i * 4000 + 1, 4000)) FROM (SELECT *, unnest(range(0, (len(big) + 3999) // 4000)) AS i FROM b WHERE p_partkey % 2 = 1)""")
oracle("verify_streets", f"""WITH g AS (SELECT DISTINCT p_name AS q, 'г X, ' || p_name AS value, CASE WHEN len(p_name) % 3 = 1 THEN CASE WHEN len(p_name) % 2 = 0 THEN 'ул ' || p_name ELSE p_name || ' новая' END END AS street FROM part WHERE len(p_name) % 3 <> 0)
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN '' END AS locality, p_name AS street, CASE WHEN g.street IS NOT NULL AND {street('g.street')} = {street('p_name')} THEN 'verified' ELSE 'needs_review' END AS validation_status,
CASE WHEN g.street IS NULL THEN 'low' WHEN {street('g.street')} = {street('p_name')} THEN 'high' ELSE 'medium' END AS dadata_confidence, g.value AS dadata_value,
CASE WHEN q IS NULL THEN 'DaData не нашла подходящую улицу' WHEN g.street IS NULL THEN 'DaData нашла адрес, но не вернула улицу' WHEN {street('g.street')} = {street('p_name')} THEN 'Улица подтверждена через DaData' ELSE 'DaData предлагает другое написание: ' || g.street END AS validation_comment
FROM part LEFT JOIN g ON q = p_name""")
oracle("update_rule", f"""{BASE} SELECT id, school_id, decree_id, locality, trim(street) AS street, CASE WHEN id % 10 = 3 THEN '1-9' ELSE house_rule_raw END AS house_rule_raw, CASE WHEN id % 10 = 3 THEN 'range' ELSE rule_type END AS rule_type, CASE WHEN id % 10 = 3 THEN 'odd' ELSE parity END AS parity,
CASE WHEN id % 10 <> 3 THEN house_from WHEN id % 2 = 0 THEN 7 END AS house_from, CASE WHEN id % 10 = 3 THEN 9 ELSE house_to END AS house_to, CASE WHEN id % 10 <> 3 THEN house_number END AS house_number, house_numbers, CASE WHEN id % 10 = 3 THEN '3' ELSE exceptions END AS exceptions FROM rules""")
oracle("delete_rule", f"{BASE} SELECT * FROM rules WHERE id % 10 <> 3")

#: Folds as recursion over a table's rows, one row a step.
oracle("process_table", """WITH RECURSIVE p AS (SELECT (p_partkey % 50)::VARCHAR AS doc_id, (p_partkey % 3)::INT AS table_ix, p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'МАОУ «Школа № ' || p_size || '»' WHEN 2 THEN '«Школа № ' || p_size || '»' END AS school, 'ул. ' || trim(p_name) || ', ' || p_size AS addition FROM part),
r AS (SELECT *, regexp_extract(lower(school), '«[^»]*»') AS quoted, row_number() OVER (PARTITION BY doc_id, table_ix ORDER BY p_partkey) AS rn FROM p),
f AS (SELECT doc_id, table_ix, rn, CASE WHEN school IS NULL THEN -1 ELSE 0 END AS record_ix, school AS name, quoted, CASE WHEN school IS NOT NULL THEN addition END AS text FROM r WHERE rn = 1
  UNION ALL SELECT doc_id, table_ix, rn, record_ix + opens::INT, CASE WHEN opens THEN school ELSE name END, CASE WHEN opens THEN quoted ELSE old_quoted END, CASE WHEN opens THEN addition WHEN name IS NULL OR contains(text, addition) THEN text ELSE trim(text || ' ' || addition) END
  FROM (SELECT r.doc_id, r.table_ix, r.rn, f.record_ix, f.name, f.text, f.quoted AS old_quoted, r.school, r.quoted, r.addition,
      r.school IS NOT NULL AND NOT coalesce(contains(f.name, r.school) OR contains(r.school, f.name) OR (f.quoted <> '' AND f.quoted = r.quoted), false) AS opens
    FROM f JOIN r ON f.doc_id = r.doc_id AND f.table_ix = r.table_ix AND r.rn = f.rn + 1))
SELECT doc_id, table_ix, record_ix::INT AS record_ix, arg_max(name, rn) AS school_name, arg_max(text, rn) AS territory_text FROM f WHERE record_ix >= 0 GROUP BY doc_id, table_ix, record_ix""")
oracle("stitch_names", """WITH RECURSIVE p AS (SELECT (p_partkey % 40)::VARCHAR AS doc_id, p_partkey::INT AS record_ix, CASE p_partkey % 3 WHEN 0 THEN 'Муниципальное учреждение' WHEN 1 THEN 'Городского округа «Школа № ' || p_size || '»' ELSE 'МАОУ «Школа № ' || p_size || '»' END AS name, CASE p_size % 2 WHEN 0 THEN '' ELSE 'ул. ' || p_name END AS text FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_ix) AS rn FROM p),
f AS (SELECT doc_id, rn, record_ix, name, text FROM r WHERE rn = 1
  UNION ALL SELECT doc_id, rn, CASE WHEN joins THEN old_ix ELSE record_ix END, CASE WHEN joins THEN old_name || ' ' || name ELSE name END, CASE WHEN NOT joins OR old_text = '' THEN text WHEN text = '' THEN old_text ELSE old_text || ' ' || text END
  FROM (SELECT r.*, f.record_ix AS old_ix, f.name AS old_name, f.text AS old_text, NOT contains(f.name, '»') AND (starts_with(r.name, 'Городск') OR starts_with(r.name, '«')) AS joins FROM f JOIN r ON f.doc_id = r.doc_id AND r.rn = f.rn + 1))
SELECT doc_id, 1::INT AS page, 1::INT AS table_ix, record_ix, arg_max(name, rn) AS school_name, arg_max(text, rn) AS territory_text FROM f GROUP BY doc_id, record_ix""")

#: Saving: towns, decrees, schools and rules get ids after the stored ones, in a stated order.
SAVED = f"""{BUILT},
docs AS (SELECT id::VARCHAR AS doc_id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN 'новый ' || name ELSE 'Неизвестный муниципалитет' END AS municipality FROM municipalities),
towns AS (SELECT name, (SELECT max(id) FROM municipalities) + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT municipality AS name FROM docs) ANTI JOIN municipalities USING (name)),
all_towns AS (SELECT name, min(id) AS town_id FROM (SELECT name, id FROM municipalities UNION ALL SELECT name, id FROM towns) GROUP BY name),
new_decrees AS (SELECT doc_id, municipality, town_id, (SELECT max(id) FROM decrees) + row_number() OVER (ORDER BY doc_id) AS decree_id FROM docs JOIN all_towns ON name = municipality),
parsed AS (SELECT raw.id, doc_id, town_id, d.decree_id, s.name AS school FROM raw JOIN schools s ON s.id = raw.school_id JOIN new_decrees d ON doc_id = s.municipality_id::VARCHAR),
fresh AS (SELECT town_id, school, (SELECT max(id) FROM schools) + row_number() OVER (ORDER BY town_id, school) AS id FROM (SELECT DISTINCT town_id, school FROM parsed) ANTI JOIN (SELECT municipality_id AS town_id, name AS school FROM schools) USING (town_id, school)),
all_schools AS (SELECT town_id, school, min(id) AS sid FROM (SELECT municipality_id AS town_id, name AS school, id FROM schools UNION ALL SELECT town_id, school, id FROM fresh) GROUP BY ALL),
saved AS (SELECT (SELECT max(id) FROM rules) + row_number() OVER (ORDER BY p.doc_id, p.id) AS id, p.doc_id, sid AS school_id, p.decree_id, b.* EXCLUDE (id, school_id, decree_id), {street('b.street')} AS normalized_street FROM built b JOIN parsed p USING (id) JOIN all_schools USING (town_id, school)),
g AS (SELECT DISTINCT p_name AS q, 'г X, ' || p_name AS value, CASE WHEN len(p_name) % 3 = 1 THEN CASE WHEN len(p_name) % 2 = 0 THEN 'ул ' || p_name ELSE p_name || ' новая' END END AS given FROM part WHERE len(p_name) % 3 <> 0)"""
oracle("save_summary", f"""{SAVED} SELECT doc_id, municipality, decree_id, coalesce(schools_count, 0) AS schools_count, coalesce(rules_count, 0) AS rules_count FROM new_decrees
LEFT JOIN (SELECT doc_id, count(*) AS schools_count FROM fresh JOIN (SELECT town_id, school, min(doc_id) AS doc_id FROM parsed GROUP BY ALL) USING (town_id, school) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS rules_count FROM saved GROUP BY doc_id) USING (doc_id)""")
oracle("save_decree", f"""{SAVED} SELECT s.* EXCLUDE (doc_id), '' AS comment, g.value AS dadata_value, CASE WHEN given IS NULL THEN 'low' WHEN {street('given')} = normalized_street THEN 'high' ELSE 'medium' END AS dadata_confidence,
CASE WHEN given IS NOT NULL AND {street('given')} = normalized_street THEN 'verified' ELSE 'needs_review' END AS validation_status,
CASE WHEN q IS NULL THEN 'DaData не нашла подходящую улицу' WHEN given IS NULL THEN 'DaData нашла адрес, но не вернула улицу' WHEN {street('given')} = normalized_street THEN 'Улица подтверждена через DaData' ELSE 'DaData предлагает другое написание: ' || given END AS validation_comment
FROM saved s LEFT JOIN g ON q = concat_ws(', ', nullif(s.locality, ''), s.street)""")
