"""DuckDB SQL for the queries here that SQL can express, over the same whole tables."""

from __future__ import annotations

from ..plans.text_sql import DOCS, PAIRS, SHINGLED

_SETS = f"{DOCS}, {SHINGLED}, {PAIRS}"

_SPLITS = """
given AS (SELECT doc_id, upper(trim(role)) AS role, assigned_at FROM role_assignment WHERE trim(role) <> ''),
last AS (SELECT doc_id, arg_max(role, (assigned_at, role)) AS role FROM given GROUP BY doc_id),
splits AS (SELECT doc_id, role FROM last UNION SELECT unnest(map_keys(offsets)), upper(trim(role)) FROM manifest WHERE trim(role) <> ''),
sides AS (SELECT doc_id, bool_or(role = 'TRAIN') AS train, bool_or(role IN ('VALIDATION', 'EVAL')) AS held FROM splits GROUP BY doc_id)"""

P1_FOUND = f"""WITH {_SETS}, {_SPLITS}
SELECT a AS doc_id_a, b AS doc_id_b FROM alike p JOIN sides x ON x.doc_id = a JOIN sides y ON y.doc_id = b
WHERE (x.train AND y.held) OR (x.held AND y.train)"""

P3_FOUND = f"""WITH {_SETS}
SELECT a AS doc_id_a, b AS doc_id_b FROM alike p JOIN docs x ON x.doc_id = a JOIN docs y ON y.doc_id = b WHERE x.text <> y.text"""

P2_FOUND = """WITH RECURSIVE kinds AS (
  SELECT token_id, CASE WHEN kind <> 'text' THEN 0 WHEN piece = chr(10) THEN 3 WHEN piece IN ('.', '!', '?', '।', '॥') THEN 2 WHEN starts_with(piece, ' ') THEN 1 ELSE 0 END AS k FROM vocab),
frags AS (SELECT doc_id, any_value(parent_doc_id) AS parent_doc_id, any_value(fragment_index) AS idx, any_value(tokens) AS tokens, any_value(token_offset_in_parent) AS given FROM fragments GROUP BY doc_id),
placed AS (
  SELECT doc_id, parent_doc_id, tokens, coalesce(given, coalesce(sum(len(tokens)) OVER (PARTITION BY parent_doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS origin FROM frags),
oversized AS (SELECT doc_id, parent_doc_id, origin, tokens FROM placed WHERE len(tokens) > 128),
each AS (SELECT doc_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS t FROM oversized),
coded AS (SELECT doc_id, list(coalesce(k, 0) ORDER BY i) AS k FROM each LEFT JOIN kinds ON token_id = t GROUP BY doc_id),
cut AS (
  SELECT doc_id, k, len(k) AS n, 0::BIGINT AS s, NULL::BIGINT AS e FROM coded
  UNION ALL
  SELECT doc_id, k, n, e - 16, NULL FROM (
    SELECT doc_id, k, n, s, coalesce(
      s + 129 - list_position(list_reverse(k[s + 65:s + 128]), 3),
      s + 129 - list_position(list_reverse(k[s + 65:s + 128]), 2),
      s + 129 - list_position(list_reverse(k[s + 66:s + 129]), 1), s + 128) AS e FROM cut WHERE n - s > 128)),
starts AS (SELECT doc_id, n, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM cut)
SELECT DISTINCT parent_doc_id, (origin + s)::INTEGER AS token_offset_in_parent, (origin + coalesce(next + 16, n))::INTEGER AS token_end_in_parent FROM starts JOIN oversized USING (doc_id)"""

P6_FOUND = r"""WITH t AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
d AS (SELECT DISTINCT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
z AS (SELECT t.source, target_share, max_repeats, coalesce(sum(octet_length(encode(text))), 0) AS size FROM t LEFT JOIN d USING (source) GROUP BY ALL)
SELECT source FROM z WHERE size * max_repeats < target_share * (SELECT sum(size) FROM z)"""


P1_REPORT = f"""WITH {_SETS}, {_SPLITS}, src AS (SELECT doc_id, coalesce(min(lower(trim(source))), '') AS source FROM corpus GROUP BY doc_id),
own AS (SELECT s.doc_id, text, train, held FROM sets s JOIN docs USING (doc_id) JOIN sides USING (doc_id)), h AS (SELECT doc_id, text FROM own WHERE held),
met AS (SELECT a AS doc_id, b AS other FROM alike UNION ALL SELECT b, a FROM alike),
seen AS (SELECT h.doc_id, EXISTS (SELECT 1 FROM own t WHERE t.train AND t.doc_id <> h.doc_id AND t.text = h.text) AS exact, h.doc_id IN (SELECT m.doc_id FROM met m JOIN own t ON t.doc_id = m.other AND t.train) AS near_there FROM h)
SELECT role, source, count(*) AS documents, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE near_there AND NOT exact) AS near FROM seen JOIN splits USING (doc_id) JOIN src USING (doc_id) WHERE role IN ('VALIDATION', 'EVAL') GROUP BY ALL"""

P2_PIECES = P2_FOUND[: P2_FOUND.index("SELECT DISTINCT parent_doc_id")] + """SELECT doc_id, parent_doc_id, tokens[s + 1:coalesce(next + 16, n)] AS tokens, (origin + s)::INTEGER AS token_offset_in_parent FROM starts JOIN oversized USING (doc_id)
UNION ALL SELECT doc_id, parent_doc_id, tokens, origin::INTEGER FROM placed WHERE len(tokens) <= 128"""

_CLASSES = "keyed AS (SELECT doc_id, array_to_string(list_sort(sh), chr(1)) AS k FROM sets), heads AS (SELECT k, min(doc_id) AS class_id, count(*) AS copies FROM keyed GROUP BY k)"

P3_LINKS = f"""WITH {_SETS}, {_CLASSES}, met AS (SELECT a AS x, b AS y FROM alike UNION ALL SELECT b, a FROM alike),
l AS (SELECT x, count(DISTINCT ky.k) AS links FROM met JOIN keyed kx ON kx.doc_id = x JOIN keyed ky ON ky.doc_id = y WHERE kx.k <> ky.k GROUP BY x)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM keyed JOIN heads USING (k) LEFT JOIN l ON x = doc_id"""

P3_GROUPS = f"""WITH RECURSIVE {_SETS}, met AS (SELECT a AS x, b AS y FROM alike UNION SELECT b, a FROM alike), reach AS (SELECT x, y FROM met UNION SELECT r.x, m.y FROM reach r JOIN met m ON m.x = r.y)
SELECT x AS doc_id, least(min(y), x) AS group_id FROM reach GROUP BY x"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p2_found": P2_FOUND, "p2_pieces": P2_PIECES, "p3_found": P3_FOUND, "p3_links": P3_LINKS, "p3_groups": P3_GROUPS, "p6_found": P6_FOUND}
