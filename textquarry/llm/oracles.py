"""DuckDB SQL for the opN queries that SQL can express.

The others depend on learned models, keyed permutations, propagation or a
tokenizer; tests/llm holds them against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"'[\x20\x09-\x0D]+'"

_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, {_SPACES}), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN ['short ' || len(ws) || ' ' || array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_.k >= 85 * (x.k + y.k - both_.k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

_LINES = r"""WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)),
t AS (SELECT doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM l),
bad AS (SELECT own FROM t WHERE own <> '' GROUP BY own HAVING count(DISTINCT site) >= 5),
m AS (SELECT t.doc_id, t.pos, t.line, t.own, b.own IS NOT NULL AS gone FROM t LEFT JOIN bad b USING (own)),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (own <> '') AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(g.text) AS text_sha256, length(g.text) AS n_chars FROM documents d LEFT JOIN g USING (doc_id)"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LEAKS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda p: array_to_string(ws[p:p + least(10, len(ws)) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
size AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS g FROM d, size WHERE len(ws) >= k),
hit AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN win ON win.g = dw.g AND win.k = dw.k),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL: dict[str, str] = {"op6_chosen_path": _NEAR, "op7_line_spread": _LINES, "op8_fm_index": _LEAKS}
