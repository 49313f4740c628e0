"""The queries of blocks, tables and runs over every kind of block, and their DuckDB counterparts."""

from __future__ import annotations

from quire.operators import blocks as BL
from quire.registry import ATX, query

BY_DOC = "PARTITION BY doc_id ORDER BY line_no"
META = r"'(?i)^\s*<!--\s*heading-level:\s*([7-9])\s*-->\s*$'"
IMAGE = r"'^!\[([^\]]*)\]\((data:image/[^;]+;base64,[A-Za-z0-9+/=]+)\)$'"
KINDS = rf"""--with a AS (SELECT doc_id, line_no, line, trim(line) AS t, starts_with(trim(line), '```') AS tick, trim(line) = '<!-- ENDNOTE-SECTION-BREAK -->' AS stop FROM lines),
    b AS (SELECT *, sum(tick::INT) OVER ({BY_DOC}) AS ticks FROM a),
    c AS (SELECT *, tick OR (NOT stop AND ticks % 2 = 1) AS code FROM b),
    d AS (SELECT *, CASE WHEN code OR stop THEN 0 ELSE length(regexp_extract(line, {ATX}, 1)) END AS n, CASE WHEN code OR stop THEN '' ELSE regexp_extract(line, {META}, 1) END AS meta, regexp_extract(line, {ATX}, 2) AS title FROM c),
    e AS (SELECT *, meta <> '' AND lead(n, 1, 0) OVER w BETWEEN 1 AND 6 AS pair, n BETWEEN 1 AND 6 AND lag(meta, 1, '') OVER w <> '' AS taken, lead(title) OVER w AS below,
        coalesce(last_value(CASE WHEN code OR stop THEN NULL WHEN regexp_matches(t, '^<!--\s*Document Outline\s*-->$') THEN TRUE WHEN t = '---' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS outlined FROM d WINDOW w AS ({BY_DOC})),
    f AS (SELECT *, CASE WHEN stop THEN 'break' WHEN code THEN 'code' WHEN t = '' THEN NULL WHEN t = '---' THEN 'rule' WHEN regexp_matches(t, '^<!--\s*page:\s*(.+?)\s*-->$') THEN 'page' WHEN regexp_matches(t, '^<!--\s*Document Outline\s*-->$') THEN 'outline'
        WHEN t LIKE '<!--%-->' AND meta = '' THEN NULL WHEN taken THEN NULL WHEN pair OR n > 0 THEN CASE WHEN outlined THEN 'entry' ELSE 'heading' END
        WHEN t LIKE '|%' AND t LIKE '%|' AND len(string_split(t, '|')) >= 3 THEN 'table' WHEN t LIKE '> %' THEN 'quote' WHEN outlined THEN 'note' WHEN regexp_matches(t, {IMAGE}) THEN 'image'
        WHEN t LIKE '#%' OR t LIKE '>%' OR t LIKE '|%' OR t LIKE '<!--%' OR regexp_matches(t, '^!\[.*\]\(data:image/') OR regexp_matches(t, '^\[\^\w+\]:\s') THEN NULL ELSE 'paragraph' END AS kind FROM e),
    g AS (SELECT *, kind IS NOT NULL AND kind <> 'code' AND NOT coalesce(kind IN ('table', 'quote', 'paragraph') AND kind = lag(kind) OVER ({BY_DOC}), FALSE) AS starts FROM f),
    h AS (SELECT *, CASE WHEN kind = 'code' THEN -((ticks + 1) // 2) ELSE sum(starts::INT) OVER ({BY_DOC}) END AS block, regexp_matches(t, '^\|[\s:\-|]+\|$') AS sep, list_transform(string_split(t, '|')[2:-2], lambda x: trim(x)) AS cells FROM g)"""

query(
    "all_blocks",
    "block_md",
    KINDS
    + r""", p AS (SELECT *, CASE kind WHEN 'code' THEN CASE WHEN tick THEN NULL ELSE line END WHEN 'page' THEN regexp_extract(t, 'page:\s*(.+?)\s*-->$', 1) WHEN 'table' THEN CASE WHEN sep THEN NULL ELSE '[' || array_to_string(list_transform(cells, lambda x: to_json(x)::VARCHAR), ', ') || ']' END
        WHEN 'quote' THEN regexp_replace(t, '^>\s?', '') WHEN 'note' THEN t WHEN 'paragraph' THEN t WHEN 'image' THEN regexp_replace(t, """
    + IMAGE
    + r""", '\1' || chr(9) || '\2') WHEN 'heading' THEN CASE WHEN pair THEN meta || chr(9) || below ELSE n::VARCHAR || chr(9) || title END WHEN 'entry' THEN CASE WHEN pair THEN meta || chr(9) || below ELSE n::VARCHAR || chr(9) || title END ELSE '' END AS piece FROM h WHERE kind IS NOT NULL),
    q AS (SELECT doc_id, kind, CASE WHEN kind = 'code' THEN max(line_no) ELSE min(line_no) END AS spot, count(*) FILTER (tick) AS ticks, CASE kind WHEN 'code' THEN string_agg(piece, chr(10) ORDER BY line_no) WHEN 'table' THEN string_agg(piece, ', ' ORDER BY line_no) ELSE string_agg(piece, ' ' ORDER BY line_no) END AS s FROM p GROUP BY doc_id, kind, block)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS block_no, kind, CASE WHEN kind = 'table' THEN '[' || s || ']' ELSE s END AS payload FROM q WHERE s IS NOT NULL AND NOT (kind = 'code' AND (ticks < 2 OR trim(s, chr(10) || ' ') = ''))""",
)(lambda d: BL.blocks(d, notes=False))
query(
    "table_cells",
    "block_md",
    KINDS
    + r""", r AS (SELECT doc_id, block, line_no, cells FROM h WHERE kind = 'table' AND NOT sep)
    SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS table_no, row_number() OVER t - 1 AS row_no, line_no::BIGINT AS line_no, array_to_string(cells, chr(9)) AS cells, row_number() OVER t = 1 AND count(*) OVER (PARTITION BY doc_id, block) > 1 AS header FROM r WINDOW t AS (PARTITION BY doc_id, block ORDER BY line_no)""",
)(lambda d: BL.table_rows(d).selectExpr("doc_id", "table_no", "row_no", "line_no", "array_join(cells, '\t') AS cells", "header"))
MARK = r"'(?i)(\*\*\*.+?\*\*\*|\*\*.+?\*\*|\*.+?\*|<sup>.+?</sup>|<sub>.+?</sub>|<br\s*/?>)'"
query(
    "marked_runs",
    "block_md",
    rf"""--with a AS (SELECT doc_id, line_no, string_split(regexp_replace(line, '(\[\^\w+\])', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS p FROM lines),
    b AS (SELECT doc_id, line_no, i, CASE WHEN i % 2 = 0 THEN [p[i]] ELSE string_split(regexp_replace(replace(replace(replace(replace(replace(p[i], '&nbsp;', chr(160)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), {MARK}, chr(1) || '\1' || chr(1), 'g'), chr(1)) END AS q FROM a, unnest(range(1, len(p) + 1)) u(i)),
    c AS (SELECT doc_id, line_no, i, j, i % 2 = 0 AS is_note, j % 2 = 0 AS marked, q[j] AS x FROM b, unnest(range(1, len(q) + 1)) v(j)),
    d AS (SELECT *, CASE WHEN NOT marked OR is_note THEN '' WHEN lower(x) LIKE '<br%' THEN 'brk' WHEN lower(x) LIKE '<su%' THEN lower(x)[2:4] WHEN regexp_matches(x, '^\*\*\*.+\*\*\*$') THEN 'both' WHEN regexp_matches(x, '^\*\*.+\*\*$') THEN 'bold' ELSE 'italic' END AS style FROM c WHERE x <> ''),
    e AS (SELECT doc_id, line_no, i, j, is_note, style, CASE style WHEN 'both' THEN x[4:-4] WHEN 'bold' THEN x[3:-3] WHEN 'italic' THEN x[2:-2] WHEN 'brk' THEN '' WHEN '' THEN CASE WHEN is_note THEN '' ELSE x END ELSE x[6:-7] END AS text, CASE WHEN is_note THEN x[3:-2] END AS note FROM d
        UNION ALL SELECT doc_id, line_no, 0, 0, FALSE, '', '', NULL FROM lines WHERE line = '')
    SELECT doc_id, line_no::BIGINT AS line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i, j) - 1 AS run_no, text, style IN ('both', 'bold') AS bold, style IN ('both', 'italic') AS italic, style = 'sup' AS sup, style = 'sub' AS sub, style = 'brk' AS brk, note FROM e""",
)(BL.inline_runs)
