"""Queries of the folds, and their DuckDB counterparts."""

from __future__ import annotations

from quire.operators import folds as FO
from quire.registry import HEADS, query

query(
    "repeated_headings",
    "repeat_md",
    HEADS
    + r""", n AS (SELECT doc_id, level, trim(text) AS text, start_line_no AS line, line_no AS last, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM headings),
    kept AS (WITH RECURSIVE r(doc_id, k, kept, again, line, last) AS (
        SELECT doc_id, k, [{'line': line, 'level': level, 'text': text, 'parent': ''}], FALSE, line, last FROM n WHERE k = 1
        UNION ALL SELECT z.doc_id, z.k, CASE WHEN z.again THEN z.kept ELSE list_append(z.kept, z.own) END, z.again, z.line, z.last FROM (
            SELECT y.*, len(list_filter(y.kept, lambda x: y.line - x.line <= 60 AND x.level = y.own.level AND x.text = y.own.text AND x.parent = y.own.parent)) > 0 AS again FROM (
                SELECT n.doc_id, n.k, r.kept, n.line, n.last, {'line': n.line, 'level': n.level, 'text': n.text, 'parent': coalesce(list_filter(r.kept, lambda x: x.level < n.level)[-1].level::VARCHAR || ':' || list_filter(r.kept, lambda x: x.level < n.level)[-1].text, '')} AS own
                FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1) y) z)
        SELECT * FROM r)
    SELECT doc_id, unnest(range(line, last + 1))::BIGINT AS line_no FROM kept WHERE again""",
)(FO.repeated_headings)
