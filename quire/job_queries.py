"""Queries of settings, listings and priorities, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators import headings as H
from quire.operators import jobs as J
from quire.operators import settings as S
from quire.registry import HEADS, NORMAL, SER, query  # noqa: F401

SAVED = [
    '{"model": "gemini-2.5-flash"}', '{"model": "own", "outputNotes": "#"}', '{"modelPriority": []}', '{"modelPriority": ["x", "#"], "activeProvider": "openai"}', '{"providerModelPriority": {"anthropic": ["claude-haiku-35-20241022"]}, "translationLanguages": ["Spanish"]}',
    '{"providerModelPriority": {"anthropic": ["claude-haiku-35-20241022", "claude-sonnet-4-20250514"], "gemini": ["#"]}, "headingCorrectionEnabled": false, "headingCorrectionDefaultOnApplied": true}',
    '{"providerModelPriority": {"anthropic": ["#", "claude-haiku-35-20241022"]}, "headingCorrectionEnabled": false}', '{bad #', '{"scanProvider": "#", "activeProvider": "mistral", "translationLanguages": ["English", "Latin"]}', '[1]',
]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


query(
    "settings_versions",
    "CUSTOMER",
    f"""WITH s AS (SELECT c_custkey, replace(({_sql_list(SAVED)})[(c_custkey % {len(SAVED)} + 1)::INT], '#', c_name) AS t FROM customer),
    j AS (SELECT c_custkey, CASE WHEN json_valid(t) AND left(t, 1) = '{{' THEN t::JSON ELSE '{{"headingCorrectionEnabled": true, "headingCorrectionDefaultOnApplied": true}}'::JSON END AS j FROM s),
    p AS (SELECT *, (j -> '$.providerModelPriority.gemini')::VARCHAR[] AS g0, (j -> '$.providerModelPriority.anthropic')::VARCHAR[] AS a0, (j -> '$.modelPriority')::VARCHAR[] AS mp, j ->> '$.model' AS m, coalesce(j ->> '$.activeProvider', 'gemini') AS active FROM j),
    q AS (SELECT *, CASE WHEN g0 IS NOT NULL THEN g0 WHEN m IS NOT NULL THEN list_concat([m], list_filter({_sql_list(S.MODELS["gemini"])}, lambda x: x <> m)) WHEN len(mp) > 0 THEN mp ELSE {_sql_list(S.MODELS["gemini"])} END AS gemini, list_filter(coalesce(a0, {_sql_list(S.MODELS["anthropic"])}), lambda x: x <> '{S.INVALID}') AS kept FROM p)
    SELECT c_custkey, array_to_string(gemini, '|') AS gemini, array_to_string(CASE WHEN list_contains(a0, '{S.INVALID}') AND (len(kept) = 0 OR kept = ['{S.OUTDATED}']) THEN {_sql_list(S.MODELS["anthropic"])} ELSE kept END, '|') AS anthropic, active, coalesce(j ->> '$.scanProvider', active) AS scan,
        CASE WHEN j ->> '$.scanProvider' IS NULL THEN active ELSE coalesce(j ->> '$.translateProvider', 'gemini') END AS translate, CASE WHEN (j ->> '$.headingCorrectionDefaultOnApplied')::BOOLEAN THEN coalesce((j ->> '$.headingCorrectionEnabled')::BOOLEAN, TRUE) ELSE TRUE END AS corrects,
        CASE WHEN list_contains((j -> '$.translationLanguages')::VARCHAR[], 'English') THEN len((j -> '$.translationLanguages')::VARCHAR[]) ELSE {len(S.LANGUAGES)} END AS languages, j ->> '$.outputNotes' AS notes FROM q""",
)(
    lambda d: S.up_to_date(d.select("c_custkey", F.replace(F.element_at(F.array(*map(F.lit, SAVED)), (F.col("c_custkey") % len(SAVED) + 1).cast("int")), F.lit("#"), F.col("c_name")).alias("json"))).select(
        "c_custkey", *[F.array_join(F.col("providerModelPriority")[k], "|").alias(k) for k in ("gemini", "anthropic")], F.col("activeProvider").alias("active"), F.col("scanProvider").alias("scan"), F.col("translateProvider").alias("translate"),
        F.col("headingCorrectionEnabled").alias("corrects"), F.size("translationLanguages").cast("long").alias("languages"), F.col("rest")["outputNotes"].alias("notes"),
    )
)
NAMES = "CASE length(display_name) % 4 WHEN 0 THEN upper(left(id, 1)) || '_' || substr(id, 2) WHEN 1 THEN 'Ä' || id WHEN 2 THEN upper(id) ELSE id END || CASE WHEN is_free THEN '-b' ELSE '' END"
query("model_ids_locale", "models", f" SELECT id, row_number() OVER (ORDER BY id COLLATE en_us DESC) AS place FROM (SELECT DISTINCT {NAMES} AS id FROM models) ORDER BY id COLLATE en_us DESC LIMIT 300")(lambda d: J.ids_descending(d.selectExpr(f"{NAMES} AS id"), 300))
query("priority_available", "models", " SELECT stage_model, id, row_number() OVER (PARTITION BY stage_model ORDER BY length(display_name), id) AS place FROM models WHERE context_length IS NOT NULL")(
    lambda d: J.available_in_order(d.withColumn("place", F.row_number().over(W.partitionBy("stage_model").orderBy(F.length("display_name"), "id"))).select("stage_model", "id", "place"), d.filter("context_length is not null"), "stage_model")
)
query(
    "relevel_all",
    "deep_md",
    NORMAL.replace("headings AS (", "headings AS MATERIALIZED (", 1)
    + rf""", canon AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS line_no, line FROM o),
    c1 AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS isf FROM canon), c2 AS (SELECT *, isf OR (sum(isf::INT) OVER (PARTITION BY doc_id ORDER BY line_no)) % 2 = 1 AS masked FROM c1),
    c3 AS (SELECT *, CASE WHEN masked THEN '' ELSE regexp_extract(line, '^(#{{1,6}}) ', 1) END AS marks, CASE WHEN masked THEN '' ELSE regexp_extract(line, '^<!-- heading-level: ([7-9]) -->$', 1) END AS meta FROM c2),
    c4 AS (SELECT *, lag(meta, 1, '') OVER w AS above, lead(marks, 1, '') OVER w <> '' AND meta <> '' AS pair FROM c3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    c5 AS (SELECT *, CASE WHEN above <> '' THEN above::INT ELSE length(marks) END AS level, regexp_extract(line, '^#+[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$', 1) AS text FROM c4 WHERE NOT pair),
    c6 AS (SELECT * REPLACE (level % 9 + 1 AS level) FROM c5 WHERE marks <> ''),
    c7 AS (SELECT doc_id, line_no, {SER} AS line FROM c6 UNION ALL SELECT doc_id, line_no, line FROM c5 WHERE marks = '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, s) - 1 AS line_no, string_split(line, chr(10))[s] AS line FROM c7, unnest(range(1, len(string_split(line, chr(10))) + 1)) t(s)""",
)(lambda d: H.relevel(d, H.collect_headings(H.normalize_syntax(d)).select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1).alias("h_no"), (F.col("level") % 9 + 1).alias("new_level"))))
