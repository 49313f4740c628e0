"""The queries of links, services and their failures, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import services as S
from quire.registry import query

LINKS = (" javascript:alert(1)", "java\tscript:alert(1)", "\x01javascript:alert(1)", "1x:y", "tel:1", "DATA:text/html,x", "data:image/png;base64,", "HTTPS://x", "mailto:", "/a:b", "a?b:c", "a#b:c", "ircs:x", ":x", "a/b", "")
_AT = f"list_element([{', '.join(chr(39) + x + chr(39) for x in LINKS)}], (page_id % {len(LINKS)} + 1)::INT) || page_id::VARCHAR"
query(
    "url_guard",
    "PAGES",
    f"""WITH u AS (SELECT page_id, {_AT} AS url FROM pages), c AS (SELECT *, instr(url, ':') AS c, instr(url, '/') AS s, instr(url, '?') AS q, instr(url, '#') AS h FROM u)
    SELECT page_id, url, url LIKE 'data:%' OR c = 0 OR (s > 0 AND c > s) OR (q > 0 AND c > q) OR (h > 0 AND c > h) OR lower(left(url, c - 1)) IN ('http', 'https', 'irc', 'ircs', 'mailto', 'xmpp') AS safe FROM c""",
)(lambda d: d.select("page_id", F.concat(F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % len(LINKS) + 1).cast("int")), F.col("page_id").cast("string")).alias("url")).select("page_id", "url", V.is_safe_url("url").alias("safe")))

_CALLS = """c AS (SELECT event_id, user_id::VARCHAR AS job_id, (['mistral', 'gemini', 'anthropic', 'openai', 'openrouter', 'custom', 'new'])[(event_id % 7 + 1)::INT] AS service, 'm' || (event_id % 5)::VARCHAR AS model,
        ([429, 503, 529, 401, 403, 404, 400, 402, 500, NULL, 200])[(event_id % 11 + 1)::INT] AS status, (['RESOURCE_EXHAUSTED', 'rate_limit_error', 'overloaded_error', '429', NULL])[(event_id // 7 % 5 + 1)::INT] AS code, event_id % 13 = 0 AS refusal,
        (['503 service unavailable', 'Rate-limit hit', 'unauthorized', 'temporarily unavailable', 'authentication_error', 'model notfound', 'Bad Request', 'resource exhausted', '', NULL, 'socket hang up: ' || repeat(event_type, 12)])[(event_id // 3 % 11 + 1)::INT] AS message FROM events),
    f AS (SELECT *, coalesce(status = 429 OR (service = 'gemini' AND code = 'RESOURCE_EXHAUSTED') OR (service = 'anthropic' AND code = 'rate_limit_error') OR (service IN ('openai', 'openrouter', 'custom') AND code = '429'), FALSE)
            OR coalesce((service = 'anthropic' AND code = 'rate_limit_error') OR (service = 'gemini' AND code = 'RESOURCE_EXHAUSTED') OR (service IN ('openai', 'openrouter', 'custom') AND code = '429'), FALSE)
            OR regexp_matches(coalesce(message, ''), '(?i)429|rate.?limit') OR (service = 'gemini' AND regexp_matches(coalesce(message, ''), '(?i)resource.?exhausted')) AS lim,
        coalesce(status = 503, FALSE) OR coalesce(service = 'anthropic' AND status = 529, FALSE) OR coalesce(service = 'anthropic' AND code = 'overloaded_error', FALSE) OR regexp_matches(coalesce(message, ''), '(?i)503|overloaded|service.?unavailable')
            OR (service = 'anthropic' AND coalesce(message, '') LIKE '%529%') OR (service = 'gemini' AND regexp_matches(coalesce(message, ''), '(?i)temporarily.?unavailable')) AS ovl,
        (service = 'anthropic' AND refusal) OR coalesce(status IN (400, 401, 403, 404), FALSE) OR (service <> 'new' AND (regexp_matches(coalesce(message, ''), '(?i)not.?found|invalid.?model|permission.?denied|unauthorized') OR regexp_matches(coalesce(message, ''), CASE service WHEN 'anthropic' THEN '(?i)authentication' ELSE '(?i)bad.?request' END))) AS persistent FROM c),
    g AS (SELECT *, service <> 'new' AND lim AS limited, service <> 'new' AND ovl AS overloaded FROM f)"""


def _calls(events):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    e = F.col("event_id")
    message = pick(("503 service unavailable", "Rate-limit hit", "unauthorized", "temporarily unavailable", "authentication_error", "model notfound", "Bad Request", "resource exhausted", "", None, "#"), F.floor(e / 3) % 11)
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("job_id"), pick(("mistral", "gemini", "anthropic", "openai", "openrouter", "custom", "new"), e % 7).alias("service"), F.concat(F.lit("m"), (e % 5).cast("string")).alias("model"),
        pick((429, 503, 529, 401, 403, 404, 400, 402, 500, None, 200), e % 11).alias("status"), pick(("RESOURCE_EXHAUSTED", "rate_limit_error", "overloaded_error", "429", None), F.floor(e / 7) % 5).alias("code"), (e % 13 == 0).alias("refusal"),
        F.when(message == "#", F.concat(F.lit("socket hang up: "), F.repeat("event_type", F.lit(12)))).otherwise(message).alias("message"),
    )


query(
    "failed_calls",
    "EVENTS",
    "WITH " + _CALLS + """ SELECT event_id, limited, overloaded, persistent, CASE WHEN service = 'anthropic' AND refusal THEN 'request declined' WHEN limited THEN 'rate limited' WHEN overloaded THEN CASE service WHEN 'anthropic' THEN 'API overloaded' ELSE 'service overloaded (503)' END
        WHEN status IN (401, 403) THEN 'auth error' WHEN status = 404 THEN 'model not found' WHEN status = 400 THEN 'bad request' WHEN status = 402 AND service IN ('openai', 'openrouter') THEN 'insufficient credits' WHEN status >= 500 THEN 'server error (' || status::VARCHAR || ')'
        WHEN coalesce(message, '') = '' THEN 'unknown error' ELSE left(message, 60) END AS summary FROM g""",
)(lambda d: S.failures(_calls(d)).select("event_id", "limited", "overloaded", "persistent", "summary"))
query("skipped_models", "EVENTS", "WITH " + _CALLS + " SELECT job_id, model FROM g GROUP BY 1, 2 HAVING bool_or(persistent) OR count(*) FILTER (limited) > 1")(lambda d: S.skipped_models(S.failures(_calls(d))))
query(
    "service_listings",
    "models",
    """, m AS (SELECT (['gemini', 'openai', 'mistral', 'anthropic', 'openrouter', 'custom'])[(length(id) + length(display_name)) % 6 + 1] AS service, (['models/gemini-2.5-flash-', 'gemini-3-pro-tts-', 'gpt-5-', 'o3-whisper-', 'mistral-OCR-', 'mistral-embed-large-', 'Claude-x-', 'other-'])[length(display_name) % 8 + 1] || id AS id,
        CASE WHEN is_free THEN '' ELSE display_name END AS name, is_free AS can, (['text+image->text', 'text->image', NULL])[length(stage_model || id) % 3 + 1] AS modality FROM models)
    SELECT service, CASE service WHEN 'gemini' THEN replace(id, 'models/', '') ELSE id END AS id, coalesce(nullif(name, ''), CASE service WHEN 'gemini' THEN replace(id, 'models/', '') ELSE id END) AS display_name FROM m WHERE CASE service WHEN 'gemini' THEN can AND id LIKE '%gemini-2.5-flash%' WHEN 'openai' THEN id LIKE 'gpt-%' WHEN 'mistral' THEN id LIKE 'mistral-OCR%'
        WHEN 'anthropic' THEN id LIKE 'Claude%' WHEN 'openrouter' THEN modality LIKE '%->text' ELSE TRUE END""".replace(", m AS", "--with m AS", 1),
)(
    lambda d: S.listed(
        d.select(
            F.element_at(F.array(*map(F.lit, ("gemini", "openai", "mistral", "anthropic", "openrouter", "custom"))), (F.length("id") + F.length("display_name")) % 6 + 1).alias("service"),
            F.concat(F.element_at(F.array(*map(F.lit, ("models/gemini-2.5-flash-", "gemini-3-pro-tts-", "gpt-5-", "o3-whisper-", "mistral-OCR-", "mistral-embed-large-", "Claude-x-", "other-"))), F.length("display_name") % 8 + 1), "id").alias("id"),
            F.when(F.col("is_free"), "").otherwise(F.col("display_name")).alias("display_name"), F.when(F.col("is_free"), F.array(F.lit("embed"), F.lit("generateContent"))).alias("methods"),
            F.element_at(F.array(F.lit("text+image->text"), F.lit("text->image"), F.lit(None).cast("string")), F.length(F.concat("stage_model", "id")) % 3 + 1).alias("modality"),
        )
    )
)
