"""What model services list, and what their failed calls mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per service, by which status, code, kind of error or message a failed call is told.
LIMITED = {
    "mistral": ((429,), (), r"(?i)429|rate.?limit"), "gemini": ((429,), ("RESOURCE_EXHAUSTED",), r"(?i)429|rate.?limit|resource.?exhausted"), "anthropic": ((429,), ("rate_limit_error",), r"(?i)429|rate.?limit"),
    "openai": ((429,), ("429",), r"(?i)429|rate.?limit"), "openrouter": ((429,), ("429",), r"(?i)429|rate.?limit"), "custom": ((429,), ("429",), r"(?i)429|rate.?limit"),
}
OVERLOADED = {
    "gemini": ((503,), (), r"(?i)503|overloaded|service.?unavailable|temporarily.?unavailable"), "anthropic": ((503, 529), ("overloaded_error",), r"(?i)503|529|overloaded|service.?unavailable"),
    **{s: ((503,), (), r"(?i)503|overloaded|service.?unavailable") for s in ("mistral", "openai", "openrouter", "custom")},
}
PERSISTENT = {s: r"(?i)not.?found|invalid.?model|permission.?denied|unauthorized|bad.?request" for s in LIMITED} | {"anthropic": r"(?i)not.?found|invalid.?model|permission.?denied|unauthorized|authentication"}
WITHOUT_CREDIT = ("openai", "openrouter")
#: Characters of a message that stand for an error without a name.
SHOWN = 60

# Which ids of a listing are models for documents: all of the first patterns, none of the second.
LISTED = {
    "gemini": ((r"(?i)flash|pro", r"(?i)gemini-(2|3|4)"), r"(?i)thinking|embedding|aqa|text|tts"), "openai": ((r"^(gpt-|o\d)",), r"(?i)instruct|embed|whisper|tts|dall"),
    "mistral": ((r"(?i)ocr|small|medium|large|pixtral",), r"(?i)embed|moder"), "anthropic": ((r"(?i)claude",), None),
}


def _told(rules: dict) -> Column:
    """The service's rule about a failed call: status, code (or kind of error) or message."""
    said = F.coalesce(F.col("message"), F.lit(""))
    cases = [F.when(F.col("service") == s, F.coalesce(F.col("status").isin(*status), F.lit(False)) | F.coalesce(F.col("code").isin(*codes) if codes else F.lit(False), F.lit(False)) | said.rlike(pattern)) for s, (status, codes, pattern) in rules.items()]
    return F.coalesce(*cases, F.lit(False))


def failures(calls: DataFrame) -> DataFrame:
    """Adds limited, overloaded, persistent and summary to failed calls (service, status, code, refusal, message).

    A refusal, of one service only, is persistent. The first that holds names the error: refusal, rate limit,
    overload, key, model, request, credit, server; else the start of its message. Unknown services have no rules but
    those by status.
    """
    status, message = F.col("status"), F.coalesce(F.col("message"), F.lit(""))
    refused = (F.col("service") == "anthropic") & F.coalesce(F.col("refusal"), F.lit(False))
    said = F.coalesce(*[F.when(F.col("service") == s, message.rlike(p)) for s, p in PERSISTENT.items()], F.lit(False))
    rows = calls.withColumns({"limited": _told(LIMITED), "overloaded": _told(OVERLOADED), "persistent": F.coalesce(refused, F.lit(False)) | F.coalesce(status.isin(400, 401, 403, 404), F.lit(False)) | said})
    named = (
        F.when(refused, "request declined").when(F.col("limited"), "rate limited").when(F.col("overloaded"), F.when(F.col("service") == "anthropic", "API overloaded").otherwise("service overloaded (503)"))
        .when(status.isin(401, 403), "auth error").when(status == 404, "model not found").when(status == 400, "bad request").when((status == 402) & F.col("service").isin(*WITHOUT_CREDIT), "insufficient credits")
        .when(status >= 500, F.concat(F.lit("server error ("), status.cast("string"), F.lit(")"))).when(message != "", F.left(message, F.lit(SHOWN))).otherwise("unknown error")
    )
    return rows.withColumn("summary", named)


def skipped_models(failed: DataFrame) -> DataFrame:
    """(job_id, model) to leave out from now on: of failures (job_id, attempt, model, limited, persistent), those that won't get better.

    A persistent error, or a second rate limit of the same model in the same job.
    """
    bad = failed.groupBy("job_id", "model").agg(F.max("persistent").alias("p"), F.count_if("limited").alias("n"))
    return bad.filter(F.col("p") | (F.col("n") > 1)).select("job_id", "model")


def listed(models: DataFrame) -> DataFrame:
    """(service, id, display_name) of listings (service, id, display_name, methods, modality) that are models for documents.

    One service tells by what a model can generate and names ids behind a slash, one by the output side of its
    modalities; of an unknown service all are. A model without a name is called by its id.
    """
    of = lambda s: F.col("service") == s
    fits = F.lit(True)
    for s, (wanted, unwanted) in LISTED.items():
        ok = F.lit(True)
        for p in wanted:
            ok = ok & F.col("id").rlike(p)
        ok = ok & ~F.col("id").rlike(unwanted) if unwanted else ok
        fits = fits & (~of(s) | ok)
    generates = ~of("gemini") | F.coalesce(F.array_contains("methods", "generateContent"), F.lit(False))
    as_text = ~of("openrouter") | F.coalesce(F.trim(F.try_element_at(F.split("modality", "->"), F.lit(2))) == "text", F.lit(False))
    shown = F.when(of("gemini"), F.regexp_replace("id", "^(.*?)models/", "$1")).otherwise(F.col("id"))
    return models.filter(fits & generates & as_text).select("service", shown.alias("id"), F.coalesce(F.nullif("display_name", F.lit("")), shown).alias("display_name"))
