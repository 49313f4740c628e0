"""The job, log, history and model tables around document work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T

KEEP_LOG, MODEL_TTL_MS = 500, 24 * 3600 * 1000


def history_key(path: str = "source_path", language: str = "language"):
    return F.concat_ws("::", path, F.nullif(F.col(language), F.lit("")))


def log_groups(log: DataFrame) -> DataFrame:
    """(job_id, file_name, entries, latest, has_issue): one row a job; the first entry's file name."""
    return log.groupBy("job_id").agg(F.min_by("file_name", F.struct("ts", "id")).alias("file_name"), F.count("*").alias("entries"), F.max("ts").alias("latest"), F.bool_or(F.col("level").isin("warn", "error")).alias("has_issue"))


def log_filter(log: DataFrame, needle: str, bucket: str = "all") -> DataFrame:
    """Entries with the text in their file name or message; ``issues`` are warnings and errors."""
    hit = F.contains(F.lower("file_name"), F.lit(needle.lower())) | F.contains(F.lower("message"), F.lit(needle.lower()))
    levels = {"all": F.lit(True), "issues": F.col("level").isin("warn", "error")}
    return log.filter(hit & levels.get(bucket, F.col("level") == bucket))


def newest_log(log: DataFrame, keep: int = KEEP_LOG) -> DataFrame:
    """The newest entries: a top-k, merged from partial ones."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def upsert_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History with changes replacing or joining by key; of several changes the latest counts."""
    both = history.withColumn("fresh", F.lit(0)).unionByName(changes.withColumn("fresh", F.lit(1)))
    w = W.partitionBy(history_key()).orderBy(F.desc("fresh"), F.desc("converted_at"), F.desc("id"))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "fresh")


def insert_absent(history: DataFrame, done: DataFrame) -> DataFrame:
    """History and those rows whose key it lacks."""
    key = history_key()
    new = done.withColumn("k", key).join(history.select(key.alias("k")), "k", "left_anti").drop("k")
    return history.unionByName(new)


def search_history(history: DataFrame, needle: str) -> DataFrame:
    return history.filter(F.contains(F.lower("file_name"), F.lit(needle.lower())))


def history_csv(history: DataFrame) -> DataFrame:
    """(id, line): the rows of the exported table, every field quoted, time in ISO form, seconds rounded."""
    q = T.csv_quote
    time = F.date_format("converted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    secs = F.floor(F.col("duration_ms") / 1000 + 0.5).cast("string")
    return history.select("id", F.concat_ws(",", q(F.col("file_name")), q(F.col("source_path")), q(F.col("language")), q(F.col("total_pages").cast("string")), q(time), q(secs)).alias("line"))


def rank_models(models: DataFrame, n: int | None = None) -> DataFrame:
    """Free models first, then longer contexts (none counts as 0), then ids."""
    out = models.orderBy(F.desc("is_free"), F.desc(F.coalesce("context_length", F.lit(0))), "id")
    return out if n is None else out.limit(n)


def top_free(models: DataFrame, n: int = 5) -> DataFrame:
    return rank_models(models.filter("is_free"), n)


def without_skipped(models: DataFrame, skipped: DataFrame) -> DataFrame:
    return models.join(skipped.select("id"), "id", "left_anti")


def fallback(stage: str, provider: str, default: str):
    """The stage's model, else the provider's, else the default; empty counts as none."""
    none = F.lit("")
    return F.coalesce(F.nullif(F.col(stage), none), F.nullif(F.col(provider), none), F.col(default))


def queue_snapshot(jobs: DataFrame) -> DataFrame:
    """Jobs to restore: errors are queued again, running ones are interrupted, done ones are left out."""
    status = F.when(F.col("status") == "error", "queued").when(F.col("status") == "converting", "interrupted").otherwise(F.col("status"))
    return jobs.filter(F.col("status").isin("queued", "converting", "error")).withColumn("status", status)


def unique_paths(files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Adds unique_path: each file's path, or with the first free `` (i)`` before its extension.

    present(path): names that are taken already. Files of one path take free numbers in the order of their ids; names
    of the batch itself are taken too, so a file that is called ``a (1).pdf`` keeps its name.
    """
    ext = r"(\.[^./]*)\z"
    parts = lambda df: df.withColumn("base", F.regexp_replace("path", ext, "")).withColumn("ext", F.regexp_extract("path", ext, 1))
    taken = files.select("path").unionByName(present.select("path")) if present is not None else files.select("path")
    numbered = parts(taken.distinct()).select(F.regexp_replace("base", r" \(\d+\)\z", "").alias("base"), "ext", F.regexp_extract("base", r" \(([1-9]\d{0,8})\)\z", 1).alias("i")).filter("i <> ''")
    used = numbered.groupBy("base", "ext").agg(F.array_sort(F.collect_set(F.col("i").cast("int"))).alias("used"))
    first = F.row_number().over(W.partitionBy("path").orderBy("id")) - 1
    here = files.withColumn("k", first)
    if present is not None:
        here = here.join(present.select("path").distinct().withColumn("there", F.lit(1)), "path", "left").withColumn("k", F.col("k") + F.coalesce("there", F.lit(0))).drop("there")
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("k").cast("int"), lambda k, u: F.when(u <= k, k + 1).otherwise(k))  # the k-th number that isn't used
    out = parts(here).join(used, ["base", "ext"], "left")
    return out.withColumn("unique_path", F.when(F.col("k") == 0, F.col("path")).otherwise(F.concat("base", F.lit(" ("), free.cast("string"), F.lit(")"), "ext"))).drop("k", "base", "ext", "used")


def retry_schedule(models: list[str], attempts: int, kind: str):
    """Rows (attempt, model, delay_s) of the retry plan: two tries a model, in rotation."""
    wait = {"skip": F.lit(2), "rate": F.lit(10), "overload": F.lit(30)}.get(kind, F.col("attempt") * 5)
    model = F.element_at(F.array(*map(F.lit, models)), (F.floor((F.col("attempt") - 1) / 2) % len(models) + 1).cast("int"))
    return lambda spark: spark.range(1, attempts + 1).select(F.col("id").alias("attempt")).select("attempt", model.alias("model"), wait.cast("long").alias("delay_s"))


def cached_models(cache: DataFrame, now_ms: int, ttl_ms: int = MODEL_TTL_MS) -> DataFrame:
    """Cached listings younger than the time to live."""
    return cache.filter(F.lit(now_ms) - F.col("cached_at") < ttl_ms)


def text_models(models: DataFrame) -> DataFrame:
    """Models whose output side of ``in->out`` modalities is text alone; one that states none is left out."""
    return models.filter(F.trim(F.try_element_at(F.split("modality", "->"), F.lit(2))) == "text")


# Which ids of a service's listing are models for documents (all of the first, none of the second).
LISTED = {
    "gemini": ((r"(?i)flash|pro", r"(?i)gemini-(2|3|4)"), r"(?i)thinking|embedding|aqa|text|tts"),
    "openai": ((r"^(gpt-|o\d)",), r"(?i)instruct|embed|whisper|tts|dall"),
}


def listed_models(models: DataFrame, service: str) -> DataFrame:
    """The models of a service's listing whose ids its patterns let through; of a service without patterns, all."""
    wanted, unwanted = LISTED.get(service, ((), None))
    for p in wanted:
        models = models.filter(F.col("id").rlike(p))
    return models if unwanted is None else models.filter(~F.col("id").rlike(unwanted))


def newest_history(history: DataFrame, n: int) -> DataFrame:
    """The newest entries with their place, ties by id: a top-k, merged from partial ones."""
    return _placed(history.orderBy(F.desc("converted_at"), F.desc("id")).limit(n), F.struct("converted_at", "id"))


def newest_groups(log: DataFrame, n: int) -> DataFrame:
    """Log groups by their latest entry, newest first, ties by job, with their place."""
    return _placed(log_groups(log).orderBy(F.desc("latest"), F.desc("job_id")).limit(n), F.struct("latest", "job_id"))


def ids_descending(models: DataFrame, n: int, collation: str = "UNICODE") -> DataFrame:
    """The last model ids in the order of a locale (punctuation, then digits, then letters whatever their case), with their place.

    Ids that are equal to the locale go by code points.
    """
    key = F.collate("id", collation)
    return _placed(models.select("id").distinct().orderBy(key.desc(), F.desc("id")).limit(n), F.struct(key.alias("k"), "id"))


def _placed(few: DataFrame, key) -> DataFrame:
    """Adds place, from 1, by a key that is largest first; of a bounded number of rows."""
    rows = F.sort_array(F.collect_list(F.struct(key.alias("k"), F.struct(*few.columns).alias("r"))), asc=False)
    return few.agg(rows.alias("rows")).select(F.posexplode("rows").alias("p", "x")).select("x.r.*", (F.col("p") + 1).alias("place"))


def retry_delay(kind, attempt):
    """Seconds before the next try after one that failed: skipped model, rate limit, overload, else five a try."""
    return F.when(kind == "skip", 2).when(kind == "rate", 10).when(kind == "overload", 30).otherwise(attempt * 5)


def rotated(models: list[str], attempt, tries: int = 2):
    """The model of a try (from 1): so many tries each, in turn."""
    return F.element_at(F.array(*map(F.lit, models)), (F.floor((attempt - 1) / tries) % len(models) + 1).cast("int"))


def stored(store: DataFrame, kind: str) -> DataFrame:
    """(job_id, content) of the documents of one kind in a store by (kind, job_id); of several the last written counts."""
    w = W.partitionBy("job_id").orderBy(F.desc("written_at"))
    return store.filter(F.col("kind") == kind).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("job_id", "content")


def session_skips(failures: DataFrame) -> DataFrame:
    """(session, model, reason): the models a session skips, with the last reason given."""
    return failures.groupBy("session", "model").agg(F.max_by("reason", "at").alias("reason"))


def text_progress(pieces: DataFrame) -> DataFrame:
    """Adds chars: the characters received so far of each answer."""
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return pieces.withColumn("chars", F.sum(F.length("piece")).over(w))


def deduped_styles(styles: DataFrame) -> DataFrame:
    """One definition a style id: the last with an outline level, else the last."""
    best = F.max_by("xml", F.struct("has_outline", "at"))
    return styles.withColumn("has_outline", F.contains("xml", F.lit("w:outlineLvl"))).groupBy("style_id").agg(best.alias("xml"))


def reusable(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Adds reuse_id to translation jobs: the history entry of the same path without a language."""
    done = history.filter(F.coalesce("language", F.lit("")) == "").groupBy("source_path").agg(F.max_by("id", F.struct("converted_at", "id")).alias("reuse_id"))
    return jobs.join(done, "source_path", "left")


def available_priority(priority: DataFrame, available: DataFrame) -> DataFrame:
    """The models of a priority list that can be had, in its order."""
    return priority.join(available.select("id"), "id", "left_semi")


def available_in_order(priority: DataFrame, available: DataFrame, *of: str) -> DataFrame:
    """What of priority lists (of, id, place) can be had, with its place in what is left of each list, from 1."""
    left = priority.join(available.select("id").distinct(), "id", "left_semi")
    return left.select(*of, "id", F.row_number().over(W.partitionBy(*of).orderBy("place")).alias("place"))


def new_jobs(files: DataFrame) -> DataFrame:
    """A queued job for each file, with defaults and a generated id."""
    return files.select(F.expr("uuid()").alias("id"), "file_name", "source_path", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error"))


def migrated(settings: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings with each missing or null field at its default."""
    have = set(settings.columns)
    return settings.select(*[(F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v)).alias(k) for k, v in defaults.items()], *[c for c in settings.columns if c not in defaults])


def rehydrated(jobs: DataFrame, progress: DataFrame, files: DataFrame) -> DataFrame:
    """The queue after a restart: unfinished jobs with their progress(id, done), if their file still is there or some progress is."""
    known = files.select("file_name").distinct().withColumn("there", F.lit(True))
    both = queue_snapshot(jobs).join(progress, "id", "left").join(known, "file_name", "left")
    return both.filter(F.col("there").isNotNull() | F.col("done").isNotNull()).drop("there")


def with_history(files: DataFrame, history: DataFrame) -> DataFrame:
    """Adds earlier: the number of history entries with the file's key."""
    known = history.groupBy(history_key().alias("k")).agg(F.count("*").alias("n"))
    return files.withColumn("k", history_key()).join(known, "k", "left").withColumn("earlier", F.coalesce("n", F.lit(0))).drop("k", "n")


def moved(queue: DataFrame, source: int, target: int) -> DataFrame:
    """(id, job_id, place): each job's entries in time order, the one at place source moved to target."""
    w = W.partitionBy("job_id")
    at = queue.withColumn("at", F.row_number().over(w.orderBy("ts", "id")))
    key = F.when(F.col("at") == source, target + (0.5 if source < target else -0.5)).otherwise(F.col("at"))
    return at.withColumn("key", key).select("id", "job_id", F.row_number().over(w.orderBy("key")).alias("place"))
