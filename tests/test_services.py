"""Links, failed calls, listings, and models that are asked once."""

import pytest
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import convert, folds, jobs, services
from quire.sources import providers


@pytest.mark.parametrize(
    ("url", "safe"),
    [
        ("javascript:alert(1)", False), (" javascript:alert(1)", False), ("java\tscript:alert(1)", False), ("\x01javascript:alert(1)", False), ("1x:y", False), ("tel:1", False), ("DATA:text/html,x", False), (":x", False), ("vbscript:x", False),
        ("http\n:x", False), ("data:image/png;base64,", True), ("HTTPS://x", True), ("mailto:a", True), ("xmpp:a", True), ("irc:a", True), ("a/b:c", True), ("?a:b", True), ("#a:b", True), ("plain", True), ("", True),
    ],
)
def test_links(spark, url, safe):
    assert spark.createDataFrame([(url,)], "url string").select(V.is_safe_url("url").alias("s")).first().s is safe


def test_failures_by_service(spark):
    rows = [
        ("mistral", 404, None, None, None, "persistent", "model not found"), ("mistral", None, None, None, "503 service unavailable", "overloaded", "service overloaded (503)"), ("gemini", None, "RESOURCE_EXHAUSTED", None, None, "limited", "rate limited"),
        ("anthropic", 529, None, None, None, "overloaded", "API overloaded"), ("anthropic", 200, None, True, None, "persistent", "request declined"), ("openai", 402, None, None, None, "", "insufficient credits"), ("custom", 402, None, None, "x" * 90, "", "x" * 60),
        ("custom", 502, None, None, None, "", "server error (502)"), ("mistral", None, None, None, "Unauthorized", "persistent", "Unauthorized"), ("new", 429, None, None, None, "", "unknown error"), ("mistral", None, None, None, None, "", "unknown error"),
    ]
    calls = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, service string, status int, code string, refusal boolean, message string")
    for got, want in zip(services.failures(calls).orderBy("i").collect(), rows):
        assert [k for k in ("limited", "overloaded", "persistent") if got[k]] == [k for k in want[5].split(",") if k], want
        assert got.summary == want[6]


def test_a_second_rate_limit_skips_the_model(spark):
    failed = spark.createDataFrame([("a", 1, "m", False, True), ("a", 2, "m", False, True), ("a", 1, "n", False, True), ("b", 1, "n", True, False)], "job_id string, attempt int, model string, persistent boolean, limited boolean")
    assert sorted(tuple(r) for r in services.skipped_models(failed).collect()) == [("a", "m"), ("b", "n")]


def test_models_are_asked_once_whatever_uses_their_answer(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "doc_id long, pages array<string>")
    done = convert.convert(docs, ["m1"])
    files = spark.createDataFrame([(1, "a.pdf", 2, "2024-01-01")], "doc_id long, file_name string, pages int, date string")
    used = [done.filter("text is not null").filter(F.length("text") > 0), convert.with_head(done, files, "echo", "m1"), providers.translate(spark.createDataFrame([(1, 0, "x")], "doc_id long, chunk_no int, text string"), "Latin", ["m1"]).filter("text is not null")]
    for df in used:
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_documents_of_one_id_are_translated_apart(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(1, "b c"), (1, "a"), (1, "a"), (2, None), (None, "x\n---\ny"), (None, " z\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["translate_stub"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(db.sql(entry.oracle_sql()["translate_stub"]).fetchall(), key=str)


def test_long_documents_are_translated_in_chunks(spark):
    text = "\n".join(f"# H{i}\n" + "w " * 30 for i in range(6))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    done = providers.translate_documents(docs, "Latin", ["m1"], most=70)
    assert [tuple(r) for r in done.collect()] == [tuple(r) for r in providers.translate(folds.translate_chunks(docs, 70), "Latin", ["m1"]).collect()]
    assert done.first().text.count("[m1] ") == 3


def test_ids_in_locale_order(spark):
    ids = ["b", "B", "a-1", "a_1", "a1", "Ä", "z", "2", "10"]
    got = [r.id for r in jobs.ids_descending(spark.createDataFrame([(x,) for x in [*ids, "b"]], "id string"), 9).orderBy("place").collect()]
    assert got == ["z", "B", "b", "a1", "a-1", "a_1", "Ä", "2", "10"] != sorted(ids, reverse=True)


def test_priority_without_gaps(spark):
    lists = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("x", "c", 3), ("y", "b", 1)], "stage string, id string, place int")
    have = spark.createDataFrame([("c",), ("a",), ("a",)], "id string")
    assert sorted(tuple(r) for r in jobs.available_in_order(lists, have, "stage").collect()) == [("x", "a", 1), ("x", "c", 2)]
