"""Files one by one: whole or not at all, errors as rows."""

import os

import pytest
from pyspark.sql import functions as F

from quire.sources.writer import DocumentFiles, DocumentWriter, Staged, failures, save

KIND = "name string, format string, content string"


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(path) for f in fs if not f.startswith((".", "_")) and "_errors" not in d}


def test_a_file_for_each_document_and_format(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"d{k % 3}/doc {k}", kind, f"{kind} é {k}\n" * (k + 1)) for k in range(40) for kind in ("md", "json", "html")]
    save(spark.createDataFrame(rows, KIND).repartition(5), out)
    assert tree(out) == {f"{n}.{f}": c for n, f, c in rows}
    assert sorted(os.listdir(out)) == ["_SUCCESS", "_errors", "d0", "d1", "d2"]
    assert failures(spark, out).count() == 0


def test_bytes_are_written_as_they_are(spark, tmp_path):
    save(spark.createDataFrame([("a", "docx", bytearray(b"\x00\xff"))], "name string, format string, content binary"), str(tmp_path))
    assert (tmp_path / "a.docx").read_bytes() == b"\x00\xff"


def test_what_cannot_be_written_is_a_row_and_stops_nothing(spark, tmp_path):
    out = str(tmp_path)
    bad = [(None, "md", "x"), ("", "md", "x"), ("n", "md", None), ("../up", "md", "x"), ("/root", "md", "x"), ("a/../../b", "md", "x"), ("_hidden", "md", "x"), ("x" * 300, "md", "x")]
    save(spark.createDataFrame([*bad, ("good", "md", "y"), ("plain", None, "z")], KIND).repartition(3), out)
    assert tree(out) == {"good.md": "y", "plain": "z"}
    told = {(r.name, r.error if len(r.name or "") < 200 else "") for r in failures(spark, out).collect()}
    assert told == {(None, "no name"), ("", "no name"), ("n", "no content"), ("../up", "not a name below the folder"), ("/root", "not a name below the folder"), ("a/../../b", "not a name below the folder"), ("_hidden", "not a name below the folder"), ("x" * 300, "")}
    save(spark.createDataFrame([("good", "md", "again")], KIND), out)
    assert failures(spark, out).count() == 0 and tree(out)["good.md"] == "again"


def test_files_that_are_there(spark, tmp_path):
    out, df = str(tmp_path), spark.createDataFrame([("a", "md", "new"), ("b", "md", "new")], KIND)
    (tmp_path / "a.md").write_text("old")
    save(df, out, existing="keep")
    assert tree(out) == {"a.md": "old", "b.md": "new"}
    save(df.filter("name = 'a'"), out, existing="error")
    assert [tuple(r) for r in failures(spark, out).collect()] == [("a", "md", "there is such a file")]
    save(df, out)
    assert tree(out) == {"a.md": "new", "b.md": "new"}


def test_a_job_that_fails_leaves_the_old_files(spark, tmp_path):
    out = str(tmp_path)
    (tmp_path / "a.md").write_text("old")
    df = spark.createDataFrame([("a", "md", "new"), ("b", "md", "boom")], KIND).repartition(2)
    with pytest.raises(Exception, match="boom"):
        save(df.withColumn("content", F.when(F.col("content") == "boom", F.raise_error(F.lit("boom"))).otherwise(F.col("content"))), out)
    assert tree(out) == {"a.md": "old"} and not [f for f in os.listdir(out) if f.startswith("_staging")]


def test_only_tasks_that_count_are_renamed(spark, tmp_path):
    w = DocumentWriter({"path": str(tmp_path)}, spark.createDataFrame([], KIND).schema)
    batches = spark.createDataFrame([("a", "md", "x")], KIND).toArrow().to_batches()
    counted, lost = w.write(iter(batches)), w.write(iter(batches))
    assert isinstance(lost, Staged) and not os.path.exists(tmp_path / "a.md")
    w.commit([counted, None])
    assert tree(tmp_path) == {"a.md": "x"} and sorted(os.listdir(tmp_path)) == ["_SUCCESS", "_errors", "a.md"]


def test_bad_options(spark):
    schema = spark.createDataFrame([], KIND).schema
    for options in ({}, {"path": "/x", "existing": "maybe"}):
        with pytest.raises(ValueError, match="documents"):
            DocumentWriter(options, schema)
    with pytest.raises(ValueError, match="content"):
        DocumentWriter({"path": "/x"}, spark.createDataFrame([], "name string, format string").schema)
    assert DocumentFiles.name() == "documents"
