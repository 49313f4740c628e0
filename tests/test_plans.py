"""Plans of the line operators: one shuffle by document, no Python where columns do, narrow scans."""

from quire.functions import text as X
from quire.operators import headings as H
from quire.operators import notes as N
from quire.plans import checks


def lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(1, 0, "# A", "x"), (1, 1, "b[^1]", "y")], "doc_id long, line_no int, line string, other string").write.parquet(path)
    return spark.read.parquet(path)


def test_one_shuffle_by_document(spark, tmp_path):
    df = lines(spark, tmp_path).select("doc_id", "line_no", "line")
    for plan in (H.collect_headings(df), H.sections(df), H.structural_report(H.collect_headings(df)), H.chunk_offsets(df), H.carry_pages(df), N.grouped(N.note_refs(df)), N.merge_continuations(df)):
        assert checks.shuffles(plan) == 1, checks.physical(plan)
        assert not [n for n in checks.nodes(plan) if "Python" in n or "Arrow" in n]


def test_scans_are_narrow(spark, tmp_path):
    df = lines(spark, tmp_path)
    plan = df.filter("doc_id = 1").select("doc_id", X.word_count("line").alias("n"))
    assert checks.scanned_columns(plan) == [{"doc_id", "line"}]
    assert "EqualTo(doc_id,1)" in checks.pushed_filters(plan)[0] and checks.shuffles(plan) == 0
