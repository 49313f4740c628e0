"""What keeps the work on a line, a row or a task small: tests of the paths taken, not of seconds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T
from quire.functions import values as V
from quire.operators import export as EX
from quire.operators import folds as FO
from quire.operators import headings as H
from quire.operators import outline as O
from quire.sources import providers as P


def _never(*_, **__):
    raise AssertionError("worked out although there is nothing to work out")


def test_html_of_plain_lines_makes_no_runs(monkeypatch):
    monkeypatch.setattr(M, "inline_runs", _never)
    page = EX.html_of(["## A > B", "plain \"text\" here", "", "| a | b |"])
    assert page.split("\n")[1:-1] == ["<h2>A &gt; B</h2>", "<p>plain \"text\" here</p>", "<table><tr><td>a</td><td>b</td></tr></table>"]


@pytest.mark.parametrize("text", ["", "plain", "see [x] ^y", "a > b"])
def test_plain_text_is_one_run(monkeypatch, text):
    monkeypatch.setattr(M, "MARK", None)
    assert M.inline_runs(text) == [{"text": text, "bold": False, "italic": False, "sup": False, "sub": False, "brk": False, "note": None}]


def test_word_files_are_read_back_by_fixed_patterns():
    data = EX.docx_of(["# T", "see[^1] x<sup>2</sup>y &amp; z", "[^1]: said"])
    xml = EX.zipfile.ZipFile(EX.io.BytesIO(data)).read("word/document.xml").decode()
    paras = ["".join(EX.SAID.findall(p)) for p in EX.PARA.findall(EX.RAISED.sub("", xml))]
    assert paras == ["T", "see xy &amp; z"]


def test_trimming_looks_at_the_ends_only(spark):
    ends = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    rows = [(f"{x}a{x} b{x}{x}", f"a{x} b") for x in ends] + [("\u200ba\x1c", "\u200ba\x1c"), (ends, ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.js_trim(F.col("t")))
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_go_to_python_in_bounded_batches(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for key in keys:
        spark.conf.unset(key)
    docs = spark.range(2500).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(" some text ").alias("text"))
    out = P.translate(FO.translate_chunks(docs), "Latin", ["m1"])
    sizes = F.pandas_udf(lambda s: s * 0 + len(s), "long")
    assert docs.select(sizes("doc_id").alias("n")).agg(F.max("n")).first()[0] <= 1000
    assert int(spark.conf.get(keys[1])) <= 8 << 20
    assert {tuple(r) for r in out.select("text").distinct().collect()} == {("[m1] some text",)} and out.count() == 2500


def test_correction_ranges_read_the_lines_once(spark, monkeypatch):
    kept, seen = FO.checkpointed, []
    monkeypatch.setattr(FO, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    n = F.col("id") % 7
    lines = spark.range(14).select((F.col("id") > 6).cast("int").alias("doc_id"), n.cast("int").alias("line_no"), F.when(n.isin(2, 5), "").otherwise("two words").alias("line"))
    found = FO.correction_ranges(lines, 3).orderBy("doc_id", "chunk_no").collect()
    assert [tuple(r) for r in found] == [(d, k, a, z) for d in (0, 1) for k, a, z in ((0, 0, 3), (1, 3, 6), (2, 6, 7))]
    assert [x.count("Range (") for x in seen] == [1]


def test_heads_are_read_once_a_field(spark):
    text = '---\na: 1\nb: "2"\n: none\nword\na: "3" \nc d: 4\nb: \n---\nrest'
    df = spark.createDataFrame([(text,), ("no head",), (None,)], "t string").select(V.frontmatter_map(F.col("t")).alias("f"), V.head_words(F.col("t")).alias("w"))
    assert [tuple(r) for r in df.collect()] == [({"": "none", "a": "3", "c d": "4", "b": ""}, {"a": "3", "b": " "}), ({}, {}), (None, None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 4 and plan.lower().count("rlike") == 0  # two heads, a key and a value


def test_titles_are_read_once_whatever_asks_for_them(spark):
    lines = spark.createDataFrame([(1, 0, "# One (4)"), (1, 1, "- Two, p. 5"), (1, 2, "## (7)"), (1, 3, "* ... 3")], "doc_id long, line_no int, line string")
    entries = O.parse_outline(lines)
    assert sorted((r.entry_no, r.text, r.norm, r.page) for r in entries.collect()) == [(0, "One", "one", "4"), (1, "Two", "two", "5")]
    asked = O.missing_titles(H.collect_headings(lines), entries.filter("norm is not null"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\.{3,}") == 2 * 2  # two sources, a test and a cut each
    assert sorted(r.norm for r in asked.collect()) == ["two"]
