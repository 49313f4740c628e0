"""Semantics of single documents, and the DataFrame operators against plain models of them."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as X
from quire.operators import edits, export, folds
from quire.operators import headings as H
from quire.operators import notes as N
from quire.sources import providers

LINE = st.sampled_from(["# A", "## B", "### B", "####### Deep", "<!-- heading-level: 8 -->", "###### Six", "```", "~~~", "text", "", "<!-- page: 3 -->", "## Contents", "## Ch ... 12", " # indented", "## x ##", "#no"])


def frame(spark, *docs):
    return spark.createDataFrame([(i, n, x) for i, d in enumerate(docs) for n, x in enumerate(d)], "doc_id long, line_no int, line string")


def lines_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.line_no)):
        out.setdefault(r.doc_id, []).append(r.line)
    return out


def test_nine_levels_and_twins():
    raw = ["# Level 1", "###### Level 6", "####### Level 7", "<!-- heading-level: 8 -->", "#### Level 8", "######### Level 9"]
    assert [h.level for h in M.headings(raw)] == [1, 6, 7, 8, 9]
    assert M.normalize(raw) == ["# Level 1", "###### Level 6", "<!-- heading-level: 7 -->", "###### Level 7", "<!-- heading-level: 8 -->", "###### Level 8", "<!-- heading-level: 9 -->", "###### Level 9"]
    assert [h.level for h in M.headings(["<!-- heading-level: 8 -->", "####### x"])] == [7]
    assert M.normalize(["<!-- heading-level: 8 -->", "####### x"]) == ["<!-- heading-level: 8 -->", "###### x"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINE, min_size=1, max_size=14), min_size=8, max_size=24))
def test_windows_equal_line_by_line_models(spark, docs):
    df = frame(spark, *docs)
    got = {}
    for r in H.collect_headings(df).collect():
        got.setdefault(r.doc_id, []).append((r.level, r.text, r.start_line_no, r.line_no))
    for i, d in enumerate(docs):
        assert sorted(got.get(i, []), key=lambda x: x[2]) == [(h.level, h.text, h.start, h.line) for h in M.headings(d)]
    norm = lines_of(H.normalize_syntax(df))
    assert all(norm[i] == M.normalize(d) for i, d in enumerate(docs))


def test_running_headers_survive_alternately(spark):
    doc = [f"x{i}" for i in range(200)]
    for i in range(0, 200, 40):
        doc[i] = "# Same"
    assert M.repeated_headings(doc) == {40, 120}
    left = lines_of(folds.drop_repeated_headings(frame(spark, doc)))[0]
    assert left.count("# Same") == 3
    assert M.repeated_headings(["# A", "## C", "# B", "## C"]) == set()


def test_toc_ends():
    assert M.toc_headings(["# Contents", "## A ... 1", "text", "## B .. 2", "## C", "## D .. 3"]) == {0, 1, 3}
    assert M.toc_headings(["## Contents", "### A . 1", "<!-- page: 1 -->", "### B . 2"]) == {0, 1}
    assert M.toc_headings(["## Inhaltsverzeichnis", "# A . 1"]) == {0}


def test_clean_leaves_good_documents_alone():
    doc = ["# A", "", "## B", "text", "## C", "# D", "## B"]
    assert M.clean(doc) == doc
    assert M.clean(["## ## B"]) == ["## B"]
    assert M.clean(["<!-- Document Outline -->", "## T (page 3)", "---", "# Body"]) == ["<!-- Document Outline -->", "  - T (page 3)", "---", "# Body"]


def test_labels_and_chunks():
    assert M.rename_labels(["[^1]: a", "x[^1]\n[^1]: b\n[^1_2]: c"]) == (["[^1]: a", "x[^1_3]\n[^1_3]: b\n[^1_2]: c"], 1)
    text = "\n".join(f"# H{i}\n" + "w " * 30 for i in range(6))
    parts = M.translate_chunks(text, 70)
    assert len(parts) == 3 and " ".join(parts).split() == text.split()
    assert M.translate_chunks("") == [""]
    assert M.correction_ranges(["a b", "", "c d", ""], 2) == [(0, 2), (2, 4)]


def test_streams_pages_and_numerals():
    event = 'data: {"choices":[{"delta":{"content":"ab"}}]}\n'
    assert M.sse_text([event[:9], event[9:], "data: [DONE]\n", "data: {bad\n", ": x\n"]) == "ab"
    with pytest.raises(RuntimeError, match="no"):
        M.sse_text(['data: {"error":{"message":"no"}}\n'])


def test_scanned_pages(spark):
    pages = [
        ("12 Title\nbody", "12 Title", "13", "<!-- page: 12-13 -->\nbody"), ("body", None, None, "body"), (None, "x", None, "<!-- page: x -->\n"), ("Head\nHead\ntext", "Head", None, "Head\ntext"), ("text\n  \nA.B (1)*\n\nmore", "A.B (1)*", None, "text\n  \nmore"),
        ("b", "xii\nfoo", "XI", "<!-- page: xi-xii -->\nb"), ("b", "iiii", "mix", "<!-- page: mix -->\nb"), ("b", "7 8", "12345", "<!-- page: 7 -->\nb"), ("b", "9", "iv 3", "<!-- page: iv-9 -->\nb"), ("a\\E$1 b\nc", "a\\E$1 b", None, "c"), ("see ![](i1) b", "", "", "see ![](data:x) b"),
    ]
    rows = spark.createDataFrame([(k, 0, *p[:3], {"i1": "data:x"} if k % 2 == 0 else None) for k, p in enumerate(pages)], "doc_id int, index int, markdown string, header string, footer string, images map<string,string>")
    assert {r.doc_id: r.text for r in folds.ocr_texts(rows).collect()} == {k: p[3] for k, p in enumerate(pages)}
    numerals = spark.createDataFrame([(x,) for x in ("iv", "MCMXCIV", "iiii", "", "ab")], "x string").select(X.roman_value(F.col("x")).alias("v")).collect()
    assert [r.v for r in numerals] == [4, 1994, None, None, None]


def test_edit_language(spark):
    lines = frame(spark, ["# A", "", "## b", "text", "**New**", "", "# C", "## d"])
    outline = frame(spark, ["# A2", "## New", "## Added"])
    cmds = frame(spark, ["- RETITLE | 1 | A2", "demote|3", "PROMOTE | 5 | 2", "INSERT|6|2|added", "RELEVEL|7|3", "MERGE_UP | 8", "RELEVEL|99|2", "RELEVEL|7|12", "NONE", "PROMOTE|4|2"])
    r = edits.apply_commands(lines, edits.parse_commands(cmds), outline).first()
    assert r.text.split("\n") == ["# A2", "", "**b**", "text", "## New", "", "## Added", "", "### C d", ""]
    assert (r.retitle, r.relevel, r.merge, r.demote, r.promote, r.insert, r.rejected) == (1, 1, 1, 1, 1, 1, 2)


def test_notes(spark):
    df = frame(spark, ["a[^1] b[^3]", "```", "[^9]", "```", "[^1]: x", "[^2]: [Endnote 2]", "[^3]: y"])
    assert [r.n for r in N.note_refs(df).orderBy("line_no", "seq").collect()] == [1, 3]
    gaps = {(r.kind, r.n, r.line_no) for r in N.gap_fill(df).collect()}
    assert gaps == {("ref", 2, 0)}
    assert N.without_placeholders(df).count() == 6
    assert N.gap_fill(df.filter("line_no > 3")).count() == 0


def test_retries_follow_the_plan():
    class Failing(providers.Provider):
        def __init__(self, kinds):
            self.kinds = kinds

        def call(self, model, prompt):
            if self.kinds:
                raise providers.ProviderError("x", self.kinds.pop(0))
            return model

    skip = set()
    assert providers.call(Failing(["persistent"]), ["a", "b"], "", skip, lambda s: None) == ("a", "a", [2])
    assert skip == {"a"}
    assert providers.call(Failing(["rate", "overload", "other"]), ["a", "b"], "", None, lambda s: None)[2] == [10, 30, 15]
    assert providers.call(Failing(["overload"] * 3), ["a"], "", None, lambda s: None) == ("a", "a", [30, 60, 60])
    with pytest.raises(providers.ProviderError):
        providers.call(Failing([]), ["a"], "", {"a"}, lambda s: None)


def test_exports(spark):
    nine = [x for n in range(1, 10) for x in (*M.serialize(n, f"L{n}"), "")]
    data = export.docx_of([*nine, "see[^1] again[^1]", "", "[^1]: note & *text*"])
    assert data == export.docx_of([*nine, "see[^1] again[^1]", "", "[^1]: note & *text*"])
    z = zipfile.ZipFile(io.BytesIO(data))
    doc, styles = z.read("word/document.xml").decode(), z.read("word/styles.xml").decode()
    assert all(f'w:val="Heading{n}"' in doc for n in range(1, 10)) and 'w:outlineLvl w:val="8"' in styles and "heading-level" not in doc
    assert doc.count("footnoteReference") == 1 and "note &amp; " in z.read("word/footnotes.xml").decode()
    assert "[[@Page:3]]" in zipfile.ZipFile(io.BytesIO(export.docx_of(["<!-- page: 3 -->"], True))).read("word/document.xml").decode()
    page = export.html_of(["<!-- heading-level: 8 -->", "###### x", "| a | b |", "|---|---|", "| <i> | **d** |"])
    assert 'aria-level="8"' in page and "<td>&lt;i&gt;</td><td><strong>d</strong></td>" in page


def test_javascript_trimming(spark):
    df = spark.createDataFrame([(" \t a \n",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(X.js_trim("s")).collect()] == ["a", "", None]
    assert [r[0] for r in df.select(X.word_count("s")).collect()][1] == 1


def test_incremental_batches(spark, tmp_path):
    from quire.streaming.batches import latest, progress, run_available

    src, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, batch_no int, text string").write.parquet(src)
    go = lambda: run_available(spark, src, "doc_id long, batch_no int, text string", lambda d: d, sink, state)
    go()
    spark.createDataFrame([(1, 1, "c")], "doc_id long, batch_no int, text string").write.mode("append").parquet(src)
    go()
    go()
    out = spark.read.parquet(sink)
    assert out.count() == 3
    assert {(r.batch_no, r.text) for r in latest(out, "doc_id", "batch_no").collect()} == {(0, "a"), (1, "c")}
    assert progress(out, spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, total long")).orderBy("doc_id").first().percent == 67


def test_values(spark):
    from quire.functions import values as V

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x00" * 4
    df = spark.createDataFrame([(png,), (jpeg,), (b"GIF",), (None,)], "content binary")
    assert [tuple(r.s) for r in df.select(V.image_size("content").alias("s")).collect()] == [(640, 480), (40, 30), (None, None), (None, None)]
    one = spark.createDataFrame([("a&amp;lt;b", "12_2", "**A** `b` [c](d) _e_", "javascript:x")], "a string, b string, c string, d string")
    r = one.select(V.decode_entities(F.col("a")), V.shown_label(F.col("b")), V.plain_label(F.col("c")), V.is_safe_url(F.col("d"))).first()
    assert tuple(r) == ("a<b", "12", "A b c e", False)
    head = spark.createDataFrame([('---\na: "x: y"\nb: 1\na: z\nbad\n---\nbody',), ("none",)], "t string")
    assert [x[0] for x in head.select(V.frontmatter_map(F.col("t"))).collect()] == [{"a": "z", "b": "1"}, {}]
    assert M.frontmatter('---\na: "x: y"\nb: 1.5\n---\nbody') == ({"a": "x: y", "b": 1.5}, "body")


def test_files(spark, tmp_path):
    from quire.sources import files

    (tmp_path / "a.md").write_text("# A\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "s.json").write_text('{"id": "1"')
    assert [r.text for r in files.markdown_files(spark, str(tmp_path)).collect()] == ["# A\n"]
    assert files.pdf_files(spark, str(tmp_path)).count() == 1
    assert files.json_state(spark, str(tmp_path / "s.json"), "id string").first().id in (None, "1")
    ranges = files.page_ranges(spark.createDataFrame([(1, 7), (2, 0)], "doc_id long, pages int"), 5)
    assert [tuple(r) for r in ranges.orderBy("start").collect()] == [(1, 0, 0, 5), (1, 1, 5, 7)]
    done = files.save_formats(spark.range(3), str(tmp_path / "out"), {"json": lambda d, p: d.write.json(p), "bad": lambda d, p: 1 / 0})
    assert done == [("json", None), ("bad", "division by zero")] and spark.read.json(str(tmp_path / "out/json")).count() == 3


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINE, min_size=1, max_size=30), st.dictionaries(st.integers(0, 9), st.integers(-1, 12), min_size=1))
def test_new_levels_by_ordinal(spark, lines, changes):
    canon = M.normalize(lines)
    found = M.headings(canon)
    new = {h.start: M.serialize(changes[i], h.text) for i, h in enumerate(found) if i in changes}
    gone = {h.line for i, h in enumerate(found) if i in changes and h.line != h.start}
    want = [y for n, x in enumerate(canon) if n not in gone for y in new.get(n, [x])]
    rows = spark.createDataFrame([(0, k, v) for k, v in changes.items()], "doc_id long, h_no int, new_level int")
    assert lines_of(H.relevel(frame(spark, lines), rows)) == {0: want}


def test_expected_rows_of_the_line_operators(spark):
    """Rows written down from what the operators are meant to do, not from what they do."""
    from quire.functions import values as V

    df = frame(spark, ["a[^1] b", "  [^2]: two", "[^3]: [Endnote 3]", "```", "[^4]: kept", "```", "[^x]:\tthree"])
    assert lines_of(N.endnotes_to_links(df))[0] == ["a[1](#en-1) b", "  [2](#en-2) two", "```", "[^4]: kept", "```", "[x](#en-x) three"]
    pages = spark.createDataFrame([("Page 12 of 300", "ix"), ("VIVID", "x"), (None, "a XIV b"), ("iiii", "IV"), ("12345", None), ("7\n", "9")], "f string, h string")
    assert [r[0] for r in pages.select(X.printed_page(F.col("f"), F.col("h"))).collect()] == ["12", "x", "xiv", "iv", None, "7"]
    roman = spark.createDataFrame([("iiii",), ("vivid",), ("XLII",), ("",)], "r string")
    assert [r[0] for r in roman.select(X.roman_value(F.col("r"))).collect()] == [None, None, 42, None]
    fence = spark.createDataFrame([("```markdown x```",), ("```md\ny\n```",), (" z ",), ("```\na",)], "t string")
    assert [r[0] for r in fence.select(X.strip_code_fence(F.col("t"))).collect()] == ["x", "y", "z", "a"] == [M.strip_fence(t) for t in ("```markdown x```", "```md\ny\n```", " z ", "```\na")]
    marks = spark.createDataFrame([("&#99999999999;|&#55296;|&#65;|&amp;#66;|&nbsp;",)], "t string")
    assert marks.select(V.decode_entities(F.col("t"))).first()[0] == chr(99999999999 % 65536) + "|\ufffd|A|B|\u00a0"
    assert M.inline_runs("&#99999999999;&#55296;" + "&#" + "9" * 5000 + ";")[0]["text"][1] == "\ufffd"
    block = spark.createDataFrame([("x\n<!--Document Outline   -->\n\n# A \n\n---\nrest",)], "t string")
    assert block.select(V.outline_block(F.col("t"))).first()[0] == "# A"


def test_outline_levels_by_the_converter(spark):
    from quire.operators import outline as O

    plan = frame(spark, ["## Intro - 12", "- 1. Body (4)", "    - **Body**", "# A. End (xi-xvi)"])
    heads = H.collect_headings(frame(spark, ["# Intro", "# intro - 12", "# Body", "# End"]))
    got = {r.text: r.new_level for r in O.remap_levels(heads, plan).collect()}
    assert got == {"Intro": 1, "intro - 12": 2, "Body": 1, "End": 1}


def test_heads_are_set_aside(spark):
    doc = ["---", "# not a heading", "---", "# A", "## B"]
    rows = spark.createDataFrame([(0, 0, 3)], "doc_id long, h_no int, new_level int")
    assert lines_of(H.relevel(frame(spark, doc), rows))[0] == ["---", "# not a heading", "---", "### A", "## B"]
    text = "---\ntitle: \"a \\ b\"\npages: 012\nx: 1.50\n---\n<!--  Document Outline -->\n\n- t\n\n---\nbefore\n####### Deep\nin"
    from quire.operators.headings import split_lines

    one = split_lines(spark.createDataFrame([(1, text), (2, "plain"), (3, "")], "doc_id long, text string"))
    import json

    got = {r.doc_id: json.loads(r.json) for r in export.json_export(one).collect()}
    assert got[1] == {"metadata": {"title": "a \\ b", "pages": 12, "x": 1.5}, "outline": "- t", "sections": [{"level": 0, "heading": None, "content": "before"}, {"level": 7, "heading": "Deep", "content": "in"}]}
    assert got[2] == {"metadata": {}, "outline": None, "sections": [{"level": 0, "heading": None, "content": "plain"}]}
    assert got[3] == {"metadata": {}, "outline": None, "sections": []}


def test_heading_choices(spark):
    doc = ["# A", "<!-- heading-level: 8 -->", "###### Deep", "**Title**", "Title"]
    one = lambda s, *r: spark.createDataFrame(r, s)
    assert lines_of(H.demoted(frame(spark, doc), one("doc_id long, h_no int", (0, 1))))[0] == ["# A", "Deep", "**Title**", "Title"]
    up = lines_of(H.promoted(frame(spark, doc), one("doc_id long, title string, level int", (0, "Title", 7))))[0]
    assert up == ["# A", "<!-- heading-level: 8 -->", "###### Deep", "<!-- heading-level: 7 -->", "###### Title", "Title"]


def test_unique_names(spark):
    from quire.operators import jobs

    rows = spark.createDataFrame([(1, "/a.pdf"), (2, "/a.pdf"), (3, "/a (1).pdf"), (4, "/b.pdf"), (5, "/a.pdf")], "id int, path string")
    there = spark.createDataFrame([("/b.pdf",), ("/b (2).pdf",)], "path string")
    got = {r.id: r.unique_path for r in jobs.unique_paths(rows, there).collect()}
    assert got == {1: "/a.pdf", 2: "/a (2).pdf", 3: "/a (1).pdf", 4: "/b (1).pdf", 5: "/a (3).pdf"}


def test_conversion_resumes(spark):
    from quire.operators import convert as C

    pages = ["# One\n\ntext[^1]\n\n[^1]: a", "more", "## Two\n\nsee[^1]\n\n[^1]: b", "[^2]: [footnote text not available]", "end"]
    docs = spark.createDataFrame([(1, pages), (2, []), (3, None)], "doc_id long, pages array<string>")
    whole = {r.doc_id: r for r in C.convert(docs, ["m"], size=2, wait=lambda s: None).collect()}
    assert whole[1].total == 3 and whole[1].outline == "# One\n## Two" and whole[1].skipped == []
    assert whole[1].text == "# One\n\ntext[^1]\n\n[^1]: a\n\nmore\n\n## Two\n\nsee[^1_2]\n\n[^1_2]: b\n\nend"
    assert whole[2].text == whole[3].text == ""
    part = C.convert(docs, ["m"], size=2, most=1, wait=lambda s: None).cache()
    assert {r.doc_id: r.text for r in part.collect()}[1] is None
    again = {r.doc_id: r for r in C.convert(docs, ["m"], size=2, saved=part, wait=lambda s: None).collect()}
    assert again == whole
    stable, volatile = C.batch_parts(2, 3, "NOTE STYLE: endnotes", "# One")
    assert "# One" in volatile and "2 of 3" in volatile and "gathered at the end" in stable and "2 of 3" not in stable
    assert C.assemble("NOTE STYLE: endnotes", ["[^2]: x", "[^1]: y"])[1:] == ("endnotes", "section-end")
    seen = []
    with pytest.raises(providers.ProviderError):
        providers.call(providers.provider("reader"), ["mistral-ocr-1"], "q", None, seen.append)
    assert providers.call(providers.provider("reader"), ["mistral-ocr-1", "chat"], "q\n---\nz", None, seen.append)[:2] == ("[chat] z", "chat")


def test_endnotes_in_word(spark):
    data = export.docx_of(["---", "notes: endnotes", "notes_position: section-end", "---", "a[^1]", "", "<!-- ENDNOTE-SECTION-BREAK -->", "![pic](x.png)", "", "[^1]: one"])
    z = zipfile.ZipFile(io.BytesIO(data))
    doc = z.read("word/document.xml").decode()
    assert "endnoteReference" in doc and doc.count("<w:sectPr>") == 2 and 'w:pos w:val="sectEnd"' in doc and "[pic]" in doc
    assert "one" in z.read("word/endnotes.xml").decode() and "endnotes.xml" in z.read("[Content_Types].xml").decode()
