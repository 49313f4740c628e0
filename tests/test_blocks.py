"""Blocks, tables and runs in columns against a reading line by line."""

import json
import random
import re

from quire.functions import markdown as M
from quire.operators import blocks
from quire.plans import checks

BREAK = "<!-- ENDNOTE-SECTION-BREAK -->"
META = re.compile(r"(?i)^\s*<!--\s*heading-level:\s*([7-9])\s*-->\s*$")
ATX = re.compile(r"^(#{1,9})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$")


def read(lines, notes):
    """(kind, payload) one line after another."""
    out, i, outlined, code = [], 0, False, None
    is_row = lambda x: x.startswith("|") and x.endswith("|") and x.count("|") >= 2
    while i < len(lines):
        t = lines[i].strip()
        meta, own, below = META.match(lines[i]), ATX.match(lines[i]), ATX.match(lines[i + 1]) if i + 1 < len(lines) else None
        if t == BREAK:
            out.append(("break", ""))
        elif t.startswith("```"):
            if code is None:
                code = []
            else:
                out += [("code", "\n".join(code))] if "".join(code).strip() else []
                code = None
        elif code is not None:
            code.append(lines[i])
        elif not t:
            pass
        elif t == "---":
            outlined = False
            out.append(("rule", ""))
        elif m := re.match(r"<!--\s*page:\s*(.+?)\s*-->$", t):
            out.append(("page", m[1]))
        elif re.match(r"<!--\s*Document Outline\s*-->$", t):
            outlined = True
            out.append(("outline", ""))
        elif re.match(r"<!--.*-->$", t) and not meta:
            pass
        elif meta and below and len(below[1]) <= 6:
            out.append(("entry" if outlined else "heading", f"{meta[1]}\t{below[2]}"))
            i += 1
        elif own:
            out.append(("entry" if outlined else "heading", f"{len(own[1])}\t{own[2]}"))
        elif is_row(t):
            rows = []
            while i < len(lines) and is_row(x := lines[i].strip()):
                if not re.match(r"\|[\s:\-|]+\|$", x):
                    rows.append([c.strip() for c in x.split("|")[1:-1]])
                i += 1
            out += [("table", json.dumps(rows, ensure_ascii=False))] if rows else []
            continue
        elif t.startswith("> "):
            said = []
            while i < len(lines) and lines[i].strip().startswith("> "):
                said.append(re.sub(r"^>\s?", "", lines[i].strip()))
                i += 1
            out.append(("quote", " ".join(said)))
            continue
        elif outlined:
            out.append(("note", t))
        elif m := re.match(r"!\[([^\]]*)\]\((data:image/[^;]+;base64,[A-Za-z0-9+/=]+)\)$", t):
            out.append(("image", f"{m[1]}\t{m[2]}"))
        else:
            said = []
            while i < len(lines) and (x := lines[i].strip()) and x != "---" and not re.match(r"[#>|]|```|<!--|!\[.*\]\(data:image/", x) and (notes or not re.match(r"\[\^\w+\]:\s", x)):
                said.append(x)
                i += 1
            out += [("paragraph", " ".join(said))] if said else []
            i += not said
            continue
        i += 1
    return out


STOCK = [
    "", " ", "text", " more  text ", "---", "```", "```py", "<!-- page: iv -->", "<!-- Document Outline -->", "<!-- x -->", "<!-- open", "# H", "## H ##", "####### Deep", "#no", "<!-- heading-level: 8 -->", "###### In",
    "| a | b |", "|---|:-:|", "| \"q\" \\ |", "||", "|", "> one", ">two", "> ", BREAK, "![a](data:image/png;base64,QQ==)", "![a](data:image/x)", "![a](b.png)", "[^1]: note", "[^1]:", "* item",
]


def test_blocks_against_a_reading_line_by_line(spark):
    rng = random.Random(3)
    docs = [[rng.choice(STOCK) for _ in range(rng.randint(1, 30))] for _ in range(400)]
    lines = spark.createDataFrame([(k, n, x) for k, d in enumerate(docs) for n, x in enumerate(d)], "doc_id long, line_no int, line string")
    for notes in (True, False):
        got = {}
        for r in blocks.blocks(lines, notes).orderBy("doc_id", "block_no").collect():
            got.setdefault(r.doc_id, []).append((r.kind, r.payload))
        for k, d in enumerate(docs):
            assert got.get(k, []) == read(d, notes), d


def test_tables_have_all_cells_and_a_header(spark):
    text = ["| a | b | c |", "|---|---|---|", "| 1 || 3 |", "", "| lone |", "text", "|:-:|"]
    rows = blocks.table_rows(spark.createDataFrame([(1, n, x) for n, x in enumerate(text)], "doc_id long, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.table_no, r.row_no, r.line_no, r.cells, r.header) for r in rows] == [(0, 0, 0, ["a", "b", "c"], True), (0, 1, 2, ["1", "", "3"], False), (1, 0, 4, ["lone"], False)]


def test_runs(spark):
    texts = ["", "plain", "**b** and *i*", "***x***y", "**a [^1] b**", "[^n]", "H<SUB>2</sub>O<br/>&lt;*z*&gt;", "&#8364;&#65;&#55357;&#99999999999999999999;", "a ** b", "****a****", "&amp;lt;"]
    got = {}
    for r in blocks.inline_runs(spark.createDataFrame([(1, n, x) for n, x in enumerate([*texts, None])], "doc_id long, line_no int, line string")).orderBy("line_no", "run_no").collect():
        styles = "".join(c for c, on in zip("bi^_/", (r.bold, r.italic, r["sup"], r["sub"], r.brk)) if on)
        got.setdefault(r.line_no, []).append((r.text, styles, r.note))
    run = lambda t, s="", n=None: (t, s, n)
    assert [got[n] for n in range(len(texts))] == [
        [run("")], [run("plain")], [run("b", "b"), run(" and "), run("i", "i")], [run("x", "bi"), run("y")], [run("**a "), run("", n="1"), run(" b**")], [run("", n="n")],
        [run("H"), run("2", "_"), run("O"), run("", "/"), run("<"), run("z", "i"), run(">")], [run("€A\ufffd" + chr(9999999999999999 % 65536))], [run("a ** b")], [run("*a", "bi"), run("*")], [run("<")],
    ]
    assert len(texts) not in got


def test_no_python_in_the_plans(spark):
    lines = spark.createDataFrame([(1, 0, "x")], "doc_id long, line_no int, line string")
    for df in (blocks.blocks(lines), blocks.table_rows(lines), blocks.inline_runs(lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and plan.count("Exchange") <= 1


def test_runs_are_worked_out_once_and_plain_lines_not_at_all(spark):
    texts = ["a < b", "<b>x</b>", "<!-- page: 3 -->", "<BR/>", "<SUP>1</SUP>", "x[^1]", "[^", "[^1]*", "a[^1][^2]b", "&", "<sub>", "<subx>"]
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(texts)], "doc_id long, line_no int, line string")
    runs = blocks.inline_runs(lines)
    for n, x in enumerate(texts):
        got = [(r.text, r.bold, r.italic, r["sup"], r["sub"], r.brk, r.note) for r in runs.filter(f"line_no = {n}").orderBy("run_no").collect()]
        assert got == [tuple(r[k] for k in ("text", "bold", "italic", "sup", "sub", "brk", "note")) for r in M.inline_runs(x)], x
    assert checks.physical(blocks.inline_runs(lines)).count("regexp_extract_all") < 150  # 109; 218 with each line's runs named twice
