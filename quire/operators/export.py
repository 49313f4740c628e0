"""Exports of documents: JSON, HTML, Word."""

from __future__ import annotations

import html as html_lib
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import values as V
from quire.operators.headings import join_lines, normalize_syntax, sections, split_lines
from quire.operators.lookup import bounded


def json_export(lines: DataFrame) -> DataFrame:
    """(doc_id, json): {"metadata": {...}, "outline": text or null, "sections": [{level, heading, content}]}.

    The YAML head gives the metadata, numbers as numbers; an outline in the text is cut out of it; the rest is split
    at its logical headings.
    """
    whole = join_lines(lines).withColumn("head", F.regexp_extract("text", V.HEAD, 1)).withColumn("fields", V.frontmatter_map(F.col("text")))
    body = whole.withColumn("body", F.regexp_replace("text", V.HEAD, "")).withColumn("outline", V.outline_block(F.col("body")))
    body = body.withColumn("body", F.regexp_replace("body", r"(?s)^(.*?)" + V.OUTLINE.removeprefix("(?s)"), "$1"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?\z"
    plain = lambda v: F.when(v.cast("double") == F.floor(v.cast("double")), F.format_string("%.0f", v.cast("double"))).otherwise(v.cast("double").cast("string"))
    value = lambda v: F.when(v.rlike(number), plain(v)).otherwise(quoted(v))
    meta = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"]))), ",")
    rows = F.sort_array(F.collect_list(F.struct("section_no", "level", "heading", "content")))
    per = sections(normalize_syntax(split_lines(body.select("doc_id", "body"), "body"))).groupBy("doc_id").agg(rows.alias("r"))
    parts = F.transform(F.coalesce("r", F.array().cast("array<struct<section_no:long,level:int,heading:string,content:string>>")), lambda x: F.struct(x["level"].alias("level"), x["heading"].alias("heading"), x["content"].alias("content")))
    out = body.select("doc_id", meta.alias("meta"), F.coalesce(quoted(F.col("outline")), F.lit("null")).alias("outline")).join(per, "doc_id", "left")
    out = out.withColumn("outline", F.when(F.col("outline") == "", "null").otherwise(F.col("outline")))
    return out.select("doc_id", F.concat(F.lit('{"metadata":{'), "meta", F.lit('},"outline":'), "outline", F.lit(',"sections":'), F.to_json(parts, {"ignoreNullFields": "false"}), F.lit("}")).alias("json"))


def html_of(lines: list[str]) -> str:
    """A page of the block subset: headings of nine levels, paragraphs, quotes, tables, code, rules, notes."""
    tag = {"bold": "strong", "italic": "em", "sup": "sup", "sub": "sub"}

    def inline(text: str) -> str:
        if not M.MARKED.search(text):
            return html_lib.escape(text, False)
        out = []
        for r in M.inline_runs(text):
            if r["note"]:  # a note has no other marks
                out.append(f'<sup>{html_lib.escape(r["note"])}</sup>')
                continue
            t = "<br>" if r["brk"] else html_lib.escape(r["text"], False)
            for k, v in tag.items():
                t = f"<{v}>{t}</{v}>" if r[k] else t
            out.append(t)
        return "".join(out)

    fields, body = M.frontmatter("\n".join(lines))
    out = ['<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>']
    if fields:
        out.append("<dl>" + "".join(f"<dt>{html_lib.escape(k)}</dt><dd>{html_lib.escape(str(v))}</dd>" for k, v in fields.items()) + "</dl>")
    for kind, payload in M.blocks(body.split("\n")):
        if kind == "heading":
            level, text = payload.split("\t", 1)
            out.append(f"<h{level}>{inline(text)}</h{level}>" if int(level) <= 6 else f'<div role="heading" aria-level="{level}">{inline(text)}</div>')
        elif kind == "table":
            rows = json.loads(payload)
            cell = lambda c, h: f"<{h}>{inline(c)}</{h}>"
            out.append("<table>" + "".join("<tr>" + "".join(cell(c, "th" if not i and len(rows) > 1 else "td") for c in r) + "</tr>" for i, r in enumerate(rows)) + "</table>")
        elif kind == "image":
            alt, src = payload.split("\t", 1)
            out.append(f'<img src="{html_lib.escape(src)}" alt="{html_lib.escape(alt)}">')
        elif kind == "break":
            out.append('<div style="page-break-after: always"></div>')
        elif kind == "code":
            out.append(f"<pre><code>{html_lib.escape(payload)}</code></pre>")
        else:
            out.append({"rule": "<hr>", "page": f"<p>— page {html_lib.escape(payload)} —</p>", "outline": "<p><strong>Document Outline</strong></p>", "quote": f"<blockquote>{inline(payload)}</blockquote>"}.get(kind, f"<p>{inline(payload)}</p>"))
    return "\n".join(out) + "\n</body></html>"


def html_export(lines: DataFrame) -> DataFrame:
    """(doc_id, html)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([html_of(t.split("\n")) for t in texts], dtype=object)

    return bounded(join_lines(lines)).select("doc_id", F.pandas_udf(run, "string")("text").alias("html"))


W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/word/footnotes.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml"/></Types>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/footnotes" Target="footnotes.xml"/></Relationships>'


# Characters that XML can't hold, a note's text, and what Word files are read back by.
CONTROL, NOTE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]"), re.compile(r"\s*\[\^(\w+)\]:\s*(.*)")
RAISED = re.compile(r'<w:r><w:rPr>(?:(?!</w:r>).)*?w:val="superscript"(?:(?!</w:r>).)*</w:r>')
PARA, SAID = re.compile(r"<w:p>.*?</w:p>"), re.compile(r"<w:t [^>]*>([^<]*)</w:t>")


def docx_of(lines: list[str], milestones: bool = False, first_note: int = 1) -> bytes:
    """A Word file: nine heading styles with outline levels, tables, quotes, code and native footnotes or endnotes.

    A head that says so makes the notes endnotes, gathered where it says; a section break begins a new section. An
    image is its text in brackets. The first reference of a note is live, later ones and notes without text are superscripts. milestones: page
    markers become ``[[@Page:N]]`` and headings ``{{field-on:Heading}}`` fields. Equal input gives equal bytes.
    """
    esc = lambda t: CONTROL.sub("", html_lib.escape(t, False))
    lines = M.normalize(lines)
    fields, body = M.frontmatter("\n".join(lines))
    kind_of = "endnote" if fields.get("notes") == "endnotes" else "footnote"
    notes, rest = {}, []
    for x in body.split("\n"):
        if m := "]:" in x and NOTE.match(x):
            notes[m[1]] = m[2]
        else:
            rest.append(x)
    number = {k: i + 1 for i, k in enumerate(notes)}
    used: set[str] = set()

    def runs(text: str, live: bool = True) -> str:
        out = []
        for r in M.inline_runs(text):
            if r["note"] and live and r["note"] in number and r["note"] not in used:
                used.add(r["note"])
                out.append(f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:{kind_of}Reference w:id="{number[r["note"]]}"/></w:r>')
                continue
            props = ("<w:b/>" if r["bold"] else "") + ("<w:i/>" if r["italic"] else "")
            props += '<w:vertAlign w:val="superscript"/>' if r["sup"] or r["note"] else '<w:vertAlign w:val="subscript"/>' if r["sub"] else ""
            out.append(f"<w:r>{'<w:rPr>' + props + '</w:rPr>' if props else ''}" + ("<w:br/>" if r["brk"] else f'<w:t xml:space="preserve">{esc(r["note"] or r["text"])}</w:t>') + "</w:r>")
        return "".join(out)

    para = lambda inner, props="": f"<w:p>{'<w:pPr>' + props + '</w:pPr>' if props else ''}{inner}</w:p>"
    position = {"document-end": "docEnd", "section-end": "sectEnd"}.get(fields.get("notes_position"), "docEnd")
    place = f'<w:pos w:val="{position}"/>' if kind_of == "endnote" else ""
    restart = '<w:numRestart w:val="eachSect"/>' if place and position == "sectEnd" else ""
    settings = f'<w:{kind_of}Pr>{place}<w:numStart w:val="{first_note}"/>{restart}</w:{kind_of}Pr>'
    out = []
    for kind, payload in M.blocks(rest):
        if kind == "heading":
            level, text = payload.split("\t", 1)
            inner = runs(text)
            out.append(para(runs("{{field-on:Heading}}") + inner + runs("{{field-off:Heading}}") if milestones else inner, f'<w:pStyle w:val="Heading{level}"/>'))
        elif kind == "table":
            rows = json.loads(payload)
            out.append("<w:tbl><w:tblPr/><w:tblGrid/>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(runs(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>" + para(""))
        elif kind == "code":
            out += [para(f'<w:r><w:t xml:space="preserve">{esc(x)}</w:t></w:r>') for x in payload.split("\n")]
        elif kind == "break":
            out.append(para("", f"<w:sectPr>{settings}</w:sectPr>"))
        elif kind == "image":
            out.append(para(runs(f"[{payload.split(chr(9), 1)[0]}]")))
        elif kind == "rule":
            out.append(para("", '<w:pBdr><w:bottom w:val="single"/></w:pBdr>'))
        else:
            text = {"page": f"[[@Page:{payload}]]" if milestones else f"— page {payload} —", "outline": "Document Outline"}.get(kind, payload)
            out.append(para(runs(text), '<w:ind w:left="360"/>' if kind == "quote" else ""))
    head = f'<?xml version="1.0" encoding="UTF-8"?><w:{{}} xmlns:w="{W_NS}">'
    document = head.format("document") + f'<w:body>{"".join(out)}<w:sectPr>{settings}</w:sectPr></w:body></w:document>'
    styles = head.format("styles") + "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr></w:style>' for n in range(1, 10)) + "</w:styles>"
    foot = head.format(f"{kind_of}s") + "".join(f'<w:{kind_of} w:id="{number[k]}">{para(runs(t, live=False))}</w:{kind_of}>' for k, t in notes.items()) + f"</w:{kind_of}s>"
    named = lambda t: t.replace("footnotes", f"{kind_of}s")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", named(_TYPES)), ("_rels/.rels", _ROOT), ("word/_rels/document.xml.rels", named(_RELS)), ("word/document.xml", document), ("word/styles.xml", styles), (f"word/{kind_of}s.xml", foot)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return data.getvalue()


def docx(lines: DataFrame, milestones: bool = False) -> DataFrame:
    """(doc_id, content): Word files as bytes."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([docx_of(t.split("\n"), milestones) for t in texts], dtype=object)

    return bounded(join_lines(lines)).select("doc_id", F.pandas_udf(run, "binary")("text").alias("content"))


def docx_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): what the Word files say, paragraph by paragraph, without superscripts: read back from the bytes."""
    def said(data: bytes) -> str:
        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
        xml = RAISED.sub("", xml)
        paras = ["".join(SAID.findall(p)) for p in PARA.findall(xml)]
        return "\n".join(html_lib.unescape(p) for p in paras)

    def run(content: pd.Series) -> pd.Series:
        return pd.Series([said(bytes(x)) for x in content], dtype=object)

    return docx(lines).select("doc_id", F.pandas_udf(run, "string")("content").alias("text"))
