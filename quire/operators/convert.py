"""Conversion of documents in batches of pages: scan, transcribe in order, resume, assemble.

Pages of one document are worked on one batch after the other, as a batch's prompt holds the last headings of the one
before; documents are independent of each other. A document is one row, so a lost task is done again alone.
"""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import values as V
from quire.operators.lookup import bounded
from quire.sources import providers as P

BATCH_PAGES, CONTEXT_HEADINGS = 5, 5
MARK = "\n---\n"


def scan_prompt(pages: str) -> str:
    """Asks for the outline of a whole document."""
    return f"Outline: list the document's headings, one a line, with their levels, and say NOTE STYLE: footnotes, endnotes or none.{MARK}{pages}"


def batch_parts(number: int, total: int, outline: str, before: str, extra: str = "") -> tuple[str, str]:
    """(stable, volatile) instructions of a batch: the same for all batches of a document, and its own."""
    notes = "Notes are gathered at the end: mark references as [^N], invent no definitions." if note_style(outline) == "endnotes" else "Keep notes as [^N] with their printed numbers and definitions."
    stable = f"Transcribe the pages as Markdown. Take heading levels from this outline:\n{outline}\n{notes}\nWrite <!-- page: N --> where a printed page N begins."
    stable += f"\n{extra}" if extra else ""
    volatile = f"Batch {number} of {total}."
    return stable, volatile + (f" These headings were written already, don't repeat them:\n{before}" if before.strip() else "")


def batch_prompt(number: int, total: int, outline: str, before: str, pages: str, extra: str = "") -> str:
    return "\n\n".join(batch_parts(number, total, outline, before, extra)) + MARK + pages


def translation_prompts(chunks: DataFrame, language: str, extra: str = "") -> DataFrame:
    """Adds prompt to (doc_id, chunk_no, text): which chunk of how many, unless it is the only one, and the text."""
    total = chunks.groupBy("doc_id").agg(F.count("*").alias("total"))
    part = F.when(F.col("total") > 1, F.format_string("Part %d of %d.\n", F.col("chunk_no") + 1, F.col("total"))).otherwise("")
    told = F.concat(F.lit(f"Translate into {language}. Keep the Markdown, notes, page markers and references.\n"), part, F.lit(extra + MARK), F.col("text"))
    return chunks.join(total, "doc_id").withColumn("prompt", told).drop("total")


def correction_prompts(lines: DataFrame, ranges: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, prompt): each range's lines with their numbers, under the outline, if there is one."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.concat((F.col("line_no") + 1).cast("string"), F.lit("|"), "line").alias("t"))))
    at = lines.join(ranges, "doc_id").filter((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("end")))
    body = at.groupBy("doc_id", "chunk_no").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("body"))
    told = F.when(F.col("outline").isNull(), "There is no outline: correct clear slips only.").otherwise(F.concat(F.lit("The outline counts:\n"), "outline"))
    return body.join(outlines, "doc_id", "left").select("doc_id", "chunk_no", F.concat(F.lit("Correct the heading structure by commands, one a line.\n"), told, F.lit(MARK), "body").alias("prompt"))


def note_style(outline: str) -> str:
    m = re.search(r"^\s*NOTE STYLE:\s*(footnotes|endnotes|none)\b", outline, re.I | re.M)
    return m[1].lower() if m else "unknown"


def trailing_headings(text: str, n: int = CONTEXT_HEADINGS) -> str:
    return "\n".join("\n".join(M.serialize(h.level, h.text)) for h in M.headings(text.split("\n"))[-n:])


def assemble(outline: str, results: list[str], clean: bool = True) -> tuple[str, str, str | None]:
    """(body, note style, where endnotes are gathered) of a document's batches."""
    results = ["\n".join(M.without_stand_ins(x.split("\n"))) for x in results]
    style, position = note_style(outline), None
    if style == "endnotes":
        numbers = [int(n) for n in re.findall(r"^\[\^(\d+)\]:", "\n".join(results), re.M)]
        position = "section-end" if any(b < a for a, b in zip(numbers, numbers[1:])) else "document-end"
    else:
        results = M.rename_labels(results)[0]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(M.normalize("\n\n".join(results).split("\n"))))
    return "\n".join(M.clean(body.split("\n"))) if clean else body, style, position


def convert(docs: DataFrame, models: list[str], name: str = "pages", size: int = BATCH_PAGES, saved: DataFrame | None = None, most: int | None = None, clean: bool = True, wait=time.sleep) -> DataFrame:
    """(doc_id, outline, results, total, skipped, text, notes, position) of docs(doc_id, pages array<string>).

    The outline comes first, from the whole document, then the batches in order; a model that prefers whole documents
    gets one batch. saved(doc_id, outline, results): what is done already is not asked for again. most: batches at most
    in this run, for a pause; text is null while a document isn't done, and its results are the next run's saved. Models that
    failed for good are skipped in all later calls of a document; skipped names them. Between batches the service's
    pause is kept.
    """

    def run(pages: pd.Series, outline: pd.Series, results: pd.Series) -> pd.DataFrame:
        p = P.provider(name)
        out = []
        for doc, plan, done in zip(pages, outline, results):
            doc = [] if doc is None else [x or "" for x in doc]
            done, skip = [] if done is None else list(done), set()
            step = max(1, len(doc)) if models and p.prefers_full_document(models[0]) else size
            total = -(-len(doc) // step)
            if not isinstance(plan, str):
                plan = P.call(p, models, scan_prompt("\n\n".join(doc)), skip, wait)[0]
            before = trailing_headings(done[-1]) if done else ""
            for k in range(len(done), total if most is None else min(total, len(done) + most)):
                if k and p.delay:
                    wait(p.delay)
                prompt = batch_prompt(k + 1, total, plan, before, "\n\n".join(doc[k * step : (k + 1) * step]))
                done.append(M.strip_fence(P.call(p, models, prompt, skip, wait)[0]))
                before = trailing_headings(done[-1])
            text, style, position = assemble(plan, done, clean) if len(done) >= total else (None, note_style(plan), None)
            out.append((plan, done, total, sorted(skip), text, style, position))
        return pd.DataFrame(out, columns=["outline", "results", "total", "skipped", "text", "notes", "position"])

    kind = "outline string, results array<string>, total long, skipped array<string>, text string, notes string, position string"
    if saved is None:
        work = docs.select("doc_id", "pages", F.lit(None).cast("string").alias("outline"), F.lit(None).cast("array<string>").alias("results"))
    else:
        work = docs.select("doc_id", "pages").join(saved.select("doc_id", "outline", "results"), "doc_id", "left")
    # a model's answer is no function of its input: Spark neither repeats the call for each use of the result nor moves it
    asked = F.pandas_udf(run, kind).asNondeterministic()
    return bounded(work).select("doc_id", asked("pages", "outline", "results").alias("r")).select("doc_id", "r.*")


def with_head(converted: DataFrame, files: DataFrame, provider: str, model: str) -> DataFrame:
    """(doc_id, markdown): the finished documents under their YAML heads; files(doc_id, file_name, pages, date)."""
    both = converted.filter("text is not null").join(files, "doc_id")
    head = V.frontmatter(F.col("file_name"), F.col("pages"), F.col("date"), provider, model, notes=F.col("notes"), position=F.col("position"))
    return both.select("doc_id", F.concat(head, F.lit("\n\n"), "text").alias("markdown"))
