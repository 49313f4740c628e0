"""Operators whose steps depend on earlier decisions: one row a document, its lines as an array."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from quire.functions import markdown as M
from quire.functions import pages as PG
from quire.functions import text as T
from quire.operators.headings import by_line, collect_headings, join_lines, renumber
from quire.operators.lookup import at_home, attached, bounded
from quire.plans.lineage import chained, checkpointed


def _per_document(lines: DataFrame, f, kind: str) -> DataFrame:
    """(doc_id, out): f of the document's lines."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t.split("\n")) for t in texts], dtype=object)

    return bounded(join_lines(lines)).select("doc_id", F.pandas_udf(run, kind)("text").alias("out"))


def _lines_of(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode("out").alias("line_no", "line"))


def drop_toc(lines: DataFrame) -> DataFrame:
    """Lines without the headings of a table of contents."""
    return _lines_of(_per_document(lines, lambda x: [y for i, y in enumerate(x) if i not in g] if (g := M.toc_headings(x)) else x, "array<string>"))


_SEEN = "array<struct<line:int,level:int,text:string,parent:string>>"
_REPEATS = f"struct<says:array<string>,at:array<int>,recent:{_SEEN},gone:array<struct<line:int,last:int>>>"


def _fold_repeats(heads, window: int):
    """Lines (line, last) of the headings that repeat a kept one: same level, text and parent, within so many lines.

    State: text and line of the last kept heading of each level, so a parent is found without looking back, and the
    kept headings of the last ``window`` lines.
    """
    levels = F.sequence(F.lit(1), F.lit(T.MAX_LEVEL))
    start = F.struct(F.transform(levels, lambda _: F.lit("")), F.transform(levels, lambda _: F.lit(-1)), F.array().cast(_SEEN), F.array().cast("array<struct<line:int,last:int>>")).cast(_REPEATS)

    def step(s, h):
        above = F.slice(s["at"], F.lit(1), h["level"] - 1)
        near = F.coalesce(F.array_max(above), F.lit(-1))
        of = F.array_position(above, near).cast("int")
        parent = F.when(near < 0, "").otherwise(F.concat(of.cast("string"), F.lit(":"), F.element_at(s["says"], F.greatest(of, F.lit(1)))))
        recent = F.filter(s["recent"], lambda k: h["line"] - k["line"] <= window)
        again = F.exists(recent, lambda k: (k["level"] == h["level"]) & (k["text"] == h["text"]) & (k["parent"] == parent))
        put = lambda old, new: F.transform(old, lambda x, k: F.when(k == h["level"] - 1, new).otherwise(x))
        own = F.array(F.struct(h["line"], h["level"], h["text"], parent)).cast(_SEEN)
        gone = F.concat(s["gone"], F.array(F.struct(h["line"], h["last"])).cast("array<struct<line:int,last:int>>"))
        kept = F.struct(put(s["says"], h["text"]), put(s["at"], h["line"]), F.concat(recent, own), s["gone"]).cast(_REPEATS)
        return F.when(again, F.struct(s["says"], s["at"], recent, gone).cast(_REPEATS)).otherwise(kept)

    return F.aggregate(heads, start, step, lambda s: s["gone"])


def repeated_headings(lines: DataFrame, window: int = M.DUPLICATE_WINDOW) -> DataFrame:
    """(doc_id, line_no) of the lines of headings that repeat a kept one close by under the same parent.

    What is kept decides what repeats it, so a document's headings are folded in order, as columns; its lines stay
    where they are.
    """
    h = collect_headings(lines).select("doc_id", F.struct(F.col("start_line_no").cast("int").alias("line"), F.col("line_no").cast("int").alias("last"), F.col("level").cast("int").alias("level"), T.js_trim(F.col("text")).alias("text")).alias("h"))
    folded = h.groupBy("doc_id").agg(F.sort_array(F.collect_list("h")).alias("h")).select("doc_id", F.explode(_fold_repeats(F.col("h"), window)).alias("g"))
    return folded.select("doc_id", F.explode(F.sequence("g.line", "g.last")).alias("line_no"))


def drop_repeated_headings(lines: DataFrame, window: int = M.DUPLICATE_WINDOW) -> DataFrame:
    """Lines without headings that repeat a kept one close by under the same parent; renumbered."""
    gone = repeated_headings(lines, window).select("doc_id", "line_no", F.lit(True).alias("x"))
    left = attached(at_home(lines), gone, ["doc_id", "line_no"], "gone").filter("gone is null")
    return renumber(left, "line_no")


def flatten_outline(lines: DataFrame) -> DataFrame:
    return _lines_of(_per_document(lines, M.flat_outline, "array<string>"))


def clean_headings(lines: DataFrame) -> DataFrame:
    return _lines_of(_per_document(lines, M.clean, "array<string>"))


def correction_ranges(lines: DataFrame, most: int = M.CORRECT_WORDS) -> DataFrame:
    """(doc_id, chunk_no, start, end): line ranges that end at the first blank line by which they hold so many words (1 at least).

    A range can start at the first line and behind each blank one. Where it would end is the first blank line whose
    running count of words is that of its start and ``most`` more, found by sorting both by that count; the ranges are
    the chain of these from the first line. So a document of any length is sorted rows, never one value.
    """
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (T.js_trim(F.col("line")) == "").alias("blank"), F.sum(F.when(F.col("line") == "", 0).otherwise(T.word_count("line"))).over(by_line()).alias("words"), (F.max("line_no").over(W.partitionBy("doc_id")) + 1).alias("total"))
    number, words, none = F.col("line_no"), F.col("words"), F.lit(None).cast("long")
    row = lambda start, stop, at: F.struct(start.alias("start"), stop.alias("stop"), at.alias("words"))
    asked = [F.when(number == 0, row(F.lit(0).cast("long"), none, F.lit(0).cast("long") + most)), F.when(F.col("blank"), row(number + 1, none, words + most))]
    given = F.when(F.col("blank"), row(none, number, words))
    both = rows.filter("blank or line_no = 0").select("doc_id", "total", F.inline(F.array_compact(F.array(*asked, given))))
    back = W.partitionBy("doc_id").orderBy(F.desc("words"), F.col("stop").desc_nulls_last())
    linked = both.withColumn("end", F.last("stop", ignorenulls=True).over(back) + 1).filter("start is not null").select("doc_id", "total", "start", "end")
    linked = checkpointed(linked)  # read three times below
    found = chained(linked, linked.filter("start = 0"), ["doc_id"], "start", "end")
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("start")) - 1
    return found.join(linked, ["doc_id", "start"]).filter("start < total").select("doc_id", no.alias("chunk_no"), "start", F.coalesce("end", "total").cast("long").alias("end"))


def translate_chunks(docs: DataFrame, most: float = M.TRANSLATE_WORDS) -> DataFrame:
    """(doc_id, chunk_no, text) of the documents' texts."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([M.translate_chunks(t or "", most) for t in texts], dtype=object)

    return bounded(docs).select("doc_id", F.posexplode(F.pandas_udf(run, "array<string>")("text")).alias("chunk_no", "text"))


def rename_labels(batches: DataFrame) -> DataFrame:
    """(doc_id, batch_no, text): batches with note labels made unique across a document."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([M.rename_labels(list(t))[0] for t in texts], dtype=object)

    rows = batches.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("batch_no", "text"))).alias("b"))
    out = bounded(rows).select("doc_id", F.col("b.batch_no").alias("no"), F.pandas_udf(run, "array<string>")("b.text").alias("t"))
    return out.select("doc_id", F.explode(F.arrays_zip("no", "t")).alias("z")).select("doc_id", F.col("z.no").alias("batch_no"), F.col("z.t").alias("text"))


def preview_chunks(lines: DataFrame, most: int = 50_000) -> DataFrame:
    """(doc_id, chunk_no, text)."""
    return _per_document(lines, lambda x: M.preview_chunks("\n".join(x), most), "array<string>").select("doc_id", F.posexplode("out").alias("chunk_no", "text"))


def ocr_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, index, markdown, header, footer, and perhaps images map<string,string>, data URIs by name): pages without their header and footer lines, marked with printed page numbers, joined by blank lines.

    A page without text is empty. All in columns; a document's pages meet as one array.
    """
    header, footer = F.col("header"), F.col("footer")
    body = PG.without_edges(F.coalesce("markdown", F.lit("")), F.concat(PG.edge_lines(header), PG.edge_lines(footer)))
    body = PG.with_images(body, F.col("images")) if "images" in pages.columns else body
    page = pages.select("doc_id", "index", body.alias("body"), PG.printed_numbers(header, footer).alias("numbers"))
    page = page.select("doc_id", "index", F.concat(PG.spread_marker(F.col("numbers")), "body").alias("text"))
    rows = F.sort_array(F.collect_list(F.struct("index", "text")))
    return page.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def streamed_texts(pieces: DataFrame) -> DataFrame:
    """(doc_id, text, error) from (doc_id, seq, piece): streamed answers put together; an error event gives its message.

    Lines may be cut anywhere; one that isn't complete, is no event or no JSON says nothing. All in columns.
    """
    rows = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("t"))
    lines = F.split("t", "\n")
    data = F.transform(F.filter(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: x.startswith("data: ")), lambda x: F.substring(x, F.lit(7), F.length(x)))
    events = rows.select("doc_id", F.transform(data, F.try_parse_json).alias("events"))
    said = F.transform("events", lambda e: F.coalesce(F.try_variant_get(e, "$.choices[0].delta.content", "string"), F.lit("")))
    failed = F.filter(F.transform("events", lambda e: F.when(_given(e, "$.error"), F.coalesce(F.nullif(F.try_variant_get(e, "$.error.message", "string"), F.lit("")), F.lit("Stream error")))), lambda x: x.isNotNull())
    told = events.select("doc_id", F.array_join(said, "").alias("text"), F.get(failed, F.lit(0)).alias("error"))
    return told.select("doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def _given(event, path: str):
    """A field that is there and says something: not null, false, zero or empty."""
    value = F.try_variant_get(event, path, "variant")
    return F.coalesce(value.isNotNull() & ~F.is_variant_null(value) & ~F.coalesce(F.try_variant_get(event, path, "string"), F.lit("x")).isin("false", "0", ""), F.lit(False))
