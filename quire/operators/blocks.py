"""The blocks of a document's body, its tables and the runs of its text, in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions.inline import runs_of
from quire.operators.headings import by_line

# What a line is told by.
SECTION_BREAK = "<!-- ENDNOTE-SECTION-BREAK -->"
PAGE, OUTLINE, COMMENT = r"^<!--\s*page:\s*(.+?)\s*-->\z", r"^<!--\s*Document Outline\s*-->\z", r"^<!--.*-->\z"
SEPARATOR, NOTE = r"^\|[\s:\-|]+\|\z", r"^\[\^\w+\]:\s"
DATA_IMAGE = r"^!\[([^\]]*)\]\((data:image/[^;]+;base64,[A-Za-z0-9+/=]+)\)\z"
#: Kinds whose lines, one below the other, are one block, and what joins their pieces.
ISLANDS = {"code": "\n", "table": ", ", "quote": " ", "paragraph": " "}


def classified(lines: DataFrame, notes: bool = True) -> DataFrame:
    """Adds kind, piece and block: what each line is, what it says, and a number that the lines of a block share.

    The first of these decides: section break, code, blank, rule, page, outline mark, comment, heading, table, quote,
    text of the outline (up to a rule), image, paragraph. A line that belongs to nothing has no kind; that of a
    level comment is its heading's, the heading's own has none. ``notes``: note definitions are text, else nothing. All in
    windows over a document's lines.
    """
    w, t = by_line(), F.col("t")
    rows = lines.withColumn("t", T.js_trim(F.col("line")))
    rows = rows.withColumn("stop", t == SECTION_BREAK).withColumn("tick", t.startswith("```"))
    rows = rows.withColumn("ticks", F.sum(F.col("tick").cast("int")).over(w))
    rows = rows.withColumn("code", F.col("tick") | (~F.col("stop") & (F.col("ticks") % 2 == 1))).withColumn("open", ~F.col("code") & ~F.col("stop"))
    atx = F.when(F.col("open"), F.length(F.regexp_extract("line", T.ATX, 1))).otherwise(0)
    rows = rows.withColumn("atx", atx).withColumn("meta", F.when(F.col("open"), F.regexp_extract("line", T.META, 1)).otherwise(""))
    native = F.col("atx").between(1, T.NATIVE_LEVELS)
    rows = rows.withColumn("pair", (F.col("meta") != "") & F.coalesce(F.lead(native).over(w), F.lit(False))).withColumn("taken", native & (F.lag("meta", 1, "").over(w) != ""))
    rows = rows.withColumn("title", F.when(F.col("pair"), F.lead(F.regexp_extract("line", T.ATX, 2)).over(w)).otherwise(F.regexp_extract("line", T.ATX, 2)))
    rows = rows.withColumn("level", F.when(F.col("pair"), F.nullif(F.col("meta"), F.lit("")).cast("int")).otherwise(F.col("atx")))
    switch = F.when(F.col("open") & t.rlike(OUTLINE), True).when(F.col("open") & (t == "---"), False)
    rows = rows.withColumn("outlined", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(False)))
    table = t.startswith("|") & t.endswith("|") & (F.size(F.split(t, r"\|")) >= 3)
    nothing = t.rlike(r"^[#>|]|^<!--") | t.rlike(r"^!\[.*\]\(data:image/") | (F.lit(not notes) & t.rlike(NOTE))
    kind = (
        F.when(F.col("stop"), "break").when(F.col("code"), "code").when(t == "", None).when(t == "---", "rule").when(t.rlike(PAGE), "page").when(t.rlike(OUTLINE), "outline")
        .when(t.rlike(COMMENT) & (F.col("meta") == ""), None).when(F.col("taken"), None).when(F.col("pair") | (F.col("atx") > 0), F.when(F.col("outlined"), "entry").otherwise("heading"))
        .when(table, "table").when(t.startswith("> "), "quote").when(F.col("outlined"), "note").when(t.rlike(DATA_IMAGE), "image").when(nothing, None).otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    cells = F.transform(_cells(t), lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", ""))
    said = {
        "code": F.when(~F.col("tick"), F.col("line")), "page": F.regexp_extract(t, PAGE, 1), "heading": F.concat(F.col("level").cast("string"), F.lit("\t"), F.col("title")),
        "entry": F.concat(F.col("level").cast("string"), F.lit("\t"), F.col("title")), "table": F.when(~t.rlike(SEPARATOR), F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]"))),
        "quote": F.regexp_replace(t, r"^>\s?", ""), "note": t, "image": F.concat(F.regexp_extract(t, DATA_IMAGE, 1), F.lit("\t"), F.regexp_extract(t, DATA_IMAGE, 2)), "paragraph": t,
    }
    piece = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in said.items()], F.when(F.col("kind").isin("break", "rule", "outline"), ""))
    starts = F.col("kind").isNotNull() & (F.col("kind") != "code") & ~(F.col("kind").isin(*ISLANDS) & F.coalesce(F.col("kind") == F.lag("kind").over(w), F.lit(False)))
    rows = rows.withColumn("piece", piece).withColumn("starts", starts)
    block = F.when(F.col("kind") == "code", -F.floor((F.col("ticks") + 1) / 2)).otherwise(F.sum(F.col("starts").cast("int")).over(w))
    return rows.withColumn("block", block).select(*lines.columns, "kind", "piece", "block", "tick", "t")


def _cells(row: Column) -> Column:
    """The trimmed cells between the outer bars of a table's row."""
    parts = F.split(row, r"\|")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), T.js_trim)


def blocks(lines: DataFrame, notes: bool = True) -> DataFrame:
    """(doc_id, block_no, kind, payload): break, code, rule, page, outline, entry, note, heading, table, quote, image, paragraph.

    A heading's payload, and an outline entry's, is its level, a tab and its text; a table's are its rows' cells as
    JSON without the separator rows; an image's its text, a tab and its data; lines of a paragraph are joined by
    spaces. Code stands where it ends; code that is never closed, or blank, is left out, as are tables of separators.
    """
    rows = classified(lines, notes).filter("kind is not null")
    pieces = F.transform(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("line_no", "piece")))), lambda x: x["piece"])
    at = F.when(F.col("kind") == "code", F.max("line_no")).otherwise(F.min("line_no"))
    found = rows.groupBy("doc_id", "kind", "block").agg(pieces.alias("pieces"), at.alias("at"), F.count_if("tick").alias("ticks"))
    joined = F.coalesce(*[F.when(F.col("kind") == k, F.array_join("pieces", by)) for k, by in ISLANDS.items()], F.get("pieces", F.lit(0)))
    payload = F.when(F.col("kind") == "table", F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined)
    empty = ((F.col("kind") == "code") & ((F.col("ticks") < 2) | (T.js_trim(joined) == ""))) | ((F.col("kind") == "table") & (F.size("pieces") == 0))
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("at")) - 1
    return found.withColumn("payload", payload).filter(~empty).select("doc_id", no.alias("block_no"), "kind", "payload")


def table_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, line_no, cells, header): every row of every table, separator rows left out; the first of several is the header."""
    rows = classified(lines).filter("kind = 'table' and piece is not null")
    table = W.partitionBy("doc_id", "block")
    own = F.row_number().over(table.orderBy("line_no")) - 1
    return rows.select(
        "doc_id", (F.dense_rank().over(W.partitionBy("doc_id").orderBy("block")) - 1).alias("table_no"), own.alias("row_no"), "line_no", _cells(F.col("t")).alias("cells"), ((own == 0) & (F.count("*").over(table) > 1)).alias("header")
    )


def inline_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, run_no, text, bold, italic, sup, sub, brk, note)."""
    return lines.select("doc_id", "line_no", F.posexplode(runs_of(F.col("line"))).alias("run_no", "r")).select("doc_id", "line_no", "run_no", "r.*")
