"""Lines, fences and logical headings. One window over (doc_id, line_no) serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T

def by_line(order: tuple[str, ...] = ("line_no",)):
    return W.partitionBy("doc_id").orderBy(*order)


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): lines from 0, empty ones at the end kept."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def join_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(doc_id, text): the lines of each document in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("text"))


def mark_fences(lines: DataFrame, tildes: bool = True, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Adds masked: the line is a fence or inside fences. Any kind of fence closes any other."""
    fence = T.is_fence("line", tildes)
    return lines.withColumn("masked", fence | (F.sum(fence.cast("int")).over(by_line(order).rowsBetween(W.unboundedPreceding, 0)) % 2 == 1))


def heading_fields(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Adds hashes, title, meta (of an open line) and pair, on the level comment of a pair with the next line."""
    w = by_line(order)
    seen = mark_fences(lines, order=order).withColumn("hashes", F.when(~F.col("masked"), F.length(F.regexp_extract("line", T.ATX, 1))).otherwise(0))
    seen = seen.withColumn("title", F.regexp_extract("line", T.ATX, 2)).withColumn("meta", F.when(~F.col("masked"), F.regexp_extract("line", T.META, 1)).otherwise(""))
    return seen.withColumn("next_hashes", F.lead("hashes", 1, 0).over(w)).withColumn("next_title", F.lead("title").over(w)).withColumn("before", F.lag("meta", 1, "").over(w))


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds h_level, h_text, h_line and h_native on the first line of each logical heading, null elsewhere.

    A level comment and the native heading below it are one heading; raw hashes up to 9 are headings too. All in
    the one window over a document's lines, so what needs headings beside their lines needs no join.
    """
    f = heading_fields(lines)
    pair = (F.col("meta") != "") & F.col("next_hashes").between(1, T.NATIVE_LEVELS)
    own = (F.col("hashes") > 0) & ~((F.col("before") != "") & (F.col("hashes") <= T.NATIVE_LEVELS))
    either = lambda x, y: F.when(pair, x).when(own, y)
    return f.select(
        *lines.columns,
        either(F.when(pair, F.col("meta")).otherwise("0").cast("int"), F.col("hashes")).alias("h_level"),
        either(F.col("next_title"), F.col("title")).alias("h_text"),
        either(F.col("line_no") + 1, F.col("line_no")).alias("h_line"),
        either(F.col("next_hashes"), F.least(F.col("hashes"), F.lit(T.NATIVE_LEVELS))).alias("h_native"),
    )


def collect_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_line_no, level, text, md_level): logical headings."""
    found = with_headings(lines).filter("h_level is not null")
    return found.select("doc_id", F.col("h_line").alias("line_no"), F.col("line_no").alias("start_line_no"), F.col("h_level").alias("level"), F.col("h_text").alias("text"), F.col("h_native").alias("md_level"))


def canonical_parts(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Adds masked and parts: the lines that each line becomes when every heading has its canonical form; none for one that its level comment takes in."""
    f = heading_fields(lines, order)
    pair = (F.col("meta") != "") & (F.col("next_hashes") > 0)
    taken = (F.col("before") != "") & (F.col("hashes") > 0)
    raw = F.col("hashes") > T.NATIVE_LEVELS
    line = F.when(pair, T.serialize(F.when(pair, F.col("meta")).otherwise("1").cast("int"), F.col("next_title"))).when(raw, T.serialize(F.col("hashes"), F.col("title"))).otherwise(F.col("line"))
    return f.select(*lines.columns, "masked", F.when(taken, F.array().cast("array<string>")).otherwise(F.split(line, "\n")).alias("parts"))


def canonical(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, masked): lines with every heading in its canonical form, numbered by what stands before them."""
    cut = canonical_parts(lines)
    first = F.coalesce(F.sum(F.size("parts")).over(by_line().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = cut.withColumn("first", first.cast("int"))  # before the lines are dealt out, as a window beside a generator would count after it
    return counted.select("doc_id", "first", "masked", F.posexplode("parts").alias("sub", "line")).select("doc_id", (F.col("first") + F.col("sub")).alias("line_no"), "line", "masked")


def normalize_syntax(lines: DataFrame) -> DataFrame:
    """Lines with every heading in its canonical form; renumbered."""
    return canonical(lines).drop("masked")


def renumber(lines: DataFrame, *order: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1
    return lines.select("doc_id", n.alias("line_no"), "line")


def structural_report(headings: DataFrame) -> DataFrame:
    """(doc_id, headings, jumps, deepest): a jump is more than one level down from the heading before."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    jump = F.col("level") > F.lag("level").over(w) + 1
    return headings.withColumn("jump", F.coalesce(jump, F.lit(False)).cast("int")).groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum("jump").alias("jumps"), F.max("level").alias("deepest"))


def trailing_headings(headings: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, context): the last n headings as Markdown, for the prompt of the next batch."""
    back = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("line_no")))
    last = headings.withColumn("back", back).filter(F.col("back") <= n)
    rows = F.sort_array(F.collect_list(F.struct("line_no", T.serialize(F.col("level"), F.col("text")).alias("line"))))
    return last.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))


def carry_pages(lines: DataFrame) -> DataFrame:
    """Adds page: the label of the last page marker at or before the line; null before the first."""
    label = F.nullif(F.regexp_extract("line", T.PAGE, 1), F.lit(""))
    return lines.withColumn("page", F.last(label, ignorenulls=True).over(by_line()))


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section_no, level, heading, content): the text under each logical heading.

    What stands before the first heading is a section of level 0 without a heading, if it isn't blank.
    """
    upto = F.coalesce(F.last("h_line", ignorenulls=True).over(by_line()), F.lit(-1))
    body = with_headings(lines).select("doc_id", "line_no", "line", F.col("h_level").alias("level"), F.col("h_text").alias("heading"), F.count("h_level").over(by_line()).alias("section_no"), (F.col("line_no") > upto).alias("inside"))
    rows = F.sort_array(F.collect_list(F.when(F.col("inside"), F.struct("line_no", "line"))))
    out = body.groupBy("doc_id", "section_no").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.max("heading").alias("heading"), T.js_trim(F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("content"))
    return out.filter((F.col("section_no") > 0) | (F.col("content") != ""))


def chunk_offsets(lines: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, first_line, heading_offset): page chunks with the number of headings before each."""
    chunk = F.sum(F.col("line").rlike(T.PAGE).cast("int")).over(by_line())
    per = with_headings(lines).withColumn("chunk_no", chunk).groupBy("doc_id", "chunk_no").agg(F.min("line_no").alias("first_line"), F.count("h_level").alias("n"))
    w = W.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    return per.select("doc_id", "chunk_no", "first_line", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("heading_offset"))


def mark_head(lines: DataFrame) -> DataFrame:
    """Adds head: the line belongs to the YAML head, from ``---`` in the first line to the next one, with a line at least between."""
    w = W.partitionBy("doc_id")
    opens = F.max(((F.col("line_no") == 0) & (F.col("line") == "---")).cast("int")).over(w) == 1
    closes = F.min(F.when((F.col("line_no") >= 2) & (F.col("line") == "---"), F.col("line_no"))).over(w)
    return lines.withColumn("head", F.coalesce(opens & (F.col("line_no") <= closes), F.lit(False)))


def relevel(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines with new levels for headings by their ordinal: changes(doc_id, h_no, new_level), clamped to 1 to 9.

    A YAML head is set aside: its lines hold no headings and stay as they are.
    """
    marked = mark_head(lines)
    head = marked.filter("head").select("doc_id", F.lit(0).alias("part"), "line_no", "line")
    body = _relevel_body(renumber(marked.filter(~F.col("head")), "line_no"), changes)
    return renumber(head.unionByName(body.select("doc_id", F.lit(1).alias("part"), "line_no", "line")), "part", "line_no")


def _relevel_body(lines: DataFrame, changes: DataFrame) -> DataFrame:
    canon = normalize_syntax(lines)
    h = collect_headings(canon).withColumn("h_no", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1)
    new = h.join(changes, ["doc_id", "h_no"]).select("doc_id", F.col("start_line_no").alias("s"), F.col("line_no").alias("e"), T.serialize(F.col("new_level"), F.col("text")).alias("new"))
    at_start = new.select("doc_id", F.col("s").alias("line_no"), "new")
    at_end = new.filter("s <> e").select("doc_id", F.col("e").alias("line_no"), F.lit(True).alias("gone"))
    out = canon.join(at_start, ["doc_id", "line_no"], "left").join(at_end, ["doc_id", "line_no"], "left").filter("gone is null")
    return renumber(out.select("doc_id", "line_no", F.posexplode(F.split(F.coalesce("new", "line"), "\n")).alias("sub", "line")), "line_no", "sub")


def parents(headings: DataFrame) -> DataFrame:
    """Adds parent_line: the nearest earlier heading of a smaller level; null for none. One window, no join."""
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w) for k in range(1, T.MAX_LEVEL)]
    above = [F.when(F.col("level") > k, c) for k, c in enumerate(last, 1)]
    return headings.withColumn("parent_line", F.greatest(*above))


def heading_chunks(lines: DataFrame) -> DataFrame:
    """(doc_id, h_no, chunk_no): the page chunk that holds each heading."""
    chunk = F.sum(F.col("line").rlike(T.PAGE).cast("int")).over(by_line())
    seen = with_headings(lines).withColumn("chunk_no", chunk).filter("h_level is not null")
    return seen.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1).alias("h_no"), "chunk_no")


def marker_coverage(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, markers, total, short): page markers found against the pages a document has; totals(doc_id, total)."""
    found = lines.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(T.PAGE)).alias("markers"))
    return found.join(totals, "doc_id").select("doc_id", "markers", "total", (F.col("markers") < F.col("total")).alias("short"))


def clean_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, headings_before, headings_after, lines_removed) of a clean-up."""
    count = lambda d, n: with_headings(d).groupBy("doc_id").agg(F.count("h_level").alias(f"headings_{n}"), F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), "doc_id", "left").fillna(0)
    return both.select("doc_id", "headings_before", "headings_after", (F.col("before") - F.col("after")).alias("lines_removed"))


def demoted(lines: DataFrame, choices: DataFrame) -> DataFrame:
    """Lines in which headings are plain text: choices(doc_id, h_no), by their ordinals."""
    canon = normalize_syntax(lines)
    h = collect_headings(canon).withColumn("h_no", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1)
    hit = h.join(choices.select("doc_id", "h_no").distinct(), ["doc_id", "h_no"]).select("doc_id", F.explode(F.sequence("start_line_no", "line_no")).alias("line_no"), F.col("line_no").alias("last"), "text")
    out = canon.join(hit, ["doc_id", "line_no"], "left").filter(F.col("last").isNull() | (F.col("line_no") == F.col("last")))
    return renumber(out.select("doc_id", "line_no", F.coalesce("text", "line").alias("line")), "line_no")


def promoted(lines: DataFrame, choices: DataFrame) -> DataFrame:
    """Lines in which a line chosen by its text is a heading: choices(doc_id, title, level); the first line that says it.

    A line says a title if it does without its heading marker and bold marks, or as it stands.
    """
    canon = normalize_syntax(lines)
    bare = T.js_trim(F.regexp_replace(F.regexp_replace("line", r"^#{1,9}\s+", ""), r"^\*\*(.+)\*\*\z", "$1"))
    seen = canon.withColumn("bare", bare)
    said = seen.join(choices, "doc_id").filter((F.col("bare") == F.col("title")) | (T.js_trim(F.col("line")) == F.col("title")))
    first = said.groupBy("doc_id", "title").agg(F.min(F.struct("line_no", "level", "bare")).alias("x")).select("doc_id", "x.line_no", T.serialize(F.col("x.level"), F.col("x.bare")).alias("new"))
    out = canon.join(first, ["doc_id", "line_no"], "left")
    return renumber(out.select("doc_id", "line_no", F.posexplode(F.split(F.coalesce("new", "line"), "\n")).alias("sub", "line")), "line_no", "sub")


def first_chunks(lines: DataFrame, loaded: int = 10) -> DataFrame:
    """Lines of the first page chunks, as a preview loads them ten at a time."""
    chunk = F.sum(F.col("line").rlike(T.PAGE).cast("int")).over(by_line())
    first = F.min("chunk").over(W.partitionBy("doc_id"))
    return lines.withColumn("chunk", chunk).withColumn("at", F.col("chunk") - first).filter(F.col("at") < loaded).drop("chunk", "at")
