"""Note references and definitions: numbering groups, gap filling, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V
from quire.operators.headings import by_line, carry_pages, mark_fences

BREAK = "<!-- ENDNOTE-SECTION-BREAK -->"


def note_refs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, seq, n): numbered references outside fences and definition lines, in order."""
    body = mark_fences(lines, tildes=False).filter(~F.col("masked") & ~F.col("line").rlike(T.NOTE_DEF))
    found = body.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(T.NOTE_REF), 1)).alias("seq", "n"))
    return found.select("doc_id", "line_no", "seq", F.col("n").cast("int").alias("n"))


def note_defs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, seq, n): numbered definition lines; fences don't hide them."""
    n = F.regexp_extract("line", T.NOTE_DEF, 1)
    return lines.withColumn("n", n).filter("n <> ''").select("doc_id", "line_no", F.lit(0).alias("seq"), F.col("n").cast("int").alias("n"))


def grouped(notes: DataFrame) -> DataFrame:
    """Adds g: a number below the one before starts a new group (chapter); an equal one doesn't."""
    w = W.partitionBy("doc_id").orderBy("line_no", "seq")
    reset = F.coalesce(F.col("n") < F.lag("n").over(w), F.lit(True))
    return notes.withColumn("reset", reset.cast("int")).withColumn("g", F.sum("reset").over(w)).drop("reset")


def numbering(lines: DataFrame) -> DataFrame:
    """(doc_id, numbering, defs, groups)."""
    per = grouped(note_defs(lines)).groupBy("doc_id").agg(F.count("*").alias("defs"), F.max("g").alias("groups"))
    return per.withColumn("numbering", F.when(F.col("groups") > 1, "per-chapter").otherwise("continuous"))


def gap_fill(lines: DataFrame, per_chapter: bool = True) -> DataFrame:
    """(doc_id, g, n, kind, line_no): references and stub definitions to insert, and the line of each anchor.

    Runs from 1 (per chapter) or the group's least number to its largest defined one. A missing reference goes
    before the first reference with a higher number, else after the last; a stub before the first higher
    definition, else after the last. A document whose groups of references and definitions differ in number is
    left alone.
    """
    def groups(notes: DataFrame, name: str) -> DataFrame:
        """One row a group: its notes in order; k: the number of groups of the document."""
        rows = F.sort_array(F.collect_list(F.struct("line_no", "seq", "n")))
        per = grouped(notes).groupBy("doc_id", "g").agg(rows.alias(name))
        return per.withColumn("k", F.max("g").over(W.partitionBy("doc_id")))

    both = groups(note_refs(lines), "r").join(groups(note_defs(lines), "d"), ["doc_id", "k", "g"])
    numbers = lambda x: F.transform(x, lambda y: y["n"])
    hi = F.array_max(numbers("d"))
    lo = F.lit(1) if per_chapter else F.least(F.array_min(numbers("d")), F.array_min(numbers("r")))
    run = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def missing(have: str, kind: str):
        gaps = F.array_except(run, numbers(have))
        spot = lambda n: F.coalesce(F.try_element_at(F.filter(have, lambda x: x["n"] > n), F.lit(1)), F.element_at(have, -1))["line_no"]
        return F.transform(gaps, lambda n: F.struct(n.alias("n"), F.lit(kind).alias("kind"), spot(n).alias("line_no")))

    return both.select("doc_id", "g", F.explode(F.concat(missing("r", "ref"), missing("d", "def"))).alias("gap")).select("doc_id", "g", "gap.*")


def reconcile(lines: DataFrame) -> DataFrame:
    """(doc_id, g, n, label, def_line, ref_line): references joined to definitions of the group of the same rank.

    label is e1, e2, ... by the definitions' order; ref_line is the first reference's, or null.
    """
    d = grouped(note_defs(lines)).groupBy("doc_id", "g", "n").agg(F.min("line_no").alias("def_line"))
    r = grouped(note_refs(lines)).groupBy("doc_id", "g", "n").agg(F.min("line_no").alias("ref_line"))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("def_line", "n"))
    return d.join(r, ["doc_id", "g", "n"], "left").withColumn("label", F.concat(F.lit("e"), k.cast("string")))


def repeat_refs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, seq, n, live): the first reference of a number is live, later ones are plain superscripts."""
    w = W.partitionBy("doc_id", "n").orderBy("line_no", "seq")
    return note_refs(lines).withColumn("live", F.row_number().over(w) == 1)


def note_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, label, page): the page that a label's first definition after a page marker stands on."""
    label = F.regexp_extract(T.js_trim(F.col("line")), r"^\[\^(\w+)\]:", 1)
    seen = carry_pages(lines).withColumn("label", label).filter("label <> '' and page is not null")
    return seen.groupBy("doc_id", "label").agg(F.min_by("page", "line_no").alias("page"))


def without_placeholders(lines: DataFrame) -> DataFrame:
    """Lines without definitions whose whole body is a bracketed stand-in."""
    t = T.js_trim(F.col("line"))
    return lines.filter(~(F.contains("line", F.lit("[^")) & (t.rlike(T.PLACEHOLDER) | t.rlike(T.MISSING))))  # most lines are no notes


def rename_labels(defs: DataFrame) -> DataFrame:
    """Adds new_label to (doc_id, batch_no, label): in its k-th batch a label becomes label_k.

    For labels that don't end in an underscore and digits themselves; ``quire.operators.folds.rename_labels``
    handles those as well.
    """
    k = F.dense_rank().over(W.partitionBy("doc_id", "label").orderBy("batch_no"))
    return defs.withColumn("new_label", F.when(k == 1, F.col("label")).otherwise(F.concat_ws("_", "label", k.cast("string"))))


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Lines in which each definition holds the paragraphs that followed it up to the next boundary.

    Another definition, a heading, its level comment, a notes label and a section break are boundaries. Blank lines
    in between go; page markers stay and so come after the merged note.
    """
    t = T.js_trim(F.col("line"))
    is_def, is_page = t.rlike(r"^\[\^\w+\]:"), t.rlike(r"(?i)^<!--\s*page:.*-->\z")
    bound = is_def | (V.is_furniture(F.col("line")) & ~is_page) | (t == BREAK)
    head = F.last(F.when(bound, F.struct("line_no", is_def.alias("note"))), ignorenulls=True).over(by_line())
    seen = lines.withColumn("t", t).withColumn("page", is_page).withColumn("head", head)
    inside = F.coalesce(F.col("head.note"), F.lit(False))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line", "t", "page")))  # each line is in one group's rows
    groups = seen.groupBy("doc_id", "head").agg(rows.alias("rows"))
    text = F.array_join(F.transform(F.filter("rows", lambda r: ~r["page"] & (r["t"] != "")), lambda r: r["t"]), " ")
    plain = lambda r: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"))
    merged = F.concat(F.array(F.struct(F.col("head.line_no").alias("line_no"), text.alias("line"))), F.transform(F.filter("rows", lambda r: r["page"]), plain))
    out = groups.select("doc_id", F.explode(F.when(inside, merged).otherwise(F.transform("rows", plain))).alias("r"))
    return out.select("doc_id", "r.line_no", "r.line")


def endnotes_to_links(lines: DataFrame) -> DataFrame:
    """Lines in which endnotes are plain links: ``[n](#en-n)`` for a reference, the same before a definition's text.

    Lines in backtick fences stay as they are, definitions that only echo a note's name go.
    """
    definition = r"^(\s*)\[\^(\w+)\]:[ \t]*(.*)$"
    echo = r"(?i)^\s*\[\^\w+\]:\s*\[\s*(?:end|foot)?note\s*\d*\s*\]\s*$"
    seen = mark_fences(lines, tildes=False).filter(F.col("masked") | ~F.col("line").rlike(echo))
    link = F.when(F.col("line").rlike(definition), F.regexp_replace("line", definition, "$1[$2](#en-$2) $3")).otherwise(F.regexp_replace("line", r"\[\^(\w+)\]", "[$1](#en-$1)"))
    return seen.select("doc_id", "line_no", F.when(F.col("masked"), F.col("line")).otherwise(link).alias("line"))


def shown_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, label, page, shown): a definition's page is shown where it differs from the one before."""
    label = F.regexp_extract(T.js_trim(F.col("line")), r"^\[\^(\w+)\]:", 1)
    defs = carry_pages(lines).withColumn("label", label).filter("label <> ''")
    return defs.select("doc_id", "line_no", "label", "page", (~F.col("page").eqNullSafe(F.lag("page").over(by_line())) & F.col("page").isNotNull()).alias("shown"))


def note_index(lines: DataFrame) -> DataFrame:
    """(doc_id, label, idx, text): notes numbered by their first definition; the last text counts."""
    pattern = r"^\[\^(\w+)\]:\s*(.*)$"
    defs = lines.select("doc_id", "line_no", F.regexp_extract("line", pattern, 1).alias("label"), F.regexp_extract("line", pattern, 2).alias("text")).filter("label <> ''")
    per = defs.groupBy("doc_id", "label").agg(F.min("line_no").alias("first"), F.max_by("text", "line_no").alias("text"))
    return per.select("doc_id", "label", F.row_number().over(W.partitionBy("doc_id").orderBy("first")).alias("idx"), "text")


def without_printed_notes(lines: DataFrame) -> DataFrame:
    """Lines without the furniture of printed notes sections: headings, level comments, page markers and labels.

    A run is a maximal stretch of definitions, furniture and blank lines; of one with definitions, the furniture
    from its start to its last definition goes. The definitions stay, for the notes of the export.
    """
    t = T.js_trim(F.col("line"))
    is_def, furniture = t.rlike(r"^\[\^\w+\]:"), V.is_furniture(F.col("line"))
    body = ~(is_def | furniture | (t == ""))
    run = lines.withColumn("is_def", is_def).withColumn("furniture", furniture & ~is_def).withColumn("run", F.sum(body.cast("int")).over(by_line()))
    last = F.max(F.when(F.col("is_def"), F.col("line_no"))).over(W.partitionBy("doc_id", "run"))
    gone = F.col("furniture") & (F.col("line_no") <= F.coalesce(F.col("last"), F.lit(-1)))
    return run.withColumn("last", last).filter(~gone).select("doc_id", "line_no", "line")


def chapter_breaks(lines: DataFrame) -> DataFrame:
    """(doc_id, g, line_no): the line before which each chapter of notes after the first begins.

    The nearest heading above the chapter's first reference and below the previous chapter's, with the furniture
    and blank lines right above it; without one, the reference's own line.
    """
    refs = grouped(note_refs(lines)).groupBy("doc_id", "g").agg(F.min("line_no").alias("first"))
    t = T.js_trim(F.col("line"))
    heading = t.rlike(r"^#{1,9}[ \t]+\S")
    loose = heading | t.rlike(T.META) | t.rlike(r"(?i)^<!--\s*page:.*-->\z") | (t == "")
    top = F.coalesce(F.last(F.when(~loose, F.col("line_no")), ignorenulls=True).over(by_line()), F.lit(-1)) + 1
    seen = lines.withColumn("top", top).withColumn("near", F.last(F.when(heading, F.struct("line_no", "top")), ignorenulls=True).over(by_line()))
    before = F.lag("first").over(W.partitionBy("doc_id").orderBy("g"))
    spots = refs.withColumn("before", before).filter("before is not null").join(seen.select("doc_id", F.col("line_no").alias("first"), "near"), ["doc_id", "first"])
    return spots.select("doc_id", "g", F.when(F.col("near.line_no") > F.col("before"), F.greatest(F.col("near.top"), F.col("before") + 1)).otherwise(F.col("first")).alias("line_no"))


def restarts(lines: DataFrame) -> DataFrame:
    """(doc_id, restarts): whether a definition at the start of a line has a smaller number than the one before it."""
    found = lines.select("doc_id", "line_no", F.regexp_extract("line", r"^\[\^(\d+)\]:", 1).alias("n")).filter("n <> ''").withColumn("n", F.col("n").cast("int"))
    drop = F.col("n") < F.lag("n").over(W.partitionBy("doc_id").orderBy("line_no"))
    return found.withColumn("drop", F.coalesce(drop, F.lit(False))).groupBy("doc_id").agg(F.bool_or("drop").alias("restarts"))
