"""The registered queries of the document-structure operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.functions import values as V
from quire.operators import blocks as BL
from quire.operators import convert as C
from quire.operators import edits as E
from quire.operators import export as EX
from quire.operators import folds as FO
from quire.operators import headings as H
from quire.operators import jobs as J
from quire.operators import notes as N
from quire.operators import outline as O
from quire.sources import files as FI
from quire.sources import providers as P
from quire.sources.corpora import CORPORA, corpus
from quire.streaming import batches as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, so that both engines agree on types."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema])


def query(name: str, source: str | tuple[str, ...], sql: str | None = None):
    """Registers a function of the named corpora (or tables, in capitals) as a query; sql: of the same result in DuckDB, after a WITH clause that defines the corpora."""
    names = (source,) if isinstance(source, str) else source

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = [corpus(spark, sf_dir, n) if n in CORPORA else spark.read.parquet(f"{sf_dir}/{n.lower()}.parquet") for n in names]
            return longs(f(*got))

        QUERIES[name] = run
        if sql:
            parts = [f"{n if n != names[0] or not n.endswith('_md') else 'lines'} AS ({CORPORA[n]})" for n in names if n in CORPORA]
            ORACLE_SQL[name] = ("WITH " + ",\n".join(parts) + (",\n" if sql.lstrip().startswith("--with") and parts else "\n") if parts else "WITH " if sql.lstrip().startswith("--with") else "") + sql.replace("--with", "", 1)
        return f

    return add


# DuckDB fragments: fences, headings.
FENCES = r"""--with f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS isf FROM lines),
m AS (SELECT *, isf OR (sum(CASE WHEN isf THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)) % 2 = 1 AS masked FROM f)"""
ATX = r"'^(#{1,9})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$'"
HEADS = (
    FENCES
    + rf""",
h0 AS (SELECT *, CASE WHEN masked THEN 0 ELSE length(regexp_extract(line, {ATX}, 1)) END AS hashes, regexp_extract(line, {ATX}, 2) AS title,
    CASE WHEN masked THEN '' ELSE regexp_extract(line, '(?i)^\s*<!--\s*heading-level:\s*([7-9])\s*-->\s*$', 1) END AS meta FROM m),
h1 AS (SELECT *, coalesce(lead(hashes) OVER w, 0) AS nh, lead(title) OVER w AS nt, coalesce(lag(meta) OVER w, '') AS pm FROM h0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
headings AS (SELECT doc_id, line_no + 1 AS line_no, line_no AS start_line_no, meta::INT AS level, nt AS text, nh AS md_level FROM h1 WHERE meta <> '' AND nh BETWEEN 1 AND 6
    UNION ALL SELECT doc_id, line_no, line_no, hashes, title, least(hashes, 6) FROM h1 WHERE hashes > 0 AND NOT (pm <> '' AND hashes <= 6))"""
)
NORMAL = (
    HEADS
    + """, o AS (SELECT doc_id, line_no, 0 AS sub, CASE WHEN meta <> '' AND nh > 0 THEN '<!-- heading-level: ' || meta || ' -->' WHEN hashes > 6 THEN '<!-- heading-level: ' || hashes::VARCHAR || ' -->' ELSE line END AS line FROM h1 WHERE NOT (pm <> '' AND hashes > 0)
    UNION ALL SELECT doc_id, line_no, 1, '###### ' || CASE WHEN meta <> '' THEN nt ELSE title END FROM h1 WHERE NOT (pm <> '' AND hashes > 0) AND ((meta <> '' AND nh > 0) OR hashes > 6))"""
)
SECTIONS = """, s AS (SELECT l.doc_id, l.line_no, l.line, count(h.line_no) OVER w AS section_no, h.level, h.text, last_value(h.line_no IGNORE NULLS) OVER w AS upto FROM lines l LEFT JOIN headings h ON l.doc_id = h.doc_id AND l.line_no = h.start_line_no WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line_no)),
    g AS (SELECT doc_id, section_no, coalesce(max(level), 0)::BIGINT AS level, max(text) AS heading, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no > coalesce(upto, -1)), '^\\s+|\\s+$', '', 'g'), '') AS content FROM s GROUP BY 1, 2)"""
SER = "CASE WHEN level <= 6 THEN repeat('#', level::INT) || ' ' || text ELSE '<!-- heading-level: ' || level::VARCHAR || ' -->' || chr(10) || '###### ' || text END"
REFS = r"""--with f AS (SELECT *, regexp_matches(line, '^\s*```') AS isf FROM lines),
m AS (SELECT *, isf OR (sum(CASE WHEN isf THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)) % 2 = 1 AS masked FROM f),
r0 AS (SELECT doc_id, line_no, regexp_extract_all(line, '\[\^(\d+)\]', 1) AS ns FROM m WHERE NOT masked AND NOT regexp_matches(line, '^\s*\[\^(\d+)\]:')),
refs AS (SELECT doc_id, line_no, (s - 1)::BIGINT AS seq, ns[s]::INT AS n FROM r0, unnest(range(1, len(ns) + 1)) t(s)),
defs AS (SELECT doc_id, line_no, 0::BIGINT AS seq, regexp_extract(line, '^\s*\[\^(\d+)\]:', 1)::INT AS n FROM lines WHERE regexp_matches(line, '^\s*\[\^(\d+)\]:')),
rz AS (SELECT *, CASE WHEN coalesce(n < lag(n) OVER (PARTITION BY doc_id ORDER BY line_no, seq), TRUE) THEN 1 ELSE 0 END AS z FROM refs),
dz AS (SELECT *, CASE WHEN coalesce(n < lag(n) OVER (PARTITION BY doc_id ORDER BY line_no, seq), TRUE) THEN 1 ELSE 0 END AS z FROM defs),
rg AS (SELECT doc_id, line_no, seq, n, (sum(z) OVER (PARTITION BY doc_id ORDER BY line_no, seq))::BIGINT AS g FROM rz),
dg AS (SELECT doc_id, line_no, seq, n, (sum(z) OVER (PARTITION BY doc_id ORDER BY line_no, seq))::BIGINT AS g FROM dz)"""
NORM = r"""trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '\*\*', '', 'g'), '(?i)\s*\([ivxlcdm\d\s,–-]+\)\s*$', ''), '(?i)\s*[—–-]\s*(?:p\.?\s*)?[ivxlcdm\d]+\s*$', ''), '^\d+(\.\d+)*\.?\s+', ''), '^[A-Z]\.?\s+', ''), '\s+', ' ', 'g')))"""
NORM4 = r"""trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '\*\*', '', 'g'), '(?i)\s*\([ivxlcdm\d\s,–-]+\)\s*$', ''), '^\d+(\.\d+)*\.?\s+', ''), '^[A-Z]\.?\s+', ''), '\s+', ' ', 'g')))"""  # without the rule for dashes
PAGES = [r"(?i)\s*\(\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*\)\s*$", r"(?i)\s+[—–-]\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*$", r"(?i),\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*$", r"(?i)\.{3,}\s*([ivxlcdm]+|\d+)\s*$", r"(?i)\s{2,}([ivxlcdm]+|\d+)\s*$"]
PAGE_OF = "coalesce(" + ", ".join(f"nullif(lower(regexp_extract(raw, '{p}', 1)), '')" for p in PAGES) + ")"
CUT = "trim(CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}') THEN regexp_replace(raw, '{p}', '')" for p in PAGES) + " ELSE raw END)"
OUTLINE = (
    HEADS
    + rf""",
e0 AS (SELECT doc_id, 0 AS src, line_no, level, text AS raw FROM headings
    UNION ALL SELECT doc_id, 1, line_no, least(9, floor(length(regexp_extract(line, '^(\s*)[*-]\s+(.+)$', 1)) / 2) + 1)::INT, regexp_extract(line, '^(\s*)[*-]\s+(.+)$', 2) FROM lines WHERE regexp_matches(line, '^(\s*)[*-]\s+(.+)$')),
e1 AS (SELECT doc_id, src, line_no, level, {CUT} AS text, {PAGE_OF} AS page FROM e0),
entries AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY src, line_no) - 1 AS entry_no, level, text, {NORM.format("text")} AS norm, page FROM e1 WHERE text <> '')"""
)

_FURNITURE = r"""u AS (SELECT *, trim(line) AS t, regexp_matches(trim(line), '^\[\^\w+\]:') AS d, regexp_matches(trim(line), '^#{1,9}[ \t]+\S') OR regexp_matches(trim(line), '(?i)^<!--\s*page:.*-->$') OR regexp_matches(trim(line), '(?i)^\s*<!--\s*heading-level:\s*([7-9])\s*-->\s*$') OR regexp_matches(trim(line), '(?i)^(end\s*notes|notes)$|^(notes?\s+(to|for)\b.*)$|^chapter\s+[0-9ivxlcdm]+\.?$') AS f FROM lines)"""

# Lines and headings.
query("split_lines", "DOCUMENTS", r"SELECT doc_id, s - 1 AS line_no, string_split(text, chr(10))[s] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(s)")(H.split_lines)
query("fence_mask", "deep_md", FENCES + " SELECT doc_id, line_no::BIGINT AS line_no, masked FROM m")(lambda d: H.mark_fences(d).select("doc_id", "line_no", "masked"))
query("collect_headings", "deep_md", HEADS + " SELECT doc_id, line_no::BIGINT AS line_no, start_line_no::BIGINT AS start_line_no, level::BIGINT AS level, text, md_level::BIGINT AS md_level FROM headings")(H.collect_headings)
query("heading_levels", "deep_md", HEADS + " SELECT level::BIGINT AS level, count(*) AS n FROM headings GROUP BY 1")(lambda d: H.collect_headings(d).groupBy("level").agg(F.count("*").alias("n")))
query("structural_report", "deep_md", HEADS + ", j AS (SELECT *, level > lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 AS jump FROM headings) SELECT doc_id, count(*) AS headings, count(*) FILTER (jump) AS jumps, max(level)::BIGINT AS deepest FROM j GROUP BY 1")(lambda d: H.structural_report(H.collect_headings(d)))
query("normalize_syntax", "deep_md", NORMAL + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS line_no, line FROM o")(H.normalize_syntax)
query("trailing_headings", "chat_md", HEADS + f", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS back FROM headings) SELECT doc_id, string_agg({SER}, chr(10) ORDER BY line_no) AS context FROM b WHERE back <= 5 GROUP BY 1")(lambda d: H.trailing_headings(H.collect_headings(d)))
query("page_of_line", "book_md", r" SELECT doc_id, line_no::BIGINT AS line_no, last_value(nullif(regexp_extract(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM lines")(lambda d: H.carry_pages(d).select("doc_id", "line_no", "page"))
query(
    "sections",
    "book_md",
    HEADS
    + SECTIONS
    + " SELECT * FROM g WHERE section_no > 0 OR content <> ''",
)(H.sections)
query(
    "chunk_offsets",
    "book_md",
    HEADS
    + r""", c AS (SELECT l.doc_id, l.line_no, h.line_no AS hl, (sum(CASE WHEN regexp_matches(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->') THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no))::BIGINT AS chunk_no FROM lines l LEFT JOIN headings h ON l.doc_id = h.doc_id AND l.line_no = h.start_line_no),
    p AS (SELECT doc_id, chunk_no, min(line_no)::BIGINT AS first_line, count(hl) AS n FROM c GROUP BY 1, 2)
    SELECT doc_id, chunk_no, first_line, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS heading_offset FROM p""",
)(H.chunk_offsets)

# Whole texts.
query("word_count", "DOCUMENTS", r"SELECT doc_id, len(regexp_split_to_array(text, '\s+')) AS words FROM documents")(lambda d: d.select("doc_id", X.word_count("text").alias("words")))
query("find_count", "DOCUMENTS", "SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS hits FROM documents")(lambda d: d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?i)\Qthe\E"), F.lit(0))).alias("hits")))
query("collapse_blanks", "deep_md", r" SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM lines GROUP BY 1")(lambda d: H.join_lines(d).select("doc_id", X.collapse_blanks(F.col("text")).alias("text")))
query("strip_fences", "deep_md", r""" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^```(?:markdown|md)?', ''), '```$', ''), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, (['```md', '```markdown ', '```', '', '  '])[(doc_id % 5 + 1)::INT] || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || CASE WHEN doc_id % 2 = 0 THEN '```' ELSE chr(10) END AS t FROM lines GROUP BY 1)""")(
    lambda d: H.join_lines(d).select("doc_id", X.strip_code_fence(F.concat(F.element_at(F.array(*map(F.lit, ("```md", "```markdown ", "```", "", "  "))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\n"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "```").otherwise("\n"))).alias("text"))
)
query("fix_artifacts", "deep_md", r""" SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '(?m)^(#{1,9})\s+#{1,9}\s+(.+)$', '\1 \2', 'g') AS text FROM lines GROUP BY 1""")(lambda d: H.join_lines(d).select("doc_id", X.single_marker(F.col("text")).alias("text")))
query(
    "doc_stats",
    "book_md",
    HEADS
    + r""", c AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->')) AS pages, count(*) FILTER (regexp_matches(line, '^\s*\|')) AS table_lines, sum(len(regexp_extract_all(line, '\[\^\w+\]')))::BIGINT AS note_marks FROM lines GROUP BY 1)
    SELECT c.*, coalesce(h.n, 0) AS headings FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM headings GROUP BY 1) h USING (doc_id)""",
)(
    lambda d: H.with_headings(d).groupBy("doc_id").agg(
        F.count_if(F.col("line").rlike(X.PAGE)).alias("pages"),
        F.count_if(F.col("line").rlike(r"^\s*\|")).alias("table_lines"),
        F.sum(F.size(F.regexp_extract_all("line", F.lit(r"\[\^\w+\]"), F.lit(0)))).alias("note_marks"),
        F.count("h_level").alias("headings"),
    )
)

# Notes.
query("note_refs", "book_md", REFS + " SELECT doc_id, line_no::BIGINT AS line_no, seq, n::BIGINT AS n FROM refs")(N.note_refs)
query("note_defs", "book_md", REFS + " SELECT doc_id, line_no::BIGINT AS line_no, n::BIGINT AS n FROM defs")(lambda d: N.note_defs(d).drop("seq"))
query("note_groups", "book_md", REFS + " SELECT doc_id, line_no::BIGINT AS line_no, seq, n::BIGINT AS n, g FROM rg")(lambda d: N.grouped(N.note_refs(d)))
query("numbering", "book_md", REFS + " SELECT doc_id, count(*) AS defs, max(g) AS groups, CASE WHEN max(g) > 1 THEN 'per-chapter' ELSE 'continuous' END AS numbering FROM dg GROUP BY 1")(N.numbering)
GAPS = (
    REFS
    + """, same AS (SELECT doc_id FROM (SELECT doc_id, max(g) AS k FROM rg GROUP BY 1) JOIN (SELECT doc_id, max(g) AS k FROM dg GROUP BY 1) USING (doc_id, k)),
    r AS (SELECT * FROM rg WHERE doc_id IN (FROM same)), d AS (SELECT * FROM dg WHERE doc_id IN (FROM same)),
    t AS (SELECT doc_id, g, max(n) AS hi, least(min(n), (SELECT min(r.n) FROM r WHERE r.doc_id = d.doc_id AND r.g = d.g)) AS lo FROM d GROUP BY doc_id, g),
    run AS (SELECT doc_id, g, unnest(range({lo}, hi + 1))::INT AS n FROM t),
    gr AS (SELECT doc_id, g, n, 'ref' AS kind FROM run ANTI JOIN r USING (doc_id, g, n)), gd AS (SELECT doc_id, g, n, 'def' AS kind FROM run ANTI JOIN d USING (doc_id, g, n))
    SELECT gr.doc_id, gr.g, gr.n::BIGINT AS n, kind, coalesce(arg_min(r.line_no, (r.line_no, r.seq)) FILTER (r.n > gr.n), max(r.line_no))::BIGINT AS line_no FROM gr JOIN r ON gr.doc_id = r.doc_id AND gr.g = r.g GROUP BY 1, 2, 3, 4
    UNION ALL SELECT gd.doc_id, gd.g, gd.n::BIGINT, kind, coalesce(min(d.line_no) FILTER (d.n > gd.n), max(d.line_no))::BIGINT FROM gd JOIN d ON gd.doc_id = d.doc_id AND gd.g = d.g GROUP BY 1, 2, 3, 4"""
)
query("gap_fill", "book_md", GAPS.replace("{lo}", "1"))(lambda d: N.gap_fill(d, True))
query("gap_fill_continuous", "book_md", GAPS.replace("{lo}", "lo"))(lambda d: N.gap_fill(d, False))
query(
    "reconcile_notes",
    "book_md",
    REFS
    + """, a AS (SELECT doc_id, g, n, min(line_no) AS def_line FROM dg GROUP BY 1, 2, 3), b AS (SELECT doc_id, g, n, min(line_no) AS ref_line FROM rg GROUP BY 1, 2, 3)
    SELECT doc_id, g, n::BIGINT AS n, def_line::BIGINT AS def_line, coalesce(ref_line, -1)::BIGINT AS ref_line, 'e' || (row_number() OVER (PARTITION BY doc_id ORDER BY def_line, n))::VARCHAR AS label FROM a LEFT JOIN b USING (doc_id, g, n)""",
)(lambda d: N.reconcile(d).withColumn("ref_line", F.coalesce("ref_line", F.lit(-1))))
query("repeat_refs", "book_md", REFS + " SELECT doc_id, line_no::BIGINT AS line_no, seq, n::BIGINT AS n, row_number() OVER (PARTITION BY doc_id, n ORDER BY line_no, seq) = 1 AS live FROM refs")(N.repeat_refs)
query(
    "note_pages",
    "book_md",
    r"""--with p AS (SELECT doc_id, line_no, regexp_extract(line, '^\[\^(\w+)\]:', 1) AS label, last_value(nullif(regexp_extract(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM lines)
    SELECT doc_id, label, arg_min(page, line_no) AS page FROM p WHERE label <> '' AND page IS NOT NULL GROUP BY 1, 2""",
)(N.note_pages)
query("strip_placeholders", "book_md", r" SELECT doc_id, line_no::BIGINT AS line_no, line FROM lines WHERE NOT regexp_matches(line, '(?i)^\s*\[\^\w+\]:\s*\[\s*(?:end|foot)?note\s*\d*\s*\]\s*$')")(N.without_placeholders)
query("rename_labels", "book_md", r"""--with b AS (SELECT DISTINCT doc_id, line_no // 20 AS batch_no, regexp_extract(line, '^\s*\[\^(\d+)\]:', 1) AS label FROM lines WHERE regexp_matches(line, '^\s*\[\^(\d+)\]:')), k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, label ORDER BY batch_no) AS k FROM b) SELECT doc_id, batch_no::BIGINT AS batch_no, label, CASE WHEN k = 1 THEN label ELSE label || '_' || k::VARCHAR END AS new_label FROM k""")(
    lambda d: N.rename_labels(N.note_defs(d).select("doc_id", F.floor(F.col("line_no") / 20).alias("batch_no"), F.col("n").cast("string").alias("label")).distinct())
)
query(
    "merge_continuations",
    "book_md",
    "--with "
    + _FURNITURE
    + r""", b AS (SELECT *, d OR (f AND NOT regexp_matches(t, '(?i)^<!--\s*page:.*-->$')) AS bound, regexp_matches(t, '(?i)^<!--\s*page:.*-->$') AS page FROM u),
    c AS (SELECT *, last_value(CASE WHEN bound THEN line_no END IGNORE NULLS) OVER w AS head, coalesce(last_value(CASE WHEN bound THEN d END IGNORE NULLS) OVER w, FALSE) AS inside FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    g AS (SELECT doc_id, head, string_agg(t, ' ' ORDER BY line_no) AS merged FROM c WHERE inside AND NOT page AND t <> '' GROUP BY 1, 2)
    SELECT c.doc_id, line_no::BIGINT AS line_no, CASE WHEN inside AND line_no = c.head THEN merged ELSE line END AS line FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.head = g.head WHERE NOT inside OR line_no = c.head OR page""",
)(N.merge_continuations)

# Outlines.
query("parse_outline", "outline_md", OUTLINE + " SELECT doc_id, entry_no, level::BIGINT AS level, text, norm, page FROM entries")(O.parse_outline)
BOOK_AND_OUTLINE = OUTLINE + ", bh AS (SELECT doc_id, line_no, regexp_extract(line, '^(#+) (.*)$', 2) AS text, length(regexp_extract(line, '^(#+) (.*)$', 1)) AS level FROM book_md WHERE line LIKE '#%'), bn AS (SELECT *, " + NORM.format("text") + " AS norm FROM bh)"
query("remap_levels", ("outline_md", "book_md"), BOOK_AND_OUTLINE + ", k0 AS (SELECT *, " + NORM4.format("raw") + " AS k FROM e0), fe AS (SELECT doc_id, k, arg_min(level, (src, line_no)) AS ol FROM k0 GROUP BY 1, 2), b4 AS (SELECT *, " + NORM4.format("text") + " AS k FROM bh) SELECT doc_id, line_no::BIGINT AS line_no, coalesce(ol, level)::BIGINT AS new_level FROM b4 LEFT JOIN fe USING (doc_id, k)")(
    lambda o, b: O.remap_levels(H.collect_headings(b), o).select("doc_id", "line_no", "new_level")
)
query("outline_guard_semi", ("outline_md", "book_md"), BOOK_AND_OUTLINE + " SELECT doc_id, line_no::BIGINT AS line_no, norm FROM bn SEMI JOIN entries USING (doc_id, norm)")(lambda o, b: O.in_outline(H.collect_headings(b), O.parse_outline(o)).select("doc_id", "line_no", "norm"))
query("missing_titles_anti", ("outline_md", "book_md"), BOOK_AND_OUTLINE + " SELECT doc_id, entry_no, norm FROM entries ANTI JOIN bn USING (doc_id, norm)")(lambda o, b: O.missing_titles(H.collect_headings(b), O.parse_outline(o)).select("doc_id", "entry_no", "norm"))

# Jobs, log, history, models.
query("log_groups", "joblog", " SELECT job_id, arg_min(file_name, (ts, id)) AS file_name, count(*) AS entries, max(ts) AS latest, bool_or(level IN ('warn', 'error')) AS has_issue FROM joblog GROUP BY 1")(J.log_groups)
query("log_filter", "joblog", " SELECT id, level, message FROM joblog WHERE (contains(lower(file_name), '-3') OR contains(lower(message), '-3')) AND level IN ('warn', 'error')")(lambda d: J.log_filter(d, "-3", "issues").select("id", "level", "message"))
query("log_newest_500", "joblog", " SELECT id, ts FROM joblog ORDER BY ts DESC, id DESC LIMIT 500")(lambda d: J.newest_log(d).select("id", "ts"))
query("log_counts", "joblog", " SELECT level, count(*) AS n FROM joblog GROUP BY 1")(lambda d: d.groupBy("level").agg(F.count("*").alias("n")))
KEY = "concat_ws('::', source_path, nullif(language, ''))"
query("history_upsert", "history", f" SELECT id, file_name, converted_at FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY (id::BIGINT % 4 = 0) DESC, converted_at DESC, id DESC) AS rn FROM history) WHERE rn = 1")(
    lambda d: J.upsert_history(d.filter("cast(id as bigint) % 4 <> 0"), d.filter("cast(id as bigint) % 4 = 0")).select("id", "file_name", "converted_at")
)
query("history_insert_absent", "history", f" SELECT id FROM history WHERE id::BIGINT % 2 = 0 UNION ALL SELECT id FROM history WHERE id::BIGINT % 2 = 1 AND {KEY} NOT IN (SELECT {KEY} FROM history WHERE id::BIGINT % 2 = 0)")(
    lambda d: J.insert_absent(d.filter("cast(id as bigint) % 2 = 0"), d.filter("cast(id as bigint) % 2 = 1")).select("id")
)
query("history_search", "history", " SELECT id FROM history WHERE contains(lower(file_name), 'file 12')")(lambda d: J.search_history(d, "File 12").select("id"))
Q = "'\"' || replace(coalesce({0}, ''), '\"', '\"\"') || '\"'"
query("history_csv", "history", " SELECT id, " + " || ',' || ".join(Q.format(c) for c in ("file_name", "source_path", "language", "total_pages::VARCHAR", "strftime(converted_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'", "floor(duration_ms / 1000 + 0.5)::BIGINT::VARCHAR")) + " AS line FROM history")(J.history_csv)
query("model_topk", "models", " SELECT id, context_length FROM models WHERE is_free ORDER BY coalesce(context_length, 0) DESC, id LIMIT 5")(lambda d: J.top_free(d).select("id", "context_length"))
query("model_rank", "models", " SELECT id, row_number() OVER (ORDER BY is_free DESC, coalesce(context_length, 0) DESC, id) AS place FROM models QUALIFY place <= 50")(lambda d: J.rank_models(d, 50).agg(F.sort_array(F.collect_list(F.struct((~F.col("is_free")).alias("a"), (-F.coalesce("context_length", F.lit(0))).alias("b"), "id"))).alias("r")).select(F.posexplode("r").alias("p", "r")).select("r.id", (F.col("p") + 1).alias("place")))
query("model_fallback", "models", " SELECT id, coalesce(nullif(CASE WHEN is_free THEN '' ELSE stage_model END, ''), nullif(provider_model, ''), display_name) AS model FROM models")(
    lambda d: d.withColumn("stage_model", F.when(F.col("is_free"), "").otherwise(F.col("stage_model"))).select("id", J.fallback("stage_model", "provider_model", "display_name").alias("model"))
)
query("skip_models_anti", "models", " SELECT id FROM models WHERE NOT is_free")(lambda d: J.without_skipped(d, d.filter("is_free")).select("id"))
query("unique_paths", "history", " SELECT id, CASE WHEN k = 0 THEN source_path ELSE regexp_replace(source_path, '(\\.[^./]*)?$', '') || ' (' || k::VARCHAR || ')' || regexp_extract(source_path, '(\\.[^./]*)$', 1) END AS unique_path FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY id) - 1 AS k FROM history)")(
    lambda d: J.unique_paths(d.withColumnRenamed("source_path", "path")).select("id", "unique_path")
)
query("queue_snapshot", "joblog", " SELECT id, CASE level WHEN 'error' THEN 'queued' WHEN 'warn' THEN 'interrupted' ELSE 'queued' END AS status FROM joblog WHERE level IN ('error', 'warn', 'info')")(
    lambda d: J.queue_snapshot(d.select("id", F.create_map(*[F.lit(x) for x in ("error", "error", "warn", "converting", "info", "queued", "success", "done")])[F.col("level")].alias("status")))
)
ROMANS = [("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")]
_NUMERAL = lambda n: F.concat(*[F.element_at(F.array(*map(F.lit, x)), (F.floor(n / k) % 10 + 1).cast("int")) for x, k in zip(ROMANS, (1000, 100, 10, 1))])
query("roman_to_int", "PART", "SELECT p_partkey, p_partkey % 3999 + 1 AS value, p_partkey % 3999 + 1 AS upper_value, NULL::BIGINT AS wrong FROM part")(
    lambda d: d.withColumn("r", _NUMERAL(F.col("p_partkey") % 3999 + 1)).select("p_partkey", X.roman_value(F.col("r")).cast("long").alias("value"), X.roman_value(F.upper("r")).cast("long").alias("upper_value"), X.roman_value(F.concat(F.col("r"), F.lit("iiii"))).cast("long").alias("wrong"))
)

# Folds: one decision depends on the last. SQL has them for corpora whose shape settles the decisions (documents
# shorter than the window, contents with nothing else between); tests hold the rest against line-by-line models.
REPEATS = HEADS + """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, trim(text) ORDER BY line_no) AS k FROM headings), l AS (SELECT lines.doc_id, lines.line_no, line FROM lines ANTI JOIN (SELECT doc_id, line_no FROM s WHERE k > 1) x USING (doc_id, line_no))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, line FROM l"""
query("toc_drop", "toc_md", r""" SELECT doc_id::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, line FROM lines WHERE NOT regexp_matches(line, '^(# Contents|## .* \.{5} \d+)$')""")(FO.drop_toc)
query("dedupe_headings", "chat_md", REPEATS)(FO.drop_repeated_headings)
query("flatten_outline", "outline_md", r"""--with o AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^#+ ') THEN repeat('  ', length(regexp_extract(line, '^(#+) ', 1)) - 1) || '- ' || regexp_extract(line, '^#+ (.*)$', 1) ELSE line END AS line FROM lines UNION ALL SELECT DISTINCT doc_id, -1, '<!-- Document Outline -->' FROM lines) SELECT doc_id, line_no::BIGINT + 1 AS line_no, line FROM o""")(lambda d: FO.flatten_outline(d.unionByName(d.select("doc_id", F.lit(-1).alias("line_no"), F.lit("<!-- Document Outline -->").alias("line")).distinct())))
query("clean_headings", "chat_md", REPEATS)(FO.clean_headings)
query(
    "pack_correct",
    "book_md",
    r""" SELECT doc_id, chunk_no, start, "end" FROM (WITH RECURSIVE t AS (SELECT doc_id, line_no, trim(line) = '' AS blank, CASE WHEN line = '' THEN 0 ELSE len(regexp_split_to_array(line, '\s+')) END AS words, max(line_no) OVER (PARTITION BY doc_id) AS top FROM lines),
    r(doc_id, line_no, start, words, cut, top) AS (
        SELECT doc_id, line_no, 0, words, words >= 200 AND blank, top FROM t WHERE line_no = 0
        UNION ALL SELECT t.doc_id, t.line_no, CASE WHEN cut THEN t.line_no ELSE r.start END, CASE WHEN cut THEN 0 ELSE r.words END + t.words, CASE WHEN cut THEN 0 ELSE r.words END + t.words >= 200 AND blank, r.top
        FROM r JOIN t ON t.doc_id = r.doc_id AND t.line_no = r.line_no + 1
    )
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_no, start::BIGINT AS start, (line_no + 1)::BIGINT AS "end" FROM r WHERE cut OR line_no = top)""",
)(lambda d: FO.correction_ranges(d, 200))
# No line of the fixture's documents is a heading or blank, so each is one chunk; tests hold the rest against models.
query("pack_translate", "DOCUMENTS", r"SELECT doc_id, 0::BIGINT AS chunk_no, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)")(lambda d: FO.translate_chunks(d).select("doc_id", "chunk_no", F.char_length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")))
query("translate_stub", "DOCUMENTS", r"SELECT doc_id, md5('[m1] ' || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")(lambda d: P.translate_documents(d, "Latin", ["m1", "m2"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5")))
query(
    "convert_pages",
    "DOCUMENTS",
    r"""WITH l AS (SELECT doc_id, s - 1 AS i, string_split(text, chr(10))[s] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(s)),
    p AS (SELECT doc_id, i // 4 AS page, string_agg(line, chr(10) ORDER BY i) AS t FROM l GROUP BY 1, 2), b AS (SELECT doc_id, page // 2 AS batch, regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY page), '^\s+|\s+$', '', 'g') AS t FROM p GROUP BY 1, 2)
    SELECT doc_id, count(*) AS total, md5(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY batch), '\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM b GROUP BY 1""",
)(
    lambda d: C.convert(
        d.select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int")), lambda k: F.array_join(F.slice("l", k * 4 + 1, F.lit(4)), "\n")).alias("pages")), ["m1"], size=2
    ).select("doc_id", "total", F.md5(F.col("text").cast("binary")).alias("text_md5"))
)
query(
    "rename_labels_exact",
    "book_md",
    r"""--with l AS (SELECT *, line_no // 20 AS batch_no, regexp_extract(line, '\[\^(\d+)\]', 1) AS n, regexp_matches(line, '^\[\^\d+\]:') AS d FROM lines),
    o AS (SELECT doc_id, batch_no, n, row_number() OVER (PARTITION BY doc_id, n ORDER BY batch_no) AS j FROM (SELECT DISTINCT doc_id, batch_no, n FROM l WHERE d))
    SELECT doc_id, batch_no::BIGINT AS batch_no, string_agg(CASE WHEN j > 1 THEN replace(line, '[^' || n || ']', '[^' || n || '_' || j::VARCHAR || ']') ELSE line END, chr(10) ORDER BY line_no) AS text FROM l LEFT JOIN o USING (doc_id, batch_no, n) GROUP BY 1, 2""",
)(lambda d: FO.rename_labels(H.join_lines(d.withColumn("doc_id", F.struct("doc_id", F.floor(F.col("line_no") / 20).alias("batch_no")))).select("doc_id.*", "text")))
BLOCKS = r"""--with b AS (SELECT doc_id, line_no, trim(line) AS line, CASE WHEN trim(line) = '' THEN 'blank' WHEN line LIKE '#%' THEN 'heading' WHEN line LIKE '<!--%' THEN 'page' WHEN regexp_matches(line, '^\|.*\|$') THEN 'table' ELSE 'paragraph' END AS kind FROM lines),
    c AS (SELECT *, kind = 'paragraph' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no), '') = 'paragraph' AS goes_on FROM b),
    d AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM c),
    blocks AS (SELECT doc_id, k, min(kind) AS kind, string_agg(line, ' ' ORDER BY line_no) AS t FROM d WHERE kind <> 'blank' GROUP BY 1, 2)"""
query(
    "docx_blocks",
    "book_md",
    BLOCKS
    + r""" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS block_no, kind, CASE kind WHEN 'heading' THEN length(regexp_extract(t, '^#+')) || chr(9) || regexp_replace(t, '^#+ ', '') WHEN 'page' THEN regexp_extract(t, 'page: (\S+)', 1)
        WHEN 'table' THEN '[["' || trim(string_split(t, '|')[2]) || '", "' || trim(string_split(t, '|')[3]) || '"]]' ELSE t END AS payload FROM blocks""",
)(BL.blocks)
_COMMANDS = r"""t AS (SELECT doc_id, line_no, list_transform(string_split(regexp_replace(trim(line), '^[-*]\s+', ''), '|'), lambda x: trim(x)) AS p FROM commands),
    w AS (SELECT *, upper(p[1]) AS word, try_cast(regexp_extract(coalesce(p[2], ''), '^([+-]?\d{1,9})', 1) AS INT) AS n, try_cast(regexp_extract(coalesce(p[3], ''), '^([+-]?\d{1,9})', 1) AS INT) AS lv FROM t),
    a AS (SELECT doc_id, line_no::BIGINT AS seq, CASE word WHEN 'MERGE_UP' THEN 'merge' ELSE lower(word) END AS action, n::BIGINT AS line, CASE WHEN word IN ('RELEVEL', 'PROMOTE', 'INSERT') THEN lv::BIGINT END AS level,
        CASE word WHEN 'RETITLE' THEN nullif(array_to_string(p[3:], '|'), '') WHEN 'INSERT' THEN nullif(array_to_string(p[4:], '|'), '') END AS text FROM w)"""
query(
    "parse_commands",
    "commands",
    "--with "
    + _COMMANDS
    + """
    SELECT doc_id, seq, action, line, coalesce(level, -1) AS level, text FROM a WHERE action IN ('retitle', 'relevel', 'merge', 'demote', 'promote', 'insert') AND line >= 1 AND (action NOT IN ('relevel', 'promote', 'insert') OR level BETWEEN 1 AND 9) AND (action NOT IN ('retitle', 'insert') OR text IS NOT NULL)""",
)(lambda d: E.parse_commands(d).withColumn("level", F.coalesce("level", F.lit(-1))))
query(
    "dedupe_commands",
    "commands",
    "--with " + _COMMANDS + f""", c AS (SELECT * FROM a WHERE action IN ('retitle', 'relevel', 'merge', 'demote', 'promote', 'insert') AND line >= 1 AND (action NOT IN ('relevel', 'promote', 'insert') OR level BETWEEN 1 AND 9) AND (action NOT IN ('retitle', 'insert') OR text IS NOT NULL)),
    k AS (SELECT *, list_position(['retitle', 'relevel', 'merge', 'demote', 'promote', 'insert'], action) AS r, CASE action WHEN 'insert' THEN 'insert:' || {NORM.format("text")} ELSE action || ':' || line::VARCHAR END AS key FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY seq DESC) AS back FROM k)
    SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY r, seq) AS place FROM b WHERE back = 1""",
)(lambda d: E.ordered_commands(E.parse_commands(d)).select("doc_id", "seq", "place"))
# DuckDB has to keep the numbered headings: inlined, it filters them before it numbers them.
query(
    "relevel_batch",
    "deep_md",
    NORMAL
    + r""", canon AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS line_no, line FROM o), """
    + HEADS.replace("--with f AS", "f2 AS").replace("FROM lines)", "FROM canon)").replace("m AS (SELECT", "m2 AS (SELECT", 1).replace("FROM f)", "FROM f2)").replace("h0 AS (", "x0 AS (").replace("FROM m)", "FROM m2)").replace("h1 AS (", "x1 AS (").replace("FROM h0 ", "FROM x0 ").replace("headings AS (", "again AS (").replace("FROM h1 ", "FROM x1 ")
    + r""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS h_no FROM again), c AS MATERIALIZED (SELECT *, h_no % 9 + 1 AS nl FROM n WHERE h_no % 4 = 0 AND h_no <= 40),
    r AS (SELECT l.doc_id, l.line_no, 0 AS sub, CASE WHEN nl IS NULL THEN line WHEN nl <= 6 THEN repeat('#', nl::INT) || ' ' || text ELSE '<!-- heading-level: ' || nl::VARCHAR || ' -->' END AS line FROM canon l LEFT JOIN c ON l.doc_id = c.doc_id AND l.line_no = c.start_line_no
        WHERE NOT EXISTS (SELECT 1 FROM c e WHERE e.doc_id = l.doc_id AND e.line_no = l.line_no AND e.start_line_no < e.line_no)
        UNION ALL SELECT doc_id, start_line_no, 1, '###### ' || text FROM c WHERE nl > 6)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS line_no, line FROM r""",
)(lambda d: H.relevel(d, d.select("doc_id").distinct().withColumn("h_no", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(4)))).withColumn("new_level", (F.col("h_no") % 9 + 1).cast("int"))))
query("retry_schedule", "PART", "SELECT p_partkey, (['a', 'b', 'c'])[((p_size - 1) // 2) % 3 + 1] AS model, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE p_size * 5 END::BIGINT AS delay_s FROM part")(
    lambda d: d.select("p_partkey", J.rotated(["a", "b", "c"], F.col("p_size")).alias("model"), J.retry_delay(F.element_at(F.array(*map(F.lit, ("skip", "rate", "overload", "other"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size")).cast("long").alias("delay_s"))
)
query("file_joins", ("history", "joblog"), " SELECT count(DISTINCT h.file_name) AS known FROM history h SEMI JOIN (SELECT 'file ' || job_id || '.pdf' AS f FROM joblog) j ON h.file_name = j.f")(
    lambda h, j: h.join(j.select(F.concat(F.lit("file "), "job_id", F.lit(".pdf")).alias("file_name")), "file_name", "left_semi").agg(F.countDistinct("file_name").alias("known"))
)
def _headed(d: DataFrame) -> DataFrame:
    """book_md under a head and an outline block."""
    first = F.array(F.lit("---"), F.concat(F.lit('title: "x: '), F.col("doc_id").cast("string"), F.lit('"')), F.concat(F.lit("pages: "), F.col("doc_id").cast("string")), *map(F.lit, ("---", "<!--Document Outline  -->", "", '- a "b"', "", "---")))
    return d.select("doc_id", (F.col("line_no") + 9).alias("line_no"), "line").unionByName(d.select("doc_id").distinct().select("doc_id", F.posexplode(first).alias("line_no", "line")))


query(
    "json_export",
    "book_md",
    HEADS + SECTIONS + """ SELECT doc_id, '{"metadata":{"title":"x: ' || doc_id::VARCHAR || '","pages":' || doc_id::VARCHAR || '},"outline":"- a \\"b\\"","sections":' || to_json(list({'level': level, 'heading': heading, 'content': content} ORDER BY section_no))::VARCHAR || '}' AS json FROM g WHERE section_no > 0 OR content <> '' GROUP BY 1""",
)(lambda d: EX.json_export(_headed(d)))
query(
    "docx_text",
    "book_md",
    BLOCKS.replace("FROM lines)", r"FROM lines WHERE NOT regexp_matches(line, '^\s*\[\^(\w+)\]:'))")
    + r""", e AS (SELECT *, regexp_replace(regexp_replace(t, '^#+ ', ''), '\[\^\w+\]', '', 'g') AS x FROM blocks)
    SELECT doc_id, string_agg(CASE kind WHEN 'page' THEN '— page ' || regexp_extract(t, 'page: (\S+)', 1) || ' —' WHEN 'table' THEN trim(string_split(x, '|')[2]) || chr(10) || trim(string_split(x, '|')[3]) || chr(10) ELSE x END, chr(10) ORDER BY k) AS text FROM e GROUP BY 1""",
)(EX.docx_text)
query(
    "html_export",
    "book_md",
    BLOCKS
    + r""", e AS (SELECT *, regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\[\^(\w+)\]', '<sup>\1</sup>', 'g') AS x, length(regexp_extract(t, '^#+'))::VARCHAR AS h FROM blocks)
    SELECT doc_id, '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' || chr(10) || string_agg(CASE kind WHEN 'heading' THEN '<h' || h || '>' || regexp_replace(x, '^#+ ', '') || '</h' || h || '>' WHEN 'page' THEN '<p>— page ' || regexp_extract(t, 'page: (\S+)', 1) || ' —</p>'
        WHEN 'table' THEN '<table><tr><td>' || trim(string_split(x, '|')[2]) || '</td><td>' || trim(string_split(x, '|')[3]) || '</td></tr></table>' ELSE '<p>' || x || '</p>' END, chr(10) ORDER BY k) || chr(10) || '</body></html>' AS html FROM e GROUP BY 1""",
)(EX.html_export)

# More notes, headings and values.
query("shown_pages", "book_md", r"""--with p AS (SELECT doc_id, line_no, regexp_extract(line, '^\[\^(\w+)\]:', 1) AS label, last_value(nullif(regexp_extract(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM lines), d AS (SELECT * FROM p WHERE label <> '') SELECT doc_id, line_no::BIGINT AS line_no, label, page, page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AND page IS NOT NULL AS shown FROM d""")(N.shown_pages)
query("note_index", "book_md", r"""--with d AS (SELECT doc_id, line_no, regexp_extract(line, '^\[\^(\w+)\]:\s*(.*)$', 1) AS label, regexp_extract(line, '^\[\^(\w+)\]:\s*(.*)$', 2) AS text FROM lines), g AS (SELECT doc_id, label, min(line_no) AS f, arg_max(text, line_no) AS text FROM d WHERE label <> '' GROUP BY 1, 2) SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS idx, text FROM g""")(N.note_index)
query(
    "strip_notes_section",
    "book_md",
    "--with "
    + _FURNITURE
    + """, r AS (SELECT *, sum((NOT (d OR f OR t = ''))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM u), e AS (SELECT *, max(CASE WHEN d THEN line_no END) OVER (PARTITION BY doc_id, run) AS l FROM r)
    SELECT doc_id, line_no::BIGINT AS line_no, line FROM e WHERE NOT (f AND NOT d AND line_no <= coalesce(l, -1))""",
)(N.without_printed_notes)
query(
    "chapter_breaks",
    "book_md",
    REFS
    + r""", c AS (SELECT doc_id, g, min(line_no) AS first FROM rg GROUP BY 1, 2), p AS (SELECT *, lag(first) OVER (PARTITION BY doc_id ORDER BY g) AS prev FROM c),
    k AS (SELECT *, regexp_matches(trim(line), '^#{1,9}[ \t]+\S') AS h, regexp_matches(trim(line), '^#{1,9}[ \t]+\S') OR regexp_matches(trim(line), '(?i)^<!--\s*page:.*-->$') OR trim(line) = '' AS loose FROM lines),
    q AS (SELECT p.doc_id, g, first, prev, (SELECT max(k.line_no) FROM k WHERE k.doc_id = p.doc_id AND k.h AND k.line_no <= first AND k.line_no > prev) AS near FROM p WHERE prev IS NOT NULL)
    SELECT doc_id, g, (CASE WHEN near IS NULL THEN first ELSE greatest(prev + 1, 1 + coalesce((SELECT max(k.line_no) FROM k WHERE k.doc_id = q.doc_id AND NOT k.loose AND k.line_no < near), -1)) END)::BIGINT AS line_no FROM q""",
)(N.chapter_breaks)
query("parent_heading", "deep_md", HEADS + " SELECT doc_id, line_no::BIGINT AS line_no, coalesce((SELECT max(p.line_no) FROM headings p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.level < h.level), -1)::BIGINT AS parent_line FROM headings h")(lambda d: H.parents(H.collect_headings(d)).select("doc_id", "line_no", F.coalesce("parent_line", F.lit(-1)).alias("parent_line")))
query("heading_chunks", "book_md", HEADS + r""", c AS (SELECT doc_id, line_no, (sum(CASE WHEN regexp_matches(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS chunk_no FROM lines) SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.line_no) - 1 AS h_no, chunk_no FROM headings h JOIN c ON h.doc_id = c.doc_id AND h.start_line_no = c.line_no""")(H.heading_chunks)
query("heading_ordinals", "deep_md", HEADS + " SELECT doc_id, count(*) AS n FROM headings GROUP BY 1")(lambda d: H.collect_headings(d).groupBy("doc_id").agg(F.count("*").alias("n")))
query("protected_lines", "book_md", r""" SELECT doc_id, line_no::BIGINT AS line_no FROM lines WHERE trim(line) = '' OR regexp_matches(trim(line), '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->') OR regexp_matches(trim(line), '^\[\^[^\]]+\]:|^[>|]|^([*+-]|\d+[.)])\s|^(```|~~~)')""")(lambda d: d.filter(V.is_protected(F.col("line"))).select("doc_id", "line_no"))
query(
    "endnotes_to_links",
    "book_md",
    REFS
    + r""" SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN masked THEN line WHEN regexp_matches(line, '^\s*\[\^\w+\]:') THEN regexp_replace(line, '^(\s*)\[\^(\w+)\]:[ \t]*(.*)$', '\1[\2](#en-\2) \3') ELSE regexp_replace(line, '\[\^(\w+)\]', '[\1](#en-\1)', 'g') END AS line
    FROM m WHERE masked OR NOT regexp_matches(line, '(?i)^\s*\[\^\w+\]:\s*\[\s*(?:end|foot)?note\s*\d*\s*\]\s*$')""",
)(N.endnotes_to_links)
query("frontmatter", "history", r""" SELECT id, '---' || chr(10) || 'title: "' || regexp_replace(file_name, '(?i)\.pdf$', '') || '"' || chr(10) || 'source_file: "' || file_name || '"' || chr(10) || 'pages: ' || total_pages::VARCHAR || chr(10) || 'converted: "' || strftime(converted_at, '%Y-%m-%d') || '"' || chr(10) || 'converter: "quire"' || chr(10) || 'provider: "p"' || chr(10) || 'model: "m"' || chr(10)
    || CASE WHEN total_pages % 3 = 0 THEN 'notes: "endnotes"' || chr(10) || CASE WHEN total_pages % 2 = 0 THEN 'notes_position: "section-end"' || chr(10) ELSE '' END ELSE '' END || '---' AS head FROM history""")(
    lambda d: d.select("id", V.frontmatter(F.col("file_name"), F.col("total_pages"), F.col("converted_at"), "p", "m", notes=F.when(F.col("total_pages") % 3 == 0, "endnotes").otherwise("footnotes"), position=F.when(F.col("total_pages") % 2 == 0, "section-end")).alias("head"))
)
query("frontmatter_fields", "history", " SELECT id, regexp_replace(file_name, '(?i)\\.pdf$', '') AS title, total_pages::VARCHAR AS pages, total_pages::VARCHAR AS word_pages, regexp_replace(file_name, '(?i)\\.pdf$', '') AS word_title FROM history")(
    lambda d: d.select("id", V.frontmatter(F.col("file_name"), F.col("total_pages"), F.col("converted_at"), "p", "m").alias("t")).select("id", V.frontmatter_map(F.col("t")).alias("f"), V.head_words(F.col("t")).alias("w")).select("id", F.col("f")["title"].alias("title"), F.col("f")["pages"].alias("pages"), F.col("w")["pages"].alias("word_pages"), F.col("w")["title"].alias("word_title"))
)
query("duration_text", "history", " SELECT id, CASE WHEN s < 60 THEN s::VARCHAR || 's' ELSE (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' END AS took FROM (SELECT id, floor(duration_ms / 1000 + 0.5)::BIGINT AS s FROM history)")(lambda d: d.select("id", V.duration_text(F.col("duration_ms")).alias("took")))
query("paths", "history", r" SELECT id, regexp_replace(source_path, '\.[^./\\]+$', '') || '.md' AS target, regexp_extract(source_path, '^(.*)[/\\][^/\\]*$', 1) AS folder FROM history")(lambda d: d.select("id", V.with_extension(F.col("source_path"), "md").alias("target"), V.folder_of(F.col("source_path")).alias("folder")))
query("escape_html", "PAGES", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages")(lambda d: d.select("page_id", V.escape_html(F.col("html")).alias("html")))
query("codecs", "CUSTOMER", "SELECT c_custkey, base64(encode(c_name)) AS b, hex(encode(c_name)) AS h FROM customer")(lambda d: d.select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("b"), F.hex(F.col("c_name").cast("binary")).alias("h")))
query("image_fit", "PART", "SELECT p_partkey, floor(w * least(1.0::DOUBLE, 576.0::DOUBLE / w) + 0.5)::BIGINT AS width, floor(p_size * least(1.0::DOUBLE, 576.0::DOUBLE / w) + 0.5)::BIGINT AS height FROM (SELECT *, p_size * 40 AS w FROM part)")(lambda d: d.select("p_partkey", V.fit_width(F.col("p_size") * 40, F.col("p_size")).alias("f")).select("p_partkey", "f.*"))
query("progress_percent", "ORDERS", "SELECT o_custkey, floor(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*) + 0.5)::BIGINT AS percent FROM orders GROUP BY 1")(lambda d: d.groupBy("o_custkey").agg(V.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("percent")))
query("error_categories", "EVENTS", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'rate' WHEN event_id % 5 = 1 THEN 'overload' WHEN event_id % 5 = 2 THEN 'key' WHEN contains(event_type, 'e') AND event_type = 'error' THEN 'network' ELSE 'other' END AS category FROM events")(
    lambda d: d.select("event_id", V.error_category(F.element_at(F.array(*map(F.lit, (429, 503, 401, 0, 0))), (F.col("event_id") % 5 + 1).cast("int")), F.when(F.col("event_type") == "error", "network down").otherwise("?")).alias("category"))
)
query("reuse_transcription", "history", " SELECT j.id, d.reuse_id FROM history j JOIN (SELECT source_path, arg_max(id, (converted_at, id)) AS reuse_id FROM history WHERE coalesce(language, '') = '' GROUP BY 1) d USING (source_path) WHERE j.language <> ''")(lambda d: J.reusable(d.filter("language <> ''"), d).filter("reuse_id is not null").select("id", "reuse_id"))
query("available_models", "models", " SELECT id FROM models WHERE is_free AND context_length IS NOT NULL")(lambda d: J.available_priority(d.filter("is_free"), d.filter("context_length is not null")).select("id"))
query("note_labels", "book_md", r""" SELECT doc_id, line_no::BIGINT AS line_no FROM lines WHERE regexp_matches(trim(replace(line, '### ', '')), '(?i)^(end\s*notes|notes)$|^(notes?\s+(to|for)\b.*)$|^chapter\s+[0-9ivxlcdm]+\.?$')""")(lambda d: d.filter(V.is_notes_label(F.replace("line", F.lit("### "), F.lit("")))).select("doc_id", "line_no"))
query(
    "preview_chunks",
    "book_md",
    r"""--with c AS (SELECT *, sum(CASE WHEN line LIKE '<!-- page:%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k, max(line_no) OVER (PARTITION BY doc_id) AS top FROM lines)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_no, string_agg(line, chr(10) ORDER BY line_no) || CASE WHEN max(line_no) < max(top) THEN chr(10) ELSE '' END AS text FROM c GROUP BY doc_id, k""",
)(FO.preview_chunks)
query("page_ranges", "ORDERS", "SELECT o_orderkey AS doc_id, b AS batch_no, b * 5 AS start, least(b * 5 + 5, n) AS \"end\" FROM (SELECT o_orderkey, (o_custkey % 23)::BIGINT AS n FROM orders), unnest(range(0, (n + 4) // 5)) t(b)")(lambda d: FI.page_ranges(d.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 23).alias("pages"))))

# Model answers, pages, tables and moves.
query(
    "ocr_pages",
    "book_md",
    r""" SELECT doc_id, string_agg(CASE WHEN line LIKE '## %' THEN '<!-- page: ' || CASE WHEN length(n) > 4 OR n = '7' THEN '7' ELSE least(n::INT, 7)::VARCHAR || '-' || greatest(n::INT, 7)::VARCHAR END || ' -->' ELSE line END || chr(10) || 'body', chr(10) || chr(10) ORDER BY line_no) AS text
    FROM (SELECT *, regexp_extract(line, '(\d+)$', 1) AS n FROM lines) GROUP BY 1""",
)(lambda d: FO.ocr_texts(d.select("doc_id", F.col("line_no").alias("index"), F.concat(F.col("line"), F.lit("\nbody")).alias("markdown"), F.when(F.col("line").startswith("## "), F.concat(F.col("line"), F.lit("\n7"))).alias("header"), F.lit(None).cast("string").alias("footer"))))
query("sse_decode", "DOCUMENTS", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 = 0 THEN 'failed ' || doc_id::VARCHAR END AS error FROM documents")(
    lambda d: FO.streamed_texts(
        d.select("doc_id", *[F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n")).alias(n) for n, x in (("a", F.left("text", F.lit(40))), ("b", F.substr("text", F.lit(41))))])
        .withColumn("e", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('data: {"error":{"message":"failed '), F.col("doc_id").cast("string"), F.lit('"}}\n'))).otherwise(": quiet\ndata: {broken\n"))
        .select("doc_id", F.concat("a", "e", "b", F.lit("data: [DONE]\n")).alias("j"))
        .select("doc_id", F.posexplode(F.array(F.left("j", F.lit(9)), F.substr("j", F.lit(10), F.lit(50)), F.substr("j", F.lit(60)))).alias("seq", "piece"))
    )
)
query(
    "inline_runs",
    "book_md",
    r"""--with p AS (SELECT doc_id, line_no, list_filter(string_split(regexp_replace(line, '(\[\^\w+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM lines),
    q AS (SELECT doc_id, line_no, CASE WHEN len(p) = 0 THEN [''] ELSE p END AS p FROM p), r AS (SELECT doc_id, line_no, s - 1 AS run_no, p[s] AS t, regexp_extract(p[s], '^\[\^(\w+)\]$', 1) AS note FROM q, unnest(range(1, len(p) + 1)) u(s))
    SELECT doc_id, line_no::BIGINT AS line_no, run_no, CASE WHEN note = '' THEN t ELSE '' END AS text, FALSE AS bold, FALSE AS italic, FALSE AS sup, FALSE AS sub, FALSE AS brk, nullif(note, '') AS note FROM r""",
)(BL.inline_runs)
query("table_rows", "book_md", r""" SELECT doc_id, trim(string_split(line, '|')[2]) AS first_cell FROM lines WHERE regexp_matches(line, '^\|.*\|$')""")(lambda d: BL.table_rows(d).select("doc_id", F.col("cells")[0].alias("first_cell")))
query("safe_urls", "PAGES", "SELECT page_id, page_id % 5 NOT IN (1, 3) AS safe FROM pages")(
    lambda d: d.select("page_id", V.is_safe_url(F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("JavaScript:"), "url")).when(F.col("page_id") % 5 == 2, F.regexp_replace("url", "^https?:", "")).when(F.col("page_id") % 5 == 3, F.concat(F.lit("vbscript:"), "url")).when(F.col("page_id") % 5 == 4, "mailto:a@b.example").otherwise(F.col("url"))).alias("safe"))
)
query("moved_levels", "deep_md", HEADS + " SELECT doc_id, line_no::BIGINT AS line_no, (CASE WHEN level + 2 BETWEEN 1 AND 9 THEN level + 2 ELSE level END)::BIGINT AS level FROM headings")(lambda d: H.collect_headings(d).select("doc_id", "line_no", V.moved_level(F.col("level"), F.lit(2)).alias("level")))
query("note_style", "ORDERS", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'footnotes' WHEN 1 THEN 'endnotes' WHEN 2 THEN 'none' ELSE 'unknown' END AS style FROM orders")(
    lambda d: d.select("o_orderkey", V.note_style(F.concat(F.lit("# x\n note style: "), F.element_at(F.array(*map(F.lit, ("Footnotes", "ENDNOTES", "none", "mixed"))), (F.col("o_orderkey") % 4 + 1).cast("int")))).alias("style"))
)
query("outline_block", "ORDERS", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '# A' || chr(10) || o_orderpriority END AS outline FROM orders")(
    lambda d: d.select("o_orderkey", V.outline_block(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.when(F.col("o_orderkey") % 4 == 0, "x\n<!-- Document Outline -->\n\n# A\n").otherwise("<!--Document Outline \t-->\n\n# A\n"), "o_orderpriority", F.lit("\n\n---\nbody\n\n---\n"))).otherwise("none")).alias("outline"))
)
query("text_models", "models", " SELECT id FROM models WHERE length(display_name) % 4 = 0")(
    lambda d: J.text_models(d.withColumn("modality", F.element_at(F.array(F.lit("text+image-> text"), F.lit("text->image"), F.lit("text->text+image"), F.lit(None).cast("string")), (F.length("display_name") % 4 + 1).cast("int")))).select("id")
)
query("cached_models", "models", " SELECT id FROM models WHERE 100000000 - coalesce(context_length, 0) * 50000 < 86400000")(lambda d: J.cached_models(d.withColumn("cached_at", F.coalesce("context_length", F.lit(0)) * 50_000), 100_000_000).select("id"))
query("translated_paths", "history", r""" SELECT id, CASE WHEN coalesce(language, '') = '' THEN source_path ELSE regexp_replace(source_path, '(\.[^./]*)$', '.' || language || '\1') END AS target FROM history""")(lambda d: d.select("id", FI.translated_path("source_path", "language").alias("target")))

# Values, labels and bookkeeping that the queries above leave out.
query("has_endnotes", "ORDERS", "SELECT o_orderkey, o_orderkey % 3 = 0 AS endnotes FROM orders")(
    lambda d: d.select("o_orderkey", V.has_endnotes(F.concat(F.lit("---\ntitle: x\nnotes: "), F.element_at(F.array(F.lit('"endnotes"'), F.lit("footnotes"), F.lit("none")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("\n---\n"))).alias("endnotes"))
)
query("printed_page", "PART", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_partkey % 10000)::VARCHAR WHEN 1 THEN 'xiv' WHEN 2 THEN '12' WHEN 3 THEN '7' WHEN 4 THEN 'iv' END AS label FROM part")(
    lambda d: d.select(
        "p_partkey",
        X.printed_page(
            F.element_at(F.array(F.concat(F.lit(" "), (F.col("p_partkey") % 10000).cast("string")), F.lit("VIVID 12345"), F.lit("Page 12 of 300"), F.lit("x 7 y"), F.lit("vivid"), F.lit("IIII -")), (F.col("p_partkey") % 6 + 1).cast("int")),
            F.element_at(F.array(F.lit("9"), F.lit("a XIV b"), F.lit("9"), F.lit("9"), F.lit("IV "), F.lit("MIX.")), (F.col("p_partkey") % 6 + 1).cast("int")),
        ).alias("label"),
    )
)
query("title_of_file", "PART", "SELECT p_partkey, p_name || ' ' || p_brand || ' — ' || p_size::VARCHAR AS title FROM part")(
    lambda d: d.select("p_partkey", X.title_of_file(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__"), "p_brand", F.lit(" - "), F.col("p_size").cast("string"), F.lit(".PDF"))).alias("title"))
)
query("decode_entities", "PAGES", "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&#', '&_'), '&nbsp;', chr(160)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"') || chr((page_id % 200 + 40)::INT) || '|' || chr(65533) || chr(65) AS html FROM pages")(
    lambda d: d.select("page_id", V.decode_entities(F.concat(F.replace("html", F.lit("&#"), F.lit("&_")), F.lit("&#"), (F.col("page_id") % 200 + 40).cast("string"), F.lit(";|&#55296;&#6553600065;"))).alias("html"))
)
query("shown_label", "LINEITEM", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'n_' || l_suppkey::VARCHAR || 'a' AS label, count(*) AS n FROM lineitem GROUP BY ALL")(
    lambda d: d.select("l_orderkey", "l_linenumber", V.shown_label(F.concat(F.lit("n_"), F.col("l_suppkey").cast("string"), F.lit("a_"), F.col("l_linenumber").cast("string"))).alias("label")).groupBy("l_orderkey", "l_linenumber", "label").agg(F.count("*").alias("n"))
)
query("plain_label", "PART", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS label FROM part")(
    lambda d: d.select("p_partkey", V.plain_label(F.concat(F.lit(" **"), "p_name", F.lit("** `"), "p_brand", F.lit("` ["), "p_type", F.lit("](#a) "))).alias("label"))
)
query("price_projection", "models", " SELECT id, context_length * 0.5::DOUBLE AS per_million, is_free FROM models")(
    lambda d: d.select("id", V.price_per_million(F.col("context_length") * F.lit(0.5) / 1_000_000).alias("p"), "is_free").select("id", F.round("p", 3).alias("per_million"), "is_free")
)
query("printed_numbering", "book_md", r""" SELECT doc_id, coalesce(bool_or(n < p), FALSE) AS restarts FROM (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (
    SELECT doc_id, line_no, regexp_extract(line, '^\[\^(\d+)\]:', 1)::INT AS n FROM lines WHERE regexp_matches(line, '^\[\^(\d+)\]:'))) GROUP BY 1""")(N.restarts)
query("marker_coverage", ("book_md", "ORDERS"), r""" SELECT doc_id, markers, total, markers < total AS short FROM (SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->')) AS markers FROM lines GROUP BY 1)
    JOIN (SELECT o_custkey AS doc_id, count(*) + max(o_orderkey % 2) AS total FROM orders GROUP BY 1) USING (doc_id)""")(
    lambda d, o: H.marker_coverage(d, o.groupBy(F.col("o_custkey").alias("doc_id")).agg((F.count("*") + F.max(F.col("o_orderkey") % 2)).alias("total")))
)
query("clean_delta", "chat_md", HEADS + """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, trim(text) ORDER BY line_no) AS k FROM headings)
    SELECT doc_id, count(*) AS headings_before, count(*) FILTER (k = 1) AS headings_after, count(*) FILTER (k > 1) AS lines_removed FROM s GROUP BY 1""")(lambda d: H.clean_delta(d, FO.clean_headings(d)))
query("command_stats", "commands", "--with " + _COMMANDS + " SELECT doc_id, action, count(*) AS n FROM a WHERE action IN ('retitle', 'relevel', 'merge', 'demote', 'promote', 'insert') AND line >= 1 AND (action NOT IN ('relevel', 'promote', 'insert') OR level BETWEEN 1 AND 9) AND (action NOT IN ('retitle', 'insert') OR text IS NOT NULL) GROUP BY 1, 2")(
    lambda d: E.parse_commands(d).groupBy("doc_id", "action").agg(F.count("*").alias("n"))
)
query("model_sets", "models", " SELECT id, CASE WHEN stage_model = provider_model THEN concat_ws('|', stage_model, id) ELSE concat_ws('|', stage_model, id, provider_model) END AS both_lists, CASE WHEN provider_model = stage_model THEN '' ELSE provider_model END AS left_over FROM models")(
    lambda d: d.select("id", F.array_join(F.array_distinct(F.array("stage_model", "id", "stage_model", "provider_model")), "|").alias("both_lists"), F.array_join(F.array_except(F.array("provider_model", "id"), F.array("id", "stage_model")), "|").alias("left_over"))
)
query("rehydrated_queue", ("joblog", "history"), """ SELECT j.id, CASE WHEN j.level = 'error' THEN 'queued' ELSE 'interrupted' END AS status, h.done FROM joblog j
    LEFT JOIN (SELECT id, max(total_pages) AS done FROM history GROUP BY 1) h USING (id) WHERE j.level IN ('error', 'warn') AND (j.file_name LIKE 'book-1%' OR h.done IS NOT NULL)""")(
    lambda j, h: J.rehydrated(
        j.select("id", "file_name", F.when(F.col("level") == "error", "error").when(F.col("level") == "warn", "converting").otherwise("done").alias("status")),
        h.groupBy("id").agg(F.max("total_pages").alias("done")),
        j.filter("file_name like 'book-1%'").select("file_name").distinct(),
    ).select("id", "status", "done")
)
query("files_in_history", "history", f""" SELECT h.id, coalesce(k.n, 0) AS earlier FROM history h LEFT JOIN (SELECT {KEY} AS k, count(*) AS n FROM history WHERE id::BIGINT % 4 = 0 GROUP BY 1) k ON {KEY.replace('source_path', 'h.source_path').replace('language', 'h.language')} = k.k WHERE h.id::BIGINT % 4 <> 0""")(
    lambda d: J.with_history(d.filter("cast(id as bigint) % 4 <> 0"), d.filter("cast(id as bigint) % 4 = 0")).select("id", "earlier")
)
query("queue_moves", "joblog", " SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN event_place = 1 THEN 3.5 ELSE event_place END) AS place FROM (SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, id) AS event_place FROM joblog)")(lambda d: J.moved(d, 1, 3))
query("settings_migrated", "models", " SELECT id, coalesce(context_length, 4096) AS context_length, 5::BIGINT AS pages_per_batch FROM models")(lambda d: J.migrated(d.select("id", "context_length"), {"context_length": 4096, "pages_per_batch": 5}).select("id", "context_length", F.col("pages_per_batch").cast("long").alias("pages_per_batch")))
query("new_jobs", "history", " SELECT file_name, source_path, 'queued' AS status, 0::BIGINT AS progress, TRUE AS fresh FROM history")(lambda d: J.new_jobs(d).select("file_name", "source_path", "status", "progress", (F.col("error").isNull() & (F.length("id") == 36)).alias("fresh")))
query("image_sizes", "PART", "SELECT p_partkey, p_size::BIGINT AS width, (p_partkey % 60000)::BIGINT AS height FROM part")(
    lambda d: d.select("p_partkey", V.image_size(F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(F.col("p_size").cast("long")), 8, "0")), F.unhex(F.lpad(F.hex(F.col("p_partkey") % 60000), 8, "0")))).alias("s")).select("p_partkey", "s.width", "s.height")
)
query("batch_progress", ("LINEITEM", "ORDERS"), "SELECT o_orderkey AS doc_id, done, total, floor(done * 100 / total + 0.5)::BIGINT AS percent FROM (SELECT o_orderkey, 8::BIGINT AS total FROM orders) JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS done FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 0, 8, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda li, o: B.progress(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("batch_no")), o.select(F.col("o_orderkey").alias("doc_id"), F.lit(8).cast("long").alias("total")))
)
query("latest_results", "EVENTS", "SELECT user_id AS doc_id, event_type AS batch_no, max(event_id) AS epoch FROM events GROUP BY 1, 2")(lambda d: B.latest(d.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("batch_no"), F.col("event_id").alias("epoch")), "doc_id", "batch_no"))
query("page_label_order", "CUSTOMER", "SELECT c_custkey, c_custkey % 89 + 1 AS first_page, c_custkey % 89 + 11 AS last_page FROM customer")(
    lambda d: d.select("c_custkey", V.ordered_labels(F.array(*[(F.col("c_custkey") % 89 + k).cast("string") for k in (11, 1, 9)])).alias("p")).select("c_custkey", F.col("p")[0].cast("long").alias("first_page"), F.element_at("p", -1).cast("long").alias("last_page"))
)

# Orders, listings, stores and what a session remembers.
query("history_newest", "history", " SELECT id, row_number() OVER (ORDER BY converted_at DESC, id DESC) AS place FROM history QUALIFY place <= 100")(lambda d: J.newest_history(d, 100).select("id", "place"))
query("log_groups_newest", "joblog", " SELECT job_id, row_number() OVER (ORDER BY max(ts) DESC, job_id DESC) AS place FROM joblog GROUP BY 1 QUALIFY place <= 20")(lambda d: J.newest_groups(d, 20).select("job_id", "place"))
query("model_ids_descending", "models", " SELECT id, row_number() OVER (ORDER BY id DESC) AS place FROM (SELECT DISTINCT id FROM models) QUALIFY place <= 30")(lambda d: J.ids_descending(d, 30))
query("first_chunks", "book_md", r"""--with c AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^\s*<!--\s*page:\s*(\S+)\s*-->') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines) SELECT doc_id, count(*) AS lines FROM c WHERE k < 3 GROUP BY 1""")(lambda d: H.first_chunks(d, 3).groupBy("doc_id").agg(F.count("*").alias("lines")))
query("listed_models", "models", " SELECT id, service FROM (SELECT CASE WHEN context_length % 3 = 0 THEN 'gpt-' || id || CASE WHEN context_length % 2 = 0 THEN '-Instruct' ELSE '' END WHEN context_length % 3 = 1 THEN 'gemini-2.5-flash-' || id ELSE 'gemini-1-pro-' || id END AS id, context_length AS c FROM models), (VALUES ('openai'), ('gemini'), ('other')) s(service) WHERE CASE service WHEN 'openai' THEN c % 3 = 0 AND c % 2 = 1 WHEN 'gemini' THEN c % 3 = 1 ELSE TRUE END")(
    lambda d: (
        lambda m: J.listed_models(m, "openai").withColumn("service", F.lit("openai")).unionByName(J.listed_models(m, "gemini").withColumn("service", F.lit("gemini"))).unionByName(J.listed_models(m, "other").withColumn("service", F.lit("other")))
    )(d.select(F.when(F.col("context_length") % 3 == 0, F.concat(F.lit("gpt-"), "id", F.when(F.col("context_length") % 2 == 0, "-Instruct").otherwise(""))).when(F.col("context_length") % 3 == 1, F.concat(F.lit("gemini-2.5-flash-"), "id")).otherwise(F.concat(F.lit("gemini-1-pro-"), "id")).alias("id")))
)
query("stored_outlines", "history", " SELECT source_path AS job_id, arg_max(file_name, (converted_at, id)) AS content FROM history WHERE id::BIGINT % 2 = 0 GROUP BY 1")(
    lambda d: J.stored(d.select(F.when(F.col("id").cast("long") % 2 == 0, "outline").otherwise("translate-src").alias("kind"), F.col("source_path").alias("job_id"), F.struct("converted_at", "id").alias("written_at"), F.col("file_name").alias("content")), "outline")
)
query("session_skips", "joblog", " SELECT job_id AS session, file_name AS model, arg_max(message, (ts, id)) AS reason FROM joblog WHERE level = 'error' GROUP BY 1, 2")(
    lambda d: J.session_skips(d.filter("level = 'error'").select(F.col("job_id").alias("session"), F.col("file_name").alias("model"), F.col("message").alias("reason"), F.struct("ts", "id").alias("at")))
)
query("text_progress", "CONVERSATIONS", "SELECT conv_id AS doc_id, turn AS seq, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS chars FROM conversations")(lambda d: J.text_progress(d.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"))).select("doc_id", "seq", F.col("chars").cast("long").alias("chars")))
query("deduped_styles", "PART", "SELECT p_brand AS style_id, coalesce(arg_max(p_name, p_partkey) FILTER (p_size % 2 = 0), arg_max(p_name, p_partkey)) AS name FROM part GROUP BY 1")(
    lambda d: J.deduped_styles(d.select(F.col("p_brand").alias("style_id"), F.col("p_partkey").alias("at"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "<w:outlineLvl/>").otherwise("")).alias("xml"))).select("style_id", F.replace("xml", F.lit("<w:outlineLvl/>"), F.lit("")).alias("name"))
)
query("relative_dates", "history", " SELECT id, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d::VARCHAR || ' days ago' WHEN year(converted_at) = 1998 THEN strftime(converted_at, '%b %-d') ELSE strftime(converted_at, '%b %-d, %Y') END AS shown FROM (SELECT id, converted_at, floor((epoch_ms(TIMESTAMP '1998-08-03 12:00:00') - epoch_ms(converted_at)) / 86400000)::BIGINT AS d FROM history)")(
    lambda d: d.select("id", V.relative_date(F.col("converted_at"), F.lit("1998-08-03 12:00:00").cast("timestamp")).alias("shown"))
)
query("price_texts", "models", " SELECT id, CASE WHEN context_length IS NULL THEN 'Free' WHEN context_length % 4 = 0 THEN NULL WHEN context_length % 4 = 1 THEN '$0.25/M' ELSE '$' || context_length::VARCHAR || '/M' END AS price FROM models")(
    lambda d: d.withColumn("p", F.when(F.col("context_length") % 4 == 0, 0.0).when(F.col("context_length") % 4 == 1, 0.25).otherwise(F.col("context_length").cast("double")))
    .select("id", V.price_text(V.is_free(F.when(F.col("context_length").isNotNull(), "0.1"), F.lit("0")), F.col("p")).alias("price"))
)
query("endnote_positions", "ORDERS", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'docEnd' WHEN 1 THEN 'sectEnd' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'sectEnd' ELSE 'docEnd' END END AS position FROM orders")(
    lambda d: d.select("o_orderkey", V.endnote_position(F.element_at(F.array(F.lit("document-end"), F.lit("section-end"), F.lit("x"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_custkey") % 2 == 0).alias("position"))
)
query("demoted_headings", "chat_md", HEADS + " SELECT lines.doc_id, lines.line_no::BIGINT AS line_no, coalesce(h.text, line) AS line FROM lines LEFT JOIN (SELECT doc_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM headings) WHERE n % 2 = 0) h USING (doc_id, line_no)")(
    lambda d: H.demoted(d, H.collect_headings(d).withColumn("h_no", F.row_number().over(H.by_line()) - 1).filter("h_no % 2 = 0").select("doc_id", "h_no"))
)
query("promoted_lines", "chat_md", r"""--with f AS (SELECT doc_id, min(line_no) AS n FROM lines WHERE trim(regexp_replace(line, '^#{1,9}\s+', '')) = 'user' GROUP BY 1) SELECT lines.doc_id, line_no::BIGINT AS line_no, CASE WHEN line_no = n THEN '#### user' ELSE line END AS line FROM lines LEFT JOIN f USING (doc_id)""")(
    lambda d: H.promoted(d, d.select("doc_id").distinct().select("doc_id", F.lit("user").alias("title"), F.lit(4).alias("level")))
)
query("translation_prompts", "DOCUMENTS", r"SELECT doc_id, chunk_no, md5('Translate into Latin. Keep the Markdown, notes, page markers and references.' || chr(10) || CASE WHEN n > 1 THEN 'Part ' || (chunk_no + 1)::VARCHAR || ' of ' || n::VARCHAR || '.' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || text) AS prompt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS chunk_no, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)")(
    lambda d: C.translation_prompts(d.withColumn("id", F.col("doc_id")).withColumn("doc_id", F.struct("lang", "source")).withColumn("chunk_no", F.row_number().over(H.W.partitionBy("doc_id").orderBy("id")) - 1).select("doc_id", "chunk_no", "text", "id"), "Latin").select(F.col("id").alias("doc_id"), "chunk_no", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))
)
query("finished_checkpoints", ("ORDERS", "LINEITEM"), "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(lambda o, li: B.without_finished(o.select(F.col("o_orderkey").alias("doc_id")), li.select(F.col("l_orderkey").alias("doc_id")).distinct()))

from quire import block_queries, edit_queries, fold_queries, job_queries, service_queries  # noqa: E402,F401  register their queries here
