"""Synthetic Markdown corpora over the fixture tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.lookup import at_home

LEVEL = "CAST(p_size % 9 + 1 AS INT)"

#: One document for each customer, a chapter for each order: adjacent headings, deep ones, pages, bold and fenced lines.
EDIT_MD = """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS INT) AS line_no, line FROM (
            SELECT o_custkey AS doc_id, o_orderkey AS o, 0 AS k, '<!-- heading-level: ' || CAST(7 + o_orderkey % 3 AS STRING) || ' -->' AS line FROM orders WHERE o_orderkey % 5 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 1, CASE WHEN o_orderkey % 5 = 0 THEN '######' ELSE repeat('#', CAST(o_orderkey % 3 + 1 AS INT)) END || ' Order ' || CAST(o_orderkey AS STRING) FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 2, '' FROM orders WHERE o_orderkey % 3 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 3, '### Part ' || CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 2 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 4, '######## Piece ' || CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 4 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 5, '<!-- page: ' || CAST(o_orderkey AS STRING) || ' -->' FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 6, CASE o_orderkey % 3 WHEN 0 THEN '**Bold ' || CAST(o_orderkey AS STRING) || '**' WHEN 1 THEN 'Plain ' || CAST(o_orderkey AS STRING) ELSE '> quoted' END FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, k, CASE k WHEN 8 THEN '## Fenced ' || CAST(o_orderkey AS STRING) ELSE '```' END FROM orders CROSS JOIN (SELECT 7 AS k UNION ALL SELECT 8 UNION ALL SELECT 9) f WHERE o_orderkey % 10 = 7
            UNION ALL SELECT o_custkey, o_orderkey, 10, 'Text of ' || CAST(o_orderkey AS STRING) FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 11, '' FROM orders WHERE o_orderkey % 4 <> 1
        ) x"""
#: Commands for EDIT_MD, as numbered after its headings are canonical; those of one line meet, and so do merges side by side.
_AT = "CAST(line_no + 1 AS STRING)"
_KINDS = (
    (f"'RELEVEL|' || {_AT} || '|' || CAST(line_no % 9 + 1 AS STRING)", "line LIKE '#%' AND (line_no * 7 + doc_id) % 6 IN (0, 3)"),
    (f"'DEMOTE|' || {_AT}", "line LIKE '#%' AND (line_no * 7 + doc_id) % 6 = 1"),
    (f"'PROMOTE|' || {_AT} || '|3'", "line LIKE '#%' AND (line_no * 7 + doc_id) % 6 IN (1, 2)"),
    (f"'MERGE|' || {_AT}", "line LIKE '#%' AND ((line_no * 7 + doc_id) % 6 = 4 OR doc_id % 2 = 0)"),
    (f"'RETITLE|' || {_AT} || '|Renamed ' || CAST(line_no % 6 AS STRING)", "line LIKE '#%' AND (line_no * 7 + doc_id) % 6 = 5"),
    (f"'PROMOTE|' || {_AT} || '|' || CAST(line_no % 9 + 1 AS STRING)", "line LIKE '**%' OR line LIKE 'Plain%' OR line LIKE '>%'"),
    (f"'INSERT|' || {_AT} || '|' || CAST(line_no % 9 + 1 AS STRING) || '|' || CASE doc_id % 3 WHEN 0 THEN 'Absent' WHEN 1 THEN 'Elsewhere' ELSE 'Order' END || replace(replace(line, '<!-- page:', ''), ' -->', '')", "line LIKE '<!-- page:%'"),
    (f"'INSERT|' || {_AT} || '|2|absent' || replace(replace(line, '<!-- page:', ''), ' -->', '')", "line LIKE '<!-- page:%' AND line_no % 4 = 0"),
    (f"'DEMOTE|' || CAST(line_no + 500 AS STRING)", "line LIKE '<!-- page:%' AND line_no % 9 = 0"),
)
_EDITS = " UNION ALL ".join(f"SELECT doc_id, line_no, {k} AS k, {command} AS line FROM ({{md}}) e WHERE {where}" for k, (command, where) in enumerate(_KINDS))

#: name -> SQL of (doc_id, line_no, line), or of another table with that name.
CORPORA = {
    # One document for each 50 parts: raw hashes, level comments over native and raw headings, closing hashes, fences.
    "deep_md": f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS INT) AS line_no, line FROM (
            SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_partkey AS p, 0 AS k, CASE WHEN p_partkey % 20 = 0 THEN '~~~' ELSE '```' END AS line FROM part WHERE p_partkey % 10 = 0
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 1, '<!-- heading-level: ' || CAST(7 + p_size % 3 AS STRING) || ' -->' FROM part WHERE p_partkey % 4 IN (1, 2)
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 2, CASE p_partkey % 4 WHEN 0 THEN repeat('#', {LEVEL}) || ' ' || p_name WHEN 1 THEN '###### ' || p_name WHEN 2 THEN repeat('#', {LEVEL}) || ' ' || p_name ELSE repeat('#', {LEVEL}) || ' ' || p_name || ' ##' END FROM part
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 3, p_brand || ' ' || p_type || ' | ## ## ' || p_name FROM part
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 4, CASE WHEN p_partkey % 3 = 0 THEN '## ## ' || p_brand ELSE '' END FROM part
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 5, '' FROM part WHERE p_partkey % 7 = 0
            UNION ALL SELECT CAST(floor(p_partkey / 50) AS BIGINT), p_partkey, 6, '```' FROM part WHERE p_partkey % 10 = 0
        ) x""",
    # One document for each customer: an order is a chapter with a page marker, items with note references, and notes.
    "book_md": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k, n, pk, sk, q, e, d, t) - 1 AS INT) AS line_no, line FROM (
            SELECT o_custkey AS doc_id, o_orderkey AS o, 0 AS k, 0 AS n, 0 AS pk, 0 AS sk, 0 AS q, 0 AS e, 0 AS d, 0 AS t, '## Order ' || CAST(o_orderkey AS STRING) AS line FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 1, 0, 0, 0, 0, 0, 0, 0, '<!-- page: ' || CAST(o_orderkey AS STRING) || ' -->' FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 2, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, 'Item ' || CAST(l_partkey AS STRING) || CASE WHEN l_returnflag <> 'R' THEN ' see[^' || CAST(l_linenumber AS STRING) || '] there' ELSE ' | none' END FROM orders JOIN lineitem ON o_orderkey = l_orderkey
            UNION ALL SELECT o_custkey, o_orderkey, 3, 0, 0, 0, 0, 0, 0, 0, '### Notes' FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 4, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, '[^' || CAST(l_linenumber AS STRING) || ']: ' || CASE WHEN l_partkey % 11 = 0 THEN '[Endnote ' || CAST(l_linenumber AS STRING) || ']' ELSE 'part ' || CAST(l_partkey AS STRING) END FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'
            UNION ALL SELECT o_custkey, o_orderkey, 5, 0, 0, 0, 0, 0, 0, 0, '| a' || CAST(o_orderkey AS STRING) || ' | b |' FROM orders WHERE o_orderkey % 5 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 6, 0, 0, 0, 0, 0, 0, 0, '' FROM orders
        ) x""",
    # One document for each conversation: a heading for it and one for each turn.
    "chat_md": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS INT) AS line_no, line FROM (
            SELECT conv_id AS doc_id, CAST(-1 AS BIGINT) AS turn, 0 AS k, '# Conversation ' || CAST(conv_id AS STRING) AS line FROM (SELECT DISTINCT conv_id FROM conversations) c
            UNION ALL SELECT conv_id, turn, 1, '## ' || role FROM conversations
            UNION ALL SELECT conv_id, turn, 2, replace(text, chr(10), ' ') FROM conversations
        ) x""",
    # Contents with page numbers before the body; half of the documents lack the page marker between them.
    "toc_md": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, c) - 1 AS INT) AS line_no, line FROM (
            SELECT n_nationkey AS doc_id, 0 AS k, CAST(0 AS BIGINT) AS c, '# Contents' AS line FROM nation
            UNION ALL SELECT c_nationkey, 1, c_custkey, '## ' || c_name || ' ..... ' || CAST(c_custkey AS STRING) FROM customer
            UNION ALL SELECT n_nationkey, 2, 0, '<!-- page: 1 -->' FROM nation WHERE n_nationkey % 2 = 0
            UNION ALL SELECT c_nationkey, 3, c_custkey * 2, '## ' || c_name FROM customer
            UNION ALL SELECT c_nationkey, 3, c_custkey * 2 + 1, 'About ' || c_mktsegment FROM customer
        ) x""",
    # The outline of book_md's chapters, perturbed: numbers, bold marks, pages, dot leaders, bullets.
    "outline_md": """
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_no,
            CASE o_orderkey % 6 WHEN 0 THEN '# Order ' || CAST(o_orderkey AS STRING) WHEN 1 THEN '## 1.2 Order ' || CAST(o_orderkey AS STRING) || ' (87)' WHEN 2 THEN '### **Order ' || CAST(o_orderkey AS STRING) || '**'
                WHEN 3 THEN '  - Order ' || CAST(o_orderkey AS STRING) || ' ..... 87' WHEN 4 THEN '* order ' || CAST(o_orderkey AS STRING) || ', p. xii' ELSE '## Lost ' || CAST(o_orderkey AS STRING) END AS line FROM orders""",
    "commands": """
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_no,
            CASE o_orderkey % 9 WHEN 0 THEN '- RELEVEL | ' || CAST(o_orderkey % 13 AS STRING) || ' | 3' WHEN 1 THEN 'demote|' || CAST(o_orderkey % 13 AS STRING) WHEN 2 THEN 'MERGE_UP | 7x' WHEN 3 THEN 'PROMOTE | 4 | 12'
                WHEN 4 THEN 'RETITLE | 1 | A | B' WHEN 5 THEN 'INSERT | 3 | 2 | New ' || CAST(o_orderkey AS STRING) WHEN 6 THEN 'none' WHEN 7 THEN 'RELEVEL | x | 2' ELSE '* MERGE | 5' END AS line FROM orders""",
    "edit_md": EDIT_MD,
    "edit_commands": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS INT) AS line_no, line FROM (" + _EDITS.replace("{md}", EDIT_MD) + ") c",
    "edit_outline": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS INT) AS line_no, line FROM (
            SELECT o_custkey AS doc_id, o_orderkey AS o, 0 AS k, '# 1.2 Order ' || CAST(o_orderkey AS STRING) AS line FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 1, '- Absent ' || CAST(o_orderkey AS STRING) || ' (' || CAST(o_orderkey AS STRING) || ')' FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 2, '## **Bold ' || CAST(o_orderkey AS STRING) || '** ..... 7' FROM orders WHERE o_orderkey % 2 = 0
            UNION ALL SELECT o_custkey, o_orderkey, 3, '  * Elsewhere ' || CAST(o_orderkey AS STRING) || ', p. ' || CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS STRING) FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 4, '### Renamed ' || CAST(o_orderkey % 5 AS STRING) FROM orders
        ) x WHERE doc_id % 7 <> 3""",
    # Every kind of block: tables of several rows, quotes, code, rules, pages, outlines, deep headings, images, marked text.
    "block_md": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS INT) AS line_no, line FROM (
            SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS doc_id, p_partkey AS p, k, CASE p_partkey % 12
                WHEN 0 THEN CASE k WHEN 0 THEN '| name |  brand|' WHEN 1 THEN '| :-- | --- |' WHEN 2 THEN '| **' || p_name || '** | "' || p_brand || '" |' ELSE '  ||' || p_type || '||' END
                WHEN 1 THEN CASE k WHEN 0 THEN '> ' || p_name WHEN 1 THEN '>  two' WHEN 2 THEN '>three' ELSE '> ' || p_type END
                WHEN 2 THEN CASE k WHEN 0 THEN '```sql' WHEN 1 THEN '  ' || p_name WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN '<!-- ENDNOTE-SECTION-BREAK -->' ELSE '' END ELSE '```' END
                WHEN 3 THEN CASE k WHEN 0 THEN '---' WHEN 1 THEN '```' WHEN 2 THEN '```' ELSE ' ' || p_name || '  ' END
                WHEN 4 THEN CASE k WHEN 0 THEN '<!-- page: ' || CAST(p_partkey AS STRING) || ' -->' WHEN 1 THEN p_name ELSE p_type END
                WHEN 5 THEN CASE k WHEN 0 THEN '<!-- Document Outline -->' WHEN 1 THEN '## ' || p_name WHEN 2 THEN p_type ELSE CASE WHEN p_size % 2 = 0 THEN '---' ELSE '> in it' END END
                WHEN 6 THEN CASE k WHEN 0 THEN '<!-- heading-level: ' || CAST(7 + p_size % 3 AS STRING) || ' -->' WHEN 1 THEN CASE WHEN p_size % 4 = 0 THEN 'no heading' ELSE '###### ' || p_name END ELSE '#' || p_type END
                WHEN 7 THEN CASE k WHEN 0 THEN p_name WHEN 1 THEN '![' || p_brand || '](data:image/png;base64,QUJD)' WHEN 2 THEN '![x](data:image/png;bad)' ELSE '![y](file.png)' END
                WHEN 8 THEN CASE k WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE '' END
                WHEN 9 THEN CASE k WHEN 0 THEN p_name WHEN 1 THEN '<!-- other -->' WHEN 2 THEN '| no table' ELSE p_type END
                WHEN 10 THEN CASE k WHEN 0 THEN '|---|:-:|' WHEN 1 THEN '' WHEN 2 THEN '| one | row ' || CAST(p_partkey AS STRING) || ' |' ELSE '' END
                ELSE CASE k WHEN 0 THEN '**' || p_name || '** and *' || p_brand || '*<BR/> x<sup>1</sup>[^' || CAST(p_size AS STRING) || ']' WHEN 1 THEN '***both*** H<sub>2</sub>O &amp; **a [^n_1] b** &lt;' WHEN 2 THEN '[^' || CAST(p_size AS STRING) || ']: ' || p_name ELSE '* ' || p_type || ' ** *' END END AS line
            FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f
        ) x""",
    # Headings that come again under the same and other parents, near and beyond the lines that count as near.
    "repeat_md": """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, k, n) - 1 AS INT) AS line_no, line FROM (
            SELECT o_custkey AS doc_id, o_orderkey AS o, 0 AS k, 0 AS n, '<!-- heading-level: 7 -->' AS line FROM orders WHERE o_orderkey % 4 = 3
            UNION ALL SELECT o_custkey, o_orderkey, 1, 0, CASE o_orderkey % 4 WHEN 0 THEN '# Chapter ' || CAST(o_orderkey % 8 AS STRING) WHEN 1 THEN '## Notes ' WHEN 2 THEN '### Sources' ELSE '###### Deep' END FROM orders
            UNION ALL SELECT o_custkey, o_orderkey, 2, n, 'text' FROM orders CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) f WHERE n < o_orderkey % 11
            UNION ALL SELECT o_custkey, o_orderkey, 3, 0, '## Notes' FROM orders WHERE o_orderkey % 3 = 0
        ) x""",
    "joblog": """
        SELECT CAST(event_id AS STRING) AS id, ts, CAST(user_id AS STRING) AS job_id, 'book-' || CAST(user_id % 40 AS STRING) || '.pdf' AS file_name,
            CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level, event_type || ' ' || CAST(event_id % 100 AS STRING) AS message FROM events""",
    "history": """
        SELECT CAST(o_orderkey AS STRING) AS id, 'file ' || CAST(o_custkey AS STRING) || '.pdf' AS file_name, '/in/"' || CAST(o_custkey AS STRING) || '".pdf' AS source_path, CAST(o_orderkey % 90 AS BIGINT) AS total_pages,
            o_orderdate AS converted_at, CAST(o_orderkey * 1237 AS BIGINT) AS duration_ms, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS language FROM orders""",
    "models": """
        SELECT 'm' || CAST(p_partkey AS STRING) AS id, p_name AS display_name, p_size % 5 = 0 AS is_free, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey END AS context_length, p_brand AS stage_model,
            CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS provider_model FROM part""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _book(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """book_md as its SQL has it, from one join: orders and items go to their document as they are and become lines there."""
    keys = ["n", "pk", "sk", "q", "e", "d", "t"]
    order = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"))
    item = lineitem.select("l_orderkey", *[F.col(f"l_{c}").alias(k) for c, k in zip(("linenumber", "partkey", "suppkey", "quantity", "extendedprice", "discount", "tax"), keys)], (F.col("l_returnflag") != "R").alias("seen"), (F.col("l_linestatus") == "F").alias("noted"))
    items = order.join(item, F.col("o") == F.col("l_orderkey")).drop("l_orderkey").withColumn("item", F.lit(True))
    chapters = order.select("*", *[F.lit(0).cast(items.schema[k].dataType).alias(k) for k in keys], F.lit(False).alias("item"))
    rows = at_home(chapters.unionByName(items, allowMissingColumns=True))
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    line = lambda k, *x: F.struct(F.lit(k).alias("k"), say(*x).alias("line"))
    o, n, part = F.col("o"), F.col("n"), F.col("pk")
    stands = F.struct(F.lit(2).alias("k"), F.when(F.col("seen"), say("Item ", part, " see[^", n, "] there")).otherwise(say("Item ", part, " | none")).alias("line"))
    note = F.struct(F.lit(4).alias("k"), F.when(part % 11 == 0, say("[^", n, "]: [Endnote ", n, "]")).otherwise(say("[^", n, "]: part ", part)).alias("line"))
    chapter = [line(0, "## Order ", o), line(1, "<!-- page: ", o, " -->"), line(3, "### Notes")]
    made = F.when(F.col("item"), F.when(F.col("noted"), F.array(stands, note)).otherwise(F.array(stands))).otherwise(F.when(o % 5 == 0, F.array(*chapter, line(5, "| a", o, " | b |"), line(6, ""))).otherwise(F.array(*chapter, line(6, ""))))
    lines = rows.select("doc_id", "o", *keys, F.inline(made))
    return lines.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("o", "k", *keys)) - 1).alias("line_no"), "line")


def _repeat(orders: DataFrame) -> DataFrame:
    """repeat_md as its SQL has it: orders are sorted and become lines in order. Lines hold few bytes, by which too few tasks would be chosen; they stay as many as the session has partitions."""
    rows = at_home(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"))).groupBy("doc_id", "o").agg(F.count("*").cast("int").alias("times"))
    o = F.col("o")
    some = lambda cond, line: F.when(cond, F.array(F.lit(line))).otherwise(F.array().cast("array<string>"))
    head = F.when(o % 4 == 0, F.concat(F.lit("# Chapter "), (o % 8).cast("string"))).when(o % 4 == 1, "## Notes ").when(o % 4 == 2, "### Sources").otherwise("###### Deep")
    text = F.array_repeat(F.lit("text"), F.coalesce(F.greatest(o % 11, F.lit(0)), F.lit(0)).cast("int"))
    made = F.concat(some(o % 4 == 3, "<!-- heading-level: 7 -->"), F.array(head), text, some(o % 3 == 0, "## Notes"))
    alike = F.flatten(F.transform(made, lambda x: F.array_repeat(x, F.col("times"))))  # orders of one number are equal, and so are their lines
    before = F.sum(F.size("lines")).over(W.partitionBy("doc_id").orderBy("o").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("doc_id", "o", F.when(F.col("times") == 1, made).otherwise(alike).alias("lines"))
    rows = rows.select("doc_id", "lines", F.coalesce(before, F.lit(0)).cast("int").alias("before"))
    return rows.select("doc_id", "before", F.posexplode("lines").alias("at", "line")).select("doc_id", (F.col("before") + F.col("at")).alias("line_no"), "line")


def _edit(orders: DataFrame) -> DataFrame:
    """edit_md as its SQL has it, from one reading of the orders: they go to their document as they are and become lines there."""
    rows = at_home(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o")))
    o = F.col("o")
    of = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], o.cast("string"))
    marked = F.when(o % 3 == 0, F.concat(of("**Bold "), F.lit("**"))).when(o % 3 == 1, of("Plain ")).otherwise("> quoted")
    lines = [
        (o % 5 == 0, F.concat(F.lit("<!-- heading-level: "), (7 + o % 3).cast("string"), F.lit(" -->"))), (None, of(F.when(o % 5 == 0, "######").otherwise(F.repeat(F.lit("#"), (o % 3 + 1).cast("int"))), " Order ")), (o % 3 == 0, F.lit("")),
        (o % 2 == 0, of("### Part ")), (o % 4 == 0, of("######## Piece ")), (None, F.concat(of("<!-- page: "), F.lit(" -->"))), (None, marked), (o % 10 == 7, F.lit("```")), (o % 10 == 7, of("## Fenced ")), (o % 10 == 7, F.lit("```")), (None, of("Text of ")), (o % 4 != 1, F.lit("")),
    ]
    made = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(True) if when is None else F.coalesce(when, F.lit(False))).alias("has"), line.alias("line")) for k, (when, line) in enumerate(lines)])
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("o", "k")) - 1
    return rows.select("doc_id", "o", F.inline(made)).filter("has").select("doc_id", no.alias("line_no"), "line")


def _edit_commands(orders: DataFrame) -> DataFrame:
    """edit_commands as its SQL has it, from one reading of the lines."""
    lines = _edit(orders).filter(" OR ".join(f"({where})" for _, where in _KINDS))
    asked = [F.struct(F.lit(k).alias("k"), F.expr(where).alias("has"), F.expr(command).alias("line")) for k, (command, where) in enumerate(_KINDS)]
    found = lines.select("doc_id", "line_no", F.inline(F.array(*asked))).filter("has")
    return found.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "k")) - 1).alias("line_no"), "line")


#: name -> the corpus over its tables, by name, where Spark does with less than the SQL asks for; the rows are the same.
BUILT = {"book_md": _book, "repeat_md": _repeat, "edit_md": _edit, "edit_commands": _edit_commands}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named corpus over the tables of a folder; each table is read through an argument of the SQL."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", CORPORA[name])]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if name in BUILT:
        return BUILT[name](**tables)
    sql = CORPORA[name]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return spark.sql(sql.replace("{" + "}", ""), **tables)
