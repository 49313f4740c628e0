"""What the edges of a scanned page say, as columns: lines to take out of its text, and printed page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# A number or a run of roman letters that stands alone.
NUMBER, LETTERS = r"(?m)(?:^|[\s\x{A0}])(\d{1,4})(?:[\s\x{A0}]|$)", r"(?im)(?:^|[\s\x{A0}])([ivxlcdm]{1,8})(?:[\s\x{A0}]|$)"


def edge_lines(edge: Column) -> Column:
    """The trimmed lines of a header or footer that say something; none for a null."""
    said = F.filter(F.transform(F.split(F.coalesce(edge, F.lit("")), "\n"), T.js_trim), lambda x: x != "")
    return said


def without_edges(body: Column, edges: Column) -> Column:
    """A page's text without the first line that begins with each of the edges' lines, and the blanks behind it."""

    def cut(text: Column, line: Column) -> Column:
        literal = F.concat(F.lit("\\Q"), F.replace(line, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        first = F.concat(F.lit(r"(?sm)\A(.*?)^"), literal, F.lit(r"[\s\x{A0}]*\n?"))
        return F.regexp_replace(text, first, F.lit("$1"))

    return F.aggregate(edges, body, cut)


def with_images(body: Column, images: Column) -> Column:
    """A text whose images point at their data: images is a map of data by the names that stand as sources."""
    link = lambda x: F.concat(F.lit("]("), x, F.lit(")"))
    return F.aggregate(F.coalesce(F.map_entries(images), F.array().cast("array<struct<key:string,value:string>>")), body, lambda t, e: F.replace(t, link(e["key"]), link(e["value"])))


def printed_numbers(header: Column, footer: Column) -> Column:
    """Each lone number and well-formed roman numeral (in lower case) of both edges once: the header's first, numbers before numerals."""
    numbers = lambda e: F.regexp_extract_all(F.coalesce(e, F.lit("")), F.lit(NUMBER), F.lit(1))
    numerals = lambda e: F.filter(F.transform(F.regexp_extract_all(F.coalesce(e, F.lit("")), F.lit(LETTERS), F.lit(1)), F.lower), lambda x: x.rlike(T.VALID_ROMAN))
    return F.array_distinct(F.concat(numbers(header), numerals(header), numbers(footer), numerals(footer)))


def spread_marker(numbers: Column) -> Column:
    """The page marker line of a page's printed numbers, of two or more the least and the greatest; empty without any.

    What the first one is, number or numeral, the others are read as; one that can't be counts as 0.
    """
    roman = F.get(numbers, F.lit(0)).rlike(T.ROMAN)
    value = lambda x: F.coalesce(F.when(roman, T.roman_value(x)).otherwise(x.try_cast("int")), F.lit(0))
    ordered = F.array_sort(F.transform(numbers, lambda x, k: F.struct(value(x).alias("v"), k.alias("k"), x.alias("x"))))
    label = lambda k: F.element_at(ordered, k)["x"]
    return F.when(F.size(numbers) == 0, "").otherwise(F.concat(F.lit("<!-- page: "), label(1), F.when(F.size(numbers) > 1, F.concat(F.lit("-"), label(-1))).otherwise(""), F.lit(" -->\n")))
