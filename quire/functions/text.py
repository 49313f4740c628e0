"""Column expressions for Markdown lines. Patterns follow JavaScript's meaning where Java's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line formats of the document model.
ATX = r"^(#{1,9})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$"
META = r"(?i)^\s*<!--\s*heading-level:\s*([7-9])\s*-->\s*$"
FENCE = r"^\s*(```|~~~)"
BACKTICK_FENCE = r"^\s*```"
PAGE = r"(?i)^\s*<!--\s*page:\s*(\S+)\s*-->"
NOTE_DEF = r"^\s*\[\^(\d+)\]:"
NOTE_REF = r"\[\^(\d+)\]"
# Definitions that stand in for a note's missing text.
PLACEHOLDER = r"(?i)^\[\^\w+\]:\s*\[\s*(?:end|foot)?note\s*\d*\s*\]\s*$"
MISSING = r"(?i)^\[\^\w+\]:\s*\[[^\]]*\b(?:omitted|missing|unavailable|not\s+(?:available|visible|shown|present|provided|included))\b[^\]]*\]\s*$"
MAX_LEVEL, NATIVE_LEVELS = 9, 6
# Unicode white space and the byte order mark.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ROMAN = r"(?i)^[ivxlcdm]+$"
VALID_ROMAN = r"(?i)^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\z"


def js_trim(c) -> Column:
    """Strips what JavaScript's trim() does: all white space, NBSP and the byte order mark too. Only the ends are looked at."""
    return F.btrim(c, F.lit(SPACE))


def is_fence(line, tildes: bool = True) -> Column:
    return F.col(line).rlike(FENCE if tildes else BACKTICK_FENCE)


def serialize(level, text) -> Column:
    """A logical heading as Markdown: hashes up to level 6, a level comment and an H6 below that."""
    n = F.greatest(F.lit(1), F.least(F.lit(MAX_LEVEL), level))
    deep = F.concat(F.lit("<!-- heading-level: "), n.cast("string"), F.lit(" -->\n###### "), text)
    return F.when(n <= NATIVE_LEVELS, F.concat(F.repeat(F.lit("#"), n), F.lit(" "), text)).otherwise(deep)


def normalized_title(c, dashes: bool = True) -> Column:
    """A title for matching: no bold marks, page in parentheses (or after a dash), or leading number or letter.

    The converter matches without the rule for dashes, the editor with it.
    """
    # What is cut off a title, in this order.
    c = F.replace(js_trim(c), F.lit("**"), F.lit(""))
    c = F.regexp_replace(c, r"(?i)\s*\([ivxlcdm\d\s,\x{2013}-]+\)\s*\z", "")
    if dashes:
        c = F.regexp_replace(c, r"(?i)\s*[\x{2014}\x{2013}-]\s*(?:p\.?\s*)?[ivxlcdm\d]+\s*\z", "")
    c = F.regexp_replace(c, r"^\d+(\.\d+)*\.?\s+", "")
    c = F.regexp_replace(c, r"^[A-Z]\.?\s+", "")
    return js_trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


# Printed page at the end of an outline entry, tried in this order.
TRAILING_PAGE = (
    r"(?i)\s*\(\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*\)\s*$",
    r"(?i)\s+[\x{2014}\x{2013}-]\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*$",
    r"(?i),\s*(?:p\.?\s*)?([ivxlcdm]+|\d+)\s*$",
    r"(?i)\.{3,}\s*([ivxlcdm]+|\d+)\s*$",
    r"(?i)\s{2,}([ivxlcdm]+|\d+)\s*$",
)


def trailing_page(c) -> Column:
    """The printed page at the end of an entry, or null."""
    return F.coalesce(*[F.nullif(F.lower(F.regexp_extract(c, p, 1)), F.lit("")) for p in TRAILING_PAGE])


def without_trailing_page(c) -> Column:
    out = c
    for p in reversed(TRAILING_PAGE):
        out = F.when(F.regexp_extract(c, p, 1) != "", F.regexp_replace(c, p, "")).otherwise(out)
    return js_trim(out)


def word_count(c) -> Column:
    """Parts between runs of white space: 1 for the empty string, and one more for a leading space."""
    return F.size(F.split(c, r"\s+"))


def roman_value(c) -> Column:
    """A well-formed roman numeral as an integer by subtractive sums; null if it is none."""
    value = F.create_map(*[F.lit(x) for kv in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in kv])
    digits = F.transform(F.split(F.lower(c), ""), lambda x: value[x])
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, x: F.struct((s["sum"] + x - F.when(s["last"] < x, 2 * s["last"]).otherwise(0)).alias("sum"), x.alias("last")), lambda s: s["sum"])
    return F.when(c.rlike(VALID_ROMAN), total)


def printed_page(footer, header) -> Column:
    """A printed label, from the footer before the header: a lone number of 1 to 4 digits, else a lone roman numeral.

    Of each text the first lone number counts, and without one the first lone run of roman letters, if well-formed.
    """

    def label(c) -> Column:
        t = js_trim(c)
        # What stands alone in an edge.
        number = F.regexp_extract(t, r"(?:^|[\s\x{A0}])(\d{1,4})(?:[\s\x{A0}]|\z)", 1)
        letters = F.regexp_extract(t, r"(?i)(?:^|[\s\x{A0}])([ivxlcdm]{1,8})(?:[\s\x{A0}]|\z)", 1)
        return F.when(number != "", number).when(letters.rlike(VALID_ROMAN), F.lower(letters))

    return F.coalesce(label(footer), label(header))


def strip_code_fence(c) -> Column:
    """Removes a fence that wraps a whole answer, and one that is open at either end."""
    return js_trim(F.regexp_replace(F.regexp_replace(js_trim(c), r"^```(?:markdown|md)?", ""), r"```\z", ""))


def collapse_blanks(c) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def single_marker(c) -> Column:
    """A doubled heading marker keeps its outer level; of a whole text, a lone marker line takes in the heading below it."""
    return F.regexp_replace(c, r"(?m)^(#{1,9})\s+#{1,9}\s+(.+)$", "$1 $2")


def title_of_file(c) -> Column:
    c = F.replace(F.replace(F.regexp_replace(c, r"(?i)\.pdf\z", ""), F.lit("_"), F.lit(" ")), F.lit(" - "), F.lit(" — "))
    return js_trim(F.regexp_replace(c, r"\s+", " "))


def csv_quote(c) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
