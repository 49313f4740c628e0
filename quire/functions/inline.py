"""The runs of a text with inline marks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note references, inline marks in this order, and entities.
NOTE = r"\[\^([A-Za-z0-9_]+)\]"
MARK = r"(?i)(?:\*\*\*(.+?)\*\*\*|\*\*(.+?)\*\*|\*(.+?)\*|<sup>(.+?)</sup>|<sub>(.+?)</sub>|<br\s*/?>)"
NAMED = (("&nbsp;", "\u00a0"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
CODE = r"&#(\d+);"
#: What every mark and entity begins with: a text without any is one run as it stands.
SIGNS = r"[*&]|(?i)<(?:su[pb]>|br)"

RUN = "struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,brk:boolean,note:string>"


def _run(text=None, note=None, *styles: str) -> Column:
    on = lambda s: F.lit(s in styles).alias(s)
    return F.struct((F.lit("") if text is None else text).alias("text"), on("bold"), on("italic"), on("sup"), on("sub"), on("brk"), (F.lit(None) if note is None else note).cast("string").alias("note")).cast(RUN)


def _between(text: Column, pattern: str, plain, match) -> Column:
    """Runs of a text in order: plain(what lies between matches) and match(match), both arrays of runs."""
    parts, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.transform(parts, lambda x, k: F.concat(plain(x), F.when(k < F.size(hits), match(F.get(hits, k))).otherwise(F.array().cast(f"array<{RUN}>"))))
    return F.flatten(both)


def decoded(text: Column) -> Column:
    """Entities as characters: the named ones in order, then decimal codes as UTF-16 units; half a pair is a stand-in."""
    for name, char in NAMED:
        text = F.replace(text, F.lit(name), F.lit(char))
    parts, hits = F.split(text, CODE), F.regexp_extract_all(text, F.lit(CODE), F.lit(1))
    unit = lambda c: F.right(c, F.lit(16)).cast("long") % 65_536  # noqa: E731  the last 16 digits decide it
    char = lambda u: F.when(u.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(u), 4, "0")), "UTF-16BE"))
    whole = F.array_join(F.transform(parts, lambda x, k: F.concat(x, F.when(k < F.size(hits), char(unit(F.get(hits, k)))).otherwise(""))), "")
    return F.when(F.size(hits) > 0, whole).otherwise(text)


def _styled(token: Column) -> Column:
    said = lambda g: F.regexp_extract(token, MARK, g)
    styles = (("bold", "italic"), ("bold",), ("italic",), ("sup",), ("sub",))
    return F.coalesce(*[F.when(said(g) != "", _run(said(g), None, *s)) for g, s in enumerate(styles, 1)], _run(None, None, "brk"))


def runs_of(text: Column) -> Column:
    """array<struct<text, bold, italic, sup, sub, brk, note>> of a line: note references first, marks in what lies between.

    A text without any run is one empty run; a null text has none.
    """
    none = F.array().cast(f"array<{RUN}>")
    as_plain = lambda x: F.when(x != "", F.array(_run(x))).otherwise(none)
    marked = lambda x: F.when(x.rlike(SIGNS), _between(decoded(x), MARK, as_plain, lambda m: F.array(_styled(m)))).otherwise(as_plain(x))
    runs = _between(text, NOTE, marked, lambda m: F.array(_run(None, F.regexp_extract(m, NOTE, 1))))
    some = F.transform(F.array(runs), lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(_run())))[0]  # named once, as it would be worked out at each mention
    return F.when(~text.rlike(rf"\[\^|{SIGNS}"), F.array(_run(text))).when(text.isNotNull(), some)
