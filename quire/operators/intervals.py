"""Points in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.operators.headings import by_line

#: Bins of each level are so many times wider than those of the level below.
BASE = 16


def page_spans(lines: DataFrame) -> DataFrame:
    """(doc_id, page, start, end): the lines from the first marker of each printed page, in lower case, up to the next marker of any page."""
    label = F.lower(F.nullif(F.regexp_extract("line", T.PAGE, 1), F.lit("")))
    marks = lines.select("doc_id", "line_no", label.alias("page"), (F.max("line_no").over(W.partitionBy("doc_id")) + 1).alias("total")).filter("page is not null")
    spans = marks.select("doc_id", "page", F.col("line_no").alias("start"), F.coalesce(F.lead("line_no").over(by_line()), "total").alias("end"))
    return spans.groupBy("doc_id", "page").agg(F.min(F.struct("start", "end")).alias("span")).select("doc_id", "page", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def _level(length: Column) -> Column:
    """The first level whose bins are no narrower than a range."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pow(F.lit(float(BASE)), k) < length)).cast("int")


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(BASE)), level).cast("long")


def contained(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str = "start", end: str = "end") -> DataFrame:
    """Inner join of points with the ranges of the same keys that hold them: start <= point < end. Ranges may overlap and repeat.

    A range goes into the one or two bins it touches at the level of its length, a point into its bin at each level
    that occurs (of 16 at most), so both meet by an equi-join on (keys, level, bin) and no key's points meet all of
    its ranges. A hot key is as many bins as its points need. Empty and reversed ranges, nulls in points, bounds or
    keys hold nothing.
    """
    low, high = F.col(start).cast("long"), F.col(end).cast("long")
    kept = ranges.filter(low < high)
    levels = kept.select(_level(high - low).alias("n")).agg(F.collect_set("n")).scalar()
    wide = _width(F.col("_level"))
    binned = kept.withColumn("_level", _level(high - low)).withColumn("_bin", F.explode(F.sequence(F.floor(low / wide).cast("long"), F.floor((high - 1) / wide).cast("long"))))
    at = F.col(point).cast("long")
    spread = points.withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_bin", F.floor(at / wide).cast("long"))
    met = spread.join(binned, [*keys, "_level", "_bin"]).filter((at >= low) & (at < high))
    return met.drop("_level", "_bin")


def pages_of(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, page): the page of each line that lies in one of page_spans.

    These ranges share no line and begin at the lines themselves, so the last marker before a line tells its page, if it
    is that page's first: two windows within a document, and lines are shuffled once, as narrow rows.
    """
    page = F.lower(F.nullif(F.regexp_extract("line", T.PAGE, 1), F.lit("")))
    marks = lines.filter("doc_id is not null and line_no is not null").select("doc_id", "line_no", F.when(page.isNotNull(), F.struct(F.col("line_no").alias("at"), page.alias("page"))).alias("mark"))
    held = marks.select("doc_id", "line_no", F.last("mark", ignorenulls=True).over(by_line()).alias("mark")).filter("mark is not null").select("doc_id", "line_no", "mark.at", "mark.page")
    return held.withColumn("first", F.min("at").over(W.partitionBy("doc_id", "page"))).filter("at = first").select("doc_id", "line_no", "page")


def inside_pages(places: DataFrame, lines: DataFrame) -> DataFrame:
    """Places (doc_id, line_no, page) that lie on their page, or name one that the document doesn't mark: the guard of insertions.

    A document has one range for a page, so each place meets one at most and none is dealt to bins.
    """
    spans = page_spans(lines).select("doc_id", "page", F.struct("start", "end").alias("_span"))
    named = places.withColumn("page", F.lower("page")).join(spans, ["doc_id", "page"], "left")
    at = F.col("line_no").cast("long")
    return named.filter(F.col("_span").isNull() | ((at >= F.col("_span.start")) & (at < F.col("_span.end")))).select(*places.columns)
