"""Readers and writers around documents: binary files, Markdown, JSON state, per-format export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN = "*.{md,markdown,mdown,mkdn,txt}"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole Markdown files."""
    rows = spark.read.option("pathGlobFilter", MARKDOWN).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON state files; what can't be parsed gives nulls and not an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def page_ranges(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, batch_no, start, end): page ranges of ``size`` pages, from 0, end exclusive; needs doc_id, pages."""
    starts = F.explode(F.when(F.col("pages") > 0, F.sequence(F.lit(0), F.col("pages") - 1, F.lit(size))))
    out = docs.select("doc_id", "pages", starts.alias("start"))
    return out.select("doc_id", (F.col("start") / size).cast("int").alias("batch_no"), "start", F.least(F.col("start") + size, F.col("pages")).alias("end"))


def existing(paths: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds exists to (path): whether the file is in a folder's listing; the listing is read as a table, without contents."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.lit(True).alias("there"))
    return paths.join(listing, "path", "left").withColumn("exists", F.coalesce("there", F.lit(False))).drop("there")


def overwrite(df: DataFrame, path: str) -> None:
    """Writes lines in place of a Markdown file's part files; readers see the old or the new ones."""
    df.select("text").write.mode("overwrite").option("lineSep", "\n").text(path)


def translated_path(path: str, language: str):
    """The path with the language before its extension."""
    return F.when(F.coalesce(F.col(language), F.lit("")) == "", F.col(path)).otherwise(F.regexp_replace(F.col(path), F.lit(r"^(.*?)(\.[^./]*)?\z"), F.concat(F.lit("$1."), F.col(language), F.lit("$2"))))


def save_formats(df: DataFrame, path: str, formats: dict) -> list[tuple[str, str | None]]:
    """Writes df in each format by its function of (df, path); one that fails doesn't stop the others."""
    out = []
    for name, write in formats.items():
        try:
            write(df, f"{path}/{name}")
            out.append((name, None))
        except Exception as e:  # noqa: BLE001  each format's error is its own row
            out.append((name, str(e)))
    return out
