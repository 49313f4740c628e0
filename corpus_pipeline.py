"""A training corpus in five stages: language ID, toxicity, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet to the shared
folder and reads it again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, simhash, substring, toxicity
from quire.llm.common import Spool, bucket_of, mark, release, table

#: A document is rejected if no language holds this share of its letters on the Viterbi path.
LANGUAGE_SHARE = 0.4


def _kept(docs: DataFrame, judge, condition) -> DataFrame:
    """The rows whose verdict on their text meets the condition; judged in place, so no row is matched by its id and no column's name can clash."""
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judge(F.col("text")).alias("verdict"))
    return judged.filter(condition(F.col("verdict"))).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those in which no language prevails.

    Each row is judged by its text alone: repeated rows, ids and null ids make no difference. Rows with a null lang
    are judged, not learned from. Without a single labelled text nothing is known and no row is kept.
    """
    model = langid.fit(docs.filter(bucket_of(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    return _kept(docs, langid.labeller(spark, model), lambda v: (v["lang_pred"] != "und") & (v["score"] >= LANGUAGE_SHARE))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic.

    Each row is judged by its text alone; null and empty texts are judged as texts without a toxic word. Without
    labels of both kinds all rows get the label's rate.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(bucket_of(F.col("doc_id"), 5) != 0))
    return _kept(docs, toxicity.scorer(spark, model), lambda v: v["score"] < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, once.

    Of rows with that id and different texts the one with the smaller text hash stands for the group, if their texts
    fall in one group; else each stands in its own. Rows without a doc_id come after all others, by text hash. Of rows
    that agree in id and text one stays (the least by all columns). Null and empty texts are one group.
    """
    found = simhash.near_duplicates(docs).groupBy("group", "id", "sign").agg(F.count("*").alias("copies"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("lone"), "id", "sign", "copies")).alias("k"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_sign"))
    rows = rows.join(first.select("k"), F.col("row_id").eqNullSafe(F.col("k.id")) & (F.col("row_sign") == F.col("k.sign")))
    many = rows.filter("k.copies > 1").groupBy("row_id", "row_sign").agg(F.min("row").alias("row"))
    return rows.filter("k.copies = 1").select("row").unionByName(many.select("row")).select("row.*")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; n_chars follows, and documents left without words go, as do null texts.

    Rows of one id are cut each by its own text; rows that agree in id and text are one document and cut alike.
    """
    cut = substring.without_repeats(docs)
    cut = cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut
    return cut.filter(F.col("text").rlike(r"\S")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as the packing operator returns them: every row is packed, null and empty texts as their separator."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spool = Spool(spark, "pipeline")
    for _, stage in STAGES:
        since = mark()
        after = spool.put(stage(spark, docs, sf_dir))
        release(since)  # what the stage kept for itself
        spool.drop(docs)
        docs = after
    return docs


#: Learned models and a tokenizer aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None

