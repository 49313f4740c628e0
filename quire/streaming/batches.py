"""Incremental work: new batches are taken once, results are upserted by (doc_id, batch_no), a restart resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def run_available(spark: SparkSession, source: str, schema: str, work, sink: str, checkpoint: str, files: int | None = None, mode: str = "append") -> None:
    """Applies ``work`` to what is new in a Parquet folder since the checkpoint, and puts its rows into another.

    work: of a stream, stateful or not; ``mode``: "update" where it aggregates, so that each micro-batch has the groups that
    changed. Each micro-batch is one commit; ``files``: at most so many files a micro-batch.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)
    work(stream).writeStream.outputMode(mode).foreachBatch(lambda df, epoch: commit(df, epoch, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def commit(df: DataFrame, epoch: int, sink: str) -> None:
    """The rows of a micro-batch, in its own folder of the sink: one that is run again takes the place of its first run."""
    df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch}")


def upserted(spark: SparkSession, sink: str, *keys: str) -> DataFrame:
    """The sink as a table: one row a key, of the last micro-batch that had it."""
    return latest(spark.read.option("mergeSchema", "true").parquet(sink), *keys).drop("epoch")


def latest(results: DataFrame, *keys: str) -> DataFrame:
    """One row a key: of the last epoch."""
    w = W.partitionBy(*keys).orderBy(F.desc("epoch"))
    return results.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def without_finished(state: DataFrame, finished: DataFrame) -> DataFrame:
    """The checkpoints of the jobs that go on: those of finished ones are deleted, one that isn't there is no error."""
    return state.join(finished.select("doc_id"), "doc_id", "left_anti")


def progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, done, total, percent): completed batches of each document, percent rounded half up."""
    done = results.select("doc_id", "batch_no").distinct().groupBy("doc_id").agg(F.count("*").alias("done"))
    out = totals.join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total") + 0.5).cast("long"))
