"""Lookups that keep rows where they are, and rows that go to Python in bounded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Rows and bytes of one Arrow batch; quire.llm sets the same.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, which a Python worker gets in batches bounded by bytes; by default it gets 10,000 at once, and texts are wide."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def at_home(df: DataFrame, home: str = "doc_id") -> DataFrame:
    """Rows dealt by ``home`` to the session's number of shuffle partitions, which stay as many.

    Where much is done to few bytes, tasks chosen by bytes would be too few, and sides that are to meet without
    a further shuffle have to be dealt alike.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), home)


def attached(rows: DataFrame, side: DataFrame, keys: list[str], name: str, home: str = "doc_id") -> DataFrame:
    """Rows with a struct of the columns of the side's row of the same keys; null where there is none, or a key is null.

    The side has one row for each combination of keys at most, ``home`` is one of them. Both are windowed together,
    so rows that lie by ``home`` already aren't shuffled again, as a join on more keys would have it.
    """
    struct = F.struct(*[F.col(c) for c in side.columns if c not in keys])
    kind = side.select(struct.alias("s")).schema["s"].dataType
    theirs = at_home(side.dropna(subset=keys).select(*keys, struct.alias(name), F.lit(False).alias("_own")), home)
    both = rows.withColumns({name: F.lit(None).cast(kind), "_own": F.lit(True)}).unionByName(theirs, allowMissingColumns=True)
    return both.withColumn(name, F.first(name, ignorenulls=True).over(W.partitionBy(*keys))).filter("_own").drop("_own")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: as a generated one it isn't copied into the filters and joins above that ask for it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
