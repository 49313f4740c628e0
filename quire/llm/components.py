"""Connected components by alternating large-star and small-star passes over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool


def connected_components(spark: SparkSession, edges: DataFrame, spool: Spool | None = None) -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node reachable.

    edges: two long columns src and dst, in any order and with repeats. Each pass keeps every component connected
    and only rewires edges towards smaller nodes, so the number of edges never grows beyond its start, a hub needs
    no list of its neighbours (only their minimum is grouped), and about log(n) passes are enough. Tables between
    passes are written to the shared folder. No edges: an empty table.
    """
    spool = spool or Spool(spark, "components")
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    e = spool.put(e.filter("src <> dst").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == seen:
            break
        seen = tuple(state)
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("k"), F.least("src", "low").alias("low"))
        large = both.join(low, both.src == low.k).filter("dst > src and dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("k"), "low")
        turned = large.join(low, large.src == low.k).filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        after = spool.put(turned.unionByName(low.select(F.col("k").alias("src"), F.col("low").alias("dst"))).distinct())
        spool.drop(e)
        e = after
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
