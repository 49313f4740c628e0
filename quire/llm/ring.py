"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.llm.common import Spool

SHARDS = 40
VNODES = 64
#: Equal arcs of the key space. Only their counts (at most this many rows) reach the driver.
CELLS = 1 << 15


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, clockwise; a position is a cell number."""
    return sorted({xxhash.xxh64_intdigest(f"{s}/{v}") % CELLS: s for s in range(shards) for v in range(vnodes)}.items())


def plan(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot): where the rows of each cell go, by their rank in it.

    Capacities are exact, floor or ceiling of rows / shards, so that counts end at most one apart. Walking
    clockwise, a cell's rows go to the owner of the next virtual node while that has room; what overflows goes on
    to the next virtual node clockwise whose shard has room. Full shards are skipped by path compression.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    nodes = ring(shards, vnodes)
    at = [p for p, _ in nodes]
    after = list(range(len(nodes)))

    def open_node(i: int) -> int:
        seen = []
        while not room[nodes[i][1]] and len(seen) <= len(nodes):
            seen.append(i)
            i = after[i] if after[i] != i else (i + 1) % len(nodes)
        for j in seen:
            after[j] = i
        return i

    out = []
    for cell in sorted(counts):
        left, rank = counts[cell], 0
        i = bisect_left(at, cell) % len(nodes)
        while left:
            if not any(room):
                raise AssertionError("capacities hold all rows")
            i = open_node(i)
            s = nodes[i][1]
            if not room[s]:  # its shards have too few virtual nodes left: any shard with room
                s = next(k for k in range(shards) if room[k])
            n = min(left, room[s])
            out.append((cell, rank, rank + n, s, used[s]))
            room[s] -= n
            used[s] += n
            left -= n
            rank += n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    The key of a row is its id with its size and checksum: rows of equal texts, and those of one id with different
    texts, spread over the ring like any others. Texts are never shuffled; only (id, size, crc32) are. Ranks are taken
    inside a cell, about rows / CELLS rows; rows that are equal in all three share one, and a task sorts them. Null texts have size 16 and the crc32
    of no bytes. A null id is a key like any other. Empty table: no rows. The driver sees one count per cell.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(key.alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    spot = F.xxhash64("id", "size", "text_crc32")
    rows = Spool(spark, "ring").put(rows.withColumn("cell", F.pmod(spot, F.lit(CELLS)).cast("int")))  # so that texts are read once
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = T.StructType([T.StructField(n, T.LongType() if n in ("lo", "hi", "slot0") else T.IntegerType()) for n in ("cell", "lo", "hi", "shard", "slot0")])
    moves = F.broadcast(spark.createDataFrame(plan(counts, shards, vnodes), parts))  # at most CELLS + shards * vnodes rows
    rank = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(1)), "id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    placed = ranked.join(moves, (ranked.cell == moves.cell) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    out = shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
