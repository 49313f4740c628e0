"""SimHash near-duplicate detection over a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool, bounded_batches, join_by_key
from quire.llm.components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: A posting list with more distinct fingerprints is linked through midpoints instead of pairs.
DENSE = 2048
#: Distinct fingerprints from which the lists go by four bytes.
WIDER = 50_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], end[:-1] + 1))[:n].tolist()
    last = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(body[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536])), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, sign): fp is the fingerprint as a signed long, null and empty texts have 0; sign is the text's xxhash64."""
    bounded_batches(docs.sparkSession)

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(of, "long")(F.col(text_col)).alias("fp"), F.xxhash64(text_col).alias("sign"))


def byte_groups(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any MAX_BITS equal bytes of 8 contain at least one of them whole.

    Two fingerprints with at most 4 differing bits agree in at least 4 of their 8 bytes. width 4: all 70 sets of
    4 positions. width 3: 20 triples, by splitting the positions in three parts and taking the triples inside a
    part and those with two positions in a part and one in the next.
    """
    if width == 4:
        return list(combinations(range(8), 4))
    part = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for p in part for t in combinations(p, 3)]
    return found + [tuple(sorted((*two, one))) for i, p in enumerate(part) for two in combinations(p, 2) for one in part[(i + 1) % 3]]


def _mask(group: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * b) for b in group)
    return m - (1 << 64) if m >> 63 else m


def postings(fps: DataFrame, width: int) -> DataFrame:
    """(g, v, fp): the index of fingerprints by the bytes at each set of positions."""
    posted = [F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for i, g in enumerate(byte_groups(width))]
    return fps.select("fp", F.explode(F.array(*posted)).alias("key")).select("key.g", "key.v", "fp")


def tallied(index: DataFrame, width: int, once: bool = True) -> DataFrame:
    """(src, dst): pairs that meet in a list of the index and agree in at least as many bytes as MAX_BITS differing bits leave.

    The tally of a pair's shared positional bytes is taken where they meet, as both fingerprints are at hand, so no pair
    is written for each list it shares. once: the index is whole, and a pair counts in the first list it shares.
    """
    a, b = index.alias("a"), index.alias("b").hint("merge")  # the index is larger than Spark thinks: never a broadcast
    x = F.expr("a.fp ^ b.fp")
    shared = sum((F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(_mask(g))) == 0, F.lit(i)) for i, g in enumerate(byte_groups(width))])
    meet = (F.col("a.g") == F.col("b.g")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & (shared >= 8 - MAX_BITS)
    return a.join(b, meet & (first == F.col("a.g")) if once else meet).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def links(spark: SparkSession, fps: DataFrame, spool: Spool, dense: int = DENSE) -> DataFrame:
    """(src, dst) fingerprints that connect exactly what the pairs with at most MAX_BITS differing bits connect.

    fps: distinct fingerprints. Each is posted under groups of positional bytes; pairs that meet in a list stay if the
    tally of their shared bytes reaches the guaranteed minimum of 4, and then their bits are counted. In a list with
    over ``dense`` fingerprints no pairs are made: two fingerprints differ in at most 4 bits just if some midpoint is
    within 2 bits of both, so each is linked to the smallest at each of its midpoints, and the work is linear. From
    WIDER fingerprints on lists go by four bytes, as those by three would be long by chance.
    """
    width = 3 if fps.count() <= WIDER else 4
    index = postings(fps, width)
    heavy = spool.put(index.groupBy("g", "v").count().filter(F.col("count") > dense).select("g", "v"))
    some = heavy.limit(1).count() > 0
    light = index.join(heavy, ["g", "v"], "left_anti") if some else index
    found = tallied(light, width, not some).filter(F.bit_count(F.expr("src ^ dst")) <= MAX_BITS)
    if not some:
        return found
    wrap = lambda v: v - (1 << 64) if v >> 63 else v
    free = {i: [b for b in range(64) if b // 8 not in g] for i, g in enumerate(byte_groups(width))}
    flips = [(i, wrap(sum(1 << b for b in bits))) for i, bs in free.items() for n in range(MAX_BITS // 2 + 1) for bits in combinations(bs, n)]
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(flips, columns=["g", "flip"]), "g int, flip long"))  # fixed size: some 821 rows a group
    hot = index.join(heavy, ["g", "v"], "left_semi").join(table, "g").select("g", "fp", F.expr("fp ^ flip").alias("mid"))
    hub = hot.groupBy("g", "mid").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1").select("g", "mid", "dst")
    star = hot.join(hub.hint("merge"), ["g", "mid"]).filter("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()
    return found.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per document: id, fp (signed long), sign (xxhash64 of the text), component_id (the smallest id reachable by links), group.

    group is the smallest fingerprint of the component: it tells components apart where rows of one id have different
    texts. Equal fingerprints are one node, so a group of copies costs one node however large it is. Null, empty and
    blank texts share fingerprint 0 and so one component, as the links say. Repeated rows come back as often as they
    stand in the input. A null id takes no part in the choice of a component's id; a component of such rows has none.
    An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "simhash")
    each = spool.put(fingerprints(docs, id_col, text_col))
    nodes = spool.put(each.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("rows")))
    linked = connected_components(spark, links(spark, nodes.select("fp"), spool, dense), spool)
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", "rows", F.coalesce("component", "fp").alias("group"))
    named = spool.put(named)
    least = spool.put(named.groupBy("group").agg(F.min("node").alias("component_id"), F.count("*").alias("nodes")))
    named = spool.put(join_by_key(named, least, "group", "nodes"))
    return join_by_key(each, named.select("fp", "group", "component_id", "rows"), "fp", "rows").select("id", "fp", "sign", "component_id", "group")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
