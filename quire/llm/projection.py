"""Embedding near-duplicates by random projections that bound every pair."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool, bounded_batches, join_by_key
from quire.llm.components import connected_components
from quire.llm.vectors import matrix, packed, valid

COSINE = 0.9
#: Rows of one length are dealt to blocks of so many rows, at least SPREAD blocks if there are rows for them; every two blocks are a task.
#: A block's components are bounded too: TILE_VALUES of them.
TILE_LEAST, TILE_MOST, TILE_VALUES, SPREAD = 128, 65_536, 1 << 22, 8
#: Rows of a cell, and columns that a cell is compared with at a time: their products stay near the processor.
CELL, SPAN = 256, 4096
#: Above this part of all pairs, what the projections leave is checked by a product of all of them.
DENSE = 0.02


def passes_for(n: int, dim: int = 64, cosine: float = COSINE) -> int:
    """Random directions with which of the n rows about one passes the bound of an evenly spread row without being near.

    k directions of dim see about k / dim of a pair's distance, give or take sqrt(k) / dim. Fewer or more change
    the work only: what passes is checked in full, and nothing that is linked fails to pass.
    """
    z = math.sqrt(2 * math.log(max(n, 2)))
    return min(dim, math.ceil(((z + math.sqrt(z * z + 4 * (1 - cosine) * dim)) / 2) ** 2))


def directions(dim: int, number: int) -> np.ndarray:
    """Random orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, number)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def sketch(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The projections of the rows' directions and the length of what they leave: no two rows are nearer than their sketches."""
    out = np.empty((len(x), axes.shape[1] + 1), np.float32)
    for at in range(0, len(x), SPAN):
        u = unit(x[at : at + SPAN].astype(np.float64))
        p = u @ axes
        out[at : at + SPAN, :-1] = p
        out[at : at + SPAN, -1] = np.sqrt(np.maximum(1 - (p**2).sum(1), 0))
    return out


def _cells(s: np.ndarray) -> list[np.ndarray]:
    """Positions of the rows of each cell: split at the median of the projection that spreads most, down to CELL rows."""
    done, stack = [], [np.arange(len(s))]
    while stack:
        at = stack.pop()
        if len(at) <= CELL:
            done.append(at)
            continue
        part = s[at]
        order = np.argsort(part[:, part.var(0).argmax()], kind="stable")
        half = len(at) // 2
        stack += [at[order[:half]], at[order[half:]]]
    return done


class Side:
    """Rows of a tile in the order of their cells: vectors as they came, sketches, multiplicities, and each cell's box."""

    def __init__(self, at: np.ndarray, x: np.ndarray, s: np.ndarray, mult: np.ndarray):
        cells = _cells(s[at])
        order = at[np.concatenate(cells)] if cells else at
        self.at, self.x, self.s, self.mult = order, x[order], s[order], mult[order]
        self.edge = np.cumsum([0, *map(len, cells)])
        self.low, self.high = (np.array([f(s[at[c]], 0) for c in cells]).reshape(len(cells), s.shape[1]) for f in (np.min, np.max))


class Forest:
    """Labels of rows, and the pairs that joined them."""

    def __init__(self, n: int):
        self.label, self.pairs = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            self.pairs.append((i[first], j[first]))
            to = np.arange(len(self.label))
            to[high] = np.minimum(a, b)[first]
            while not np.array_equal(to, further := to[to]):
                to = further
            self.label = to[self.label]


def _checked(x: np.ndarray, y: np.ndarray, hit: np.ndarray, cosine: float) -> np.ndarray:
    """Of the pairs of rows marked in hit those that are linked, in double precision."""

    def exactly(i, j):
        ok, step = np.zeros(len(i), bool), max(1, (1 << 21) // x.shape[1])
        for k in range(0, len(i), step):
            ok[k : k + step] = np.einsum("ij,ij->i", unit(x[i[k : k + step]].astype(np.float64)), unit(y[j[k : k + step]].astype(np.float64))) >= cosine
        return ok

    if np.count_nonzero(hit) > DENSE * hit.size:
        sims = unit(x.astype(np.float64)) @ unit(y.astype(np.float64)).T
        i, j = np.nonzero(hit & (np.abs(sims - cosine) < 1e-12))  # how such a pair is rounded mustn't depend on what it is compared with
        hit &= sims >= cosine
    else:
        i, j = np.nonzero(hit)
    hit[i, j] = exactly(i, j)
    return hit


def links(x: np.ndarray, side: np.ndarray, mult: np.ndarray, cosine: float = COSINE, passes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row across the tile, by multiplicity; both ends of a spanning forest of the linked pairs).

    side: 0 and 1, or 2 for a tile against itself. For each two rows the sum of the products of their sketches is at
    least their cosine (Cauchy and Schwarz on what the projections leave), so a pair below the threshold there, or in
    cells whose boxes are further apart than linked rows can be, isn't linked. All others are checked in full.
    """
    s = sketch(x, directions(x.shape[1], passes or passes_for(len(x), x.shape[1], cosine)))
    alone = bool((side == 2).all())
    a = Side(np.flatnonzero(side != 1), x, s, mult)
    b = a if alone else Side(np.flatnonzero(side == 1), x, s, mult)
    n, forest = np.zeros(len(x), np.int64), Forest(len(x))
    loss = (s.shape[1] + 8) * 2.0**-22  # of single precision, in the sketches and in their products
    for c in range(len(a.edge) - 1):
        lo, hi = int(a.edge[c]), int(a.edge[c + 1])
        gap = np.maximum(np.maximum(b.low - a.high[c], a.low[c] - b.high), 0).astype(np.float64)
        near = np.flatnonzero((gap**2).sum(1) <= 2 - 2 * cosine + 2 * loss)
        near = near[near >= c] if alone else near
        cols = np.concatenate([np.arange(b.edge[k], b.edge[k + 1]) for k in near]) if len(near) else np.zeros(0, np.int64)
        for at in range(0, len(cols), SPAN):
            part = cols[at : at + SPAN]
            hit = a.s[lo:hi] @ b.s[part].T >= cosine - loss
            if alone:  # each pair once
                hit &= part[None, :] > np.arange(lo, hi)[:, None]
            if not hit.any():
                continue
            rows, held = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            rows, held = rows + lo, part[held]
            hit = _checked(a.x[rows], b.x[held], hit[np.ix_(rows - lo, np.searchsorted(part, held))], cosine)
            n[a.at[rows]] += hit @ b.mult[held]
            n[b.at[held]] += hit.T @ a.mult[rows]
            i, j = np.nonzero(hit & (forest.label[a.at[rows]][:, None] != forest.label[b.at[held]]))
            forest.join(a.at[rows[i]], b.at[held[j]])
    ends = [np.concatenate([p[k] for p in forest.pairs]) if forest.pairs else np.zeros(0, np.int64) for k in (0, 1)]
    return n, *ends


def _meet(cosine: float, passes: int | None):
    """Over rows sorted by tile: (node, null, number of its links across the tile) and (node, node it is linked with, null)."""

    def run(batches):
        import pyarrow as pa

        def flush():
            n, i, j = links(np.concatenate(raw), np.concatenate(side), np.concatenate(mult), cosine, passes)
            ids, some = np.concatenate(names), np.flatnonzero(n)
            src, dst = pa.array(np.concatenate((ids[some], ids[i]))), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[j], pa.int64())])
            return pa.RecordBatch.from_arrays([src, dst, pa.concat_arrays([pa.array(n[some], pa.int64()), pa.nulls(len(i), pa.int64())])], names=["src", "dst", "n"])

        tile, side, names, raw, mult = None, [], [], [], []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "low", "high")], 1)
            edge = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *edge], [*edge, len(keys)]):
                if hi == lo:
                    continue
                part, key = b.slice(lo, hi - lo), tuple(keys[lo].tolist())
                if key != tile:
                    if names:
                        yield flush()
                    tile, side, names, raw, mult = key, [], [], [], []
                side.append(part.column("side").to_numpy())
                names.append(part.column("id").to_numpy())
                mult.append(part.column("mult").to_numpy())
                raw.append(matrix(part.column("raw").to_pylist(), key[0], None))
        if names:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", passes: int | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a multiplicity, so exact copies cost nothing. Nodes are dealt to blocks of bounded
    size, and every two blocks meet in a task, at any number of nodes. There random projections (``passes`` of them)
    bound each pair's cosine from above, cells of rows at once and row by row, and what they leave is checked in
    double precision: every link is found, counted and, in a spanning forest of each task, united. No list of partners
    is cut short and no pair is written out. Memory is bounded by blocks; the pairs that are bounded grow with the square.

    Null, empty and zero vectors and those with null or non-finite components have n_links 0 and are their own
    component; vectors of different lengths don't link. Rows of one id with different vectors are nodes of their own
    and get each the answer of its vector. A row with a null id takes no part: its component is null, it is kept.
    Empty table: no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    spool = Spool(spark, "projection")
    takes_part = valid(vec_col) & F.exists(F.col(vec_col), lambda x: x != 0) & F.col(id_col).isNotNull()
    takes_part = F.coalesce(takes_part, F.lit(False))
    lone = vectors.filter(~takes_part).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    rows = spool.put(packed(vectors.filter(takes_part), id_col, vec_col).withColumn("node", F.xxhash64("raw", "dim")))
    nodes = spool.put(rows.groupBy("node").agg(F.min(F.struct("raw", "dim")).alias("v"), F.min("id").alias("least"), F.count("*").alias("mult")).select(F.col("node").alias("id"), "v.*", "least", "mult"))
    most = F.greatest(F.lit(TILE_LEAST), F.least(F.lit(TILE_MOST), F.lit(TILE_VALUES) / F.col("dim")))
    blocks = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(SPREAD), F.ceil(F.col("n") / TILE_LEAST))).cast("int")
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").select("dim", blocks.alias("blocks"))
    wide = int(sizes.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1)
    dealt = nodes.join(F.broadcast(sizes), "dim").withColumn("me", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("side", F.when(F.col("me") == F.col("other"), 2).when(F.col("me") < F.col("other"), 0).otherwise(1)).withColumns({"low": F.least("me", "other"), "high": F.greatest("me", "other")})
    task = F.pmod(F.expr("high * (high + 1) div 2 + low + dim"), F.lit(min(wide, 20_000))).cast("int")
    tiles = dealt.select("dim", "low", "high", "side", "id", "raw", "mult").repartitionById(min(wide, 20_000), task).sortWithinPartitions("dim", "low", "high", "id")
    met = spool.put(tiles.mapInArrow(_meet(cosine, passes), "src long, dst long, n long"))
    linked = spool.put(connected_components(spark, met.filter("dst is not null").select("src", "dst"), spool))
    size = linked.join(nodes.select(F.col("id").alias("node"), "least"), "node").groupBy("component").agg(F.count("*").alias("size"), F.min("least").alias("component_id"))
    linked = join_by_key(linked, spool.put(size), "component", "size")
    counts = met.filter("n is not null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    per = nodes.join(linked.select("node", "component_id"), nodes.id == F.col("node"), "left").drop("node").join(counts, nodes.id == counts.node, "left")
    per = spool.put(per.select(F.col("id").alias("node"), "mult", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = join_by_key(rows.select(F.col("id").alias("vec_id"), "node"), per, "node", "mult").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
