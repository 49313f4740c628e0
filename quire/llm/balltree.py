"""Exact top-k inner-product search: a ball tree per shard, branch and bound, a shared kth score."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import Spool, bounded_batches, mix
from quire.llm.vectors import matrix, packed

K = 20
SCALE = 64
#: Candidates in one shard (one tree in memory), unless that makes more than SHARDS of them, and queries that share one copy of a shard.
SHARD_ROWS, SHARDS = 5_000, 4_096
QUERY_ROWS = 200_000
#: Rows the driver draws for each shard to place the planes between them.
SAMPLE_A_SHARD = 32
LEAF = 256


class BallTree:
    """Nodes with a centre and a radius over integer vectors held as float64 (exact below 2**53)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x = ids, x
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self.leaf = leaf
        self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> int:
        x = self.x[rows]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, rows, -1, -1))
        if len(rows) > self.leaf and radius > 0:
            far = x[np.argmax(((x - centre) ** 2).sum(1))]
            other = x[np.argmax(((x - far) ** 2).sum(1))]
            side = np.argsort(x @ (other - far), kind="stable")  # halves along the line between two far points
            half = len(rows) // 2
            left, right = self._grow(rows[side[:half]]), self._grow(rows[side[half:]])
            self.nodes[me] = (centre, radius, None, left, right)
        return me

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No vector below the node scores more with q than this."""
        centre, radius = self.nodes[node][:2]
        return _upper(q @ centre, norm * radius)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), k columns each, for query rows q; a vector whose id is own[i] is left out of row i.

        floor: a score that k others are known to reach; branches strictly below it are cut. Missing: score -inf.
        """
        n = len(q)
        best = np.full((n, k), -np.inf)
        name = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        kth = floor.astype(float).copy()
        norm = np.sqrt((q**2).sum(1))

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            rows = rows[bound >= kth[rows]]
            if not len(rows):
                return
            _, _, members, left, right = self.nodes[node]
            if members is not None:
                for at in range(0, len(members), 4096):  # equal vectors can't be split: such a leaf may be large
                    m = members[at : at + 4096]
                    s = q[rows] @ self.x[m].T
                    s[self.ids[m][None, :] == own[rows][:, None]] = -np.inf
                    s = np.concatenate((best[rows], s), axis=1)
                    i = np.concatenate((name[rows], np.broadcast_to(self.ids[m], (len(rows), len(m)))), axis=1)
                    i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best[rows], name[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                    kth[rows] = np.maximum(kth[rows], best[rows, -1])
                return
            bl, br = self.bound(left, q[rows], norm[rows]), self.bound(right, q[rows], norm[rows])
            first = bl >= br
            visit(left, rows[first], bl[first])
            visit(right, rows[~first], br[~first])
            visit(right, rows[first], br[first])
            visit(left, rows[~first], bl[~first])

        if len(self.x) and n:
            visit(0, np.arange(n), self.bound(0, q, norm))
        return name, best


def _grid(scale: int):
    """Adds integer vectors: floor(scale * x) as float64 bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, dim = b.column("raw").to_pylist(), b.column("dim").to_pylist()
            out = [np.floor(matrix([r], d)[0] * scale).tobytes() for r, d in zip(raw, dim)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary()), b.column("dim")], names=["id", "raw", "dim"])

    return run


def _scan(k: int):
    """Over rows sorted by (cell, kind): the shard's candidates (kind 0), then its queries (kind 1) in batches."""

    def run(batches):
        import pyarrow as pa

        at, tree, ids, raws, dim = None, None, [], [], 0

        def answer(rows):
            nonlocal tree
            if not ids:
                return None
            if tree is None:
                tree = BallTree(np.array(ids, np.int64), matrix(raws, dim))
            q = matrix([r[3] for r in rows], dim)
            own = np.array([r[2] for r in rows], np.int64)
            floor = np.array([-np.inf if r[4] is None else r[4] for r in rows])
            name, score = tree.search(q, own, k, floor)
            keep = np.isfinite(score)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k).reshape(-1, k)[keep]), pa.array(name[keep]), pa.array(score[keep].astype(np.int64))], names=["query_id", "vec_id", "score"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("cell", "kind", "id", "raw", "floor", "dim")]
            queries = []
            for row in zip(*cols):
                if row[0] != at:
                    if queries and (out := answer(queries)) is not None:
                        yield out
                    at, tree, ids, raws, queries, dim = row[0], None, [], [], [], row[5]
                if row[1] == 0:
                    ids.append(row[2])
                    raws.append(row[3])
                else:
                    queries.append(row)
            if queries and (out := answer(queries)) is not None:
                yield out

    return run


class Cuts:
    """The planes that cut the vectors of one length into shards of about equal size, from a sample of them.

    Each cut goes through the median along the line between two far rows, as in the trees inside the shards. Equal
    rows are set apart by their ids, so copies of one vector fill no shard. ``centres`` are those of the sample's rows.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, shards: int):
        self.planes: list[tuple[np.ndarray, float, float]] = []
        rows = [np.arange(len(x))]
        while len(rows) < shards:
            below = []
            for at in rows:
                y = x[at]
                far = y[np.argmax(((y - y.mean(0)) ** 2).sum(1))]
                line = y[np.argmax(((y - far) ** 2).sum(1))] - far
                step = 1e-9 * max(1.0, float(np.abs(y @ line).max()))
                place = self._place(ids[at], y, line, step)
                order = np.argsort(place, kind="stable")
                half = len(at) // 2
                self.planes.append((line, step, float(place[order[half]])))
                below += [at[order[:half]], at[order[half:]]]
            rows = below
        self.centres = np.stack([x[at].mean(0) for at in rows])

    @staticmethod
    def _place(ids: np.ndarray, x: np.ndarray, line: np.ndarray, step: float) -> np.ndarray:
        return x @ line + (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)) * 2.0**-53 * step

    def home(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        at = np.zeros(len(x), np.int64)  # the planes in heap order
        while len(self.planes) > int(at[0] if len(at) else len(self.planes)):
            side = np.empty(len(x), np.int64)
            for p in np.unique(at):
                mine = at == p
                line, step, cut = self.planes[p]
                side[mine] = self._place(ids[mine], x[mine], line, step) >= cut
            at = 2 * at + 1 + side
        return at - len(self.planes)


def _sharded(cuts: dict[int, Cuts]):
    """Adds the home shard, and the distance from that shard's centre."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, dims, raw = b.column("id").to_numpy(), b.column("dim").to_numpy(), b.column("raw").to_pylist()
            home, away = np.zeros(len(ids), np.int32), np.zeros(len(ids))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = matrix([raw[i] for i in at], d)
                home[at] = cuts[d].home(ids[at], x)
                away[at] = np.sqrt(((x - cuts[d].centres[home[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), b.column("dim"), pa.array(home), pa.array(away)], names=["id", "raw", "dim", "home", "away"])

    return run


def _routes(balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Sends each query on to the shards whose ball may hold a score that reaches its floor."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            dims, homes, raw = b.column("dim").to_numpy(), b.column("home").to_numpy(), b.column("raw").to_pylist()
            floor = b.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            who, where = [], []
            for d in np.unique(dims).tolist():
                shard, centre, radius = balls[d]
                rows = np.flatnonzero(dims == d)
                q = matrix([raw[i] for i in rows], d)
                norm = np.sqrt((q**2).sum(1))
                for lo in range(0, len(rows), 256):
                    at = slice(lo, lo + 256)
                    bound = _upper(q[at] @ centre.T, norm[at, None] * radius)
                    i, j = np.nonzero((bound >= floor[rows[at], None]) & (shard[None, :] != homes[rows[at], None]))
                    who.append(rows[at][i])
                    where.append(shard[j])
            if who:
                who, where = np.concatenate(who), np.concatenate(where)
                part = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "raw", "dim", "floor")), pa.array(where, pa.int32())], names=["id", "raw", "dim", "floor", "s"])

    return run


def _upper(middle: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The sum of two parts of a bound, a little more for rounding."""
    b = middle + reach
    return b + 1e-9 * (np.abs(middle) + reach) + 1e-6


def top_k(vectors: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its k best other rows, ties to smaller ids.

    Planes from a sample cut the vectors into shards of about shard_rows neighbours (at most SHARDS shards, larger
    ones beyond), equal vectors by their ids, so none can fill a shard. Every query meets its own shard first. The kth
    score found there is compared with the upper bound of each other shard's ball (its centre and radius are in a table
    of one row a shard): only pairs of query and shard that may matter are sent, and the shard's tree prunes against the
    same score. Queries stream through a shard's task in batches, with one copy of the shard for each query_rows
    queries. Vectors that are null, empty or hold null or non-finite components take no part; vectors of
    different lengths are not compared. A repeated id is a row of its own among candidates; as a query it asks with
    the smallest of its vectors (by bytes), and rows with its id are never its answers. Fewer than k candidates: all of
    them. Any id, negative ones too, can be a query or an answer. Empty table: no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    spool = Spool(spark, "topk")
    plain = spool.put(packed(vectors, id_col, vec_col).mapInArrow(_grid(scale), "id long, raw binary, dim int"))
    cuts, total, queries_in = {}, 0, 0
    for r in plain.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asks")).collect():
        shards = 1 << max(0, math.ceil(math.log2(max(1, min(r.n / shard_rows, SHARDS)))))
        share_of = F.lit(min(1.0, SAMPLE_A_SHARD * shards / r.n))
        drawn = plain.filter((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("id", "raw"), F.lit(1 << 30)) < share_of * (1 << 30))).select("id", "raw").toArrow().sort_by([("id", "ascending"), ("raw", "ascending")])
        if len(drawn) < 2 * shards:
            shards, drawn = 1, plain.filter(F.col("dim") == r.dim).select("id", "raw").limit(1).toArrow()  # too few to cut
        cuts[r.dim] = Cuts(drawn.column("id").to_numpy(), matrix(drawn.column("raw").to_pylist(), r.dim), shards)
        total, queries_in = total + shards, queries_in + r.asks
    base = spool.put(plain.mapInArrow(_sharded(cuts), "id long, raw binary, dim int, home int, away double"))
    balls = {}
    for r in base.groupBy("dim", "home").agg(F.max("away").alias("radius")).collect():  # one row a shard
        balls.setdefault(r.dim, []).append((r.home, cuts[r.dim].centres[r.home], r.radius))
    balls = {d: (np.array([x[0] for x in v]), np.stack([x[1] for x in v]), np.array([x[2] for x in v])) for d, v in balls.items()}
    groups = max(1, math.ceil(queries_in / query_rows))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    cell = lambda s, g: F.concat_ws("/", "dim", s, g)
    cands = base.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(cell("home", "g").alias("cell"), F.lit(0).alias("kind"), "id", "raw", F.lit(None).cast("double").alias("floor"), "dim")
    queries = base.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("raw", "dim", "home")).alias("q")).select("id", "q.*")

    def scan(asked: DataFrame) -> DataFrame:
        rows = cands.unionByName(asked).repartition(max(2, min(4 * total * groups, 20_000)), "cell").sortWithinPartitions("cell", "kind", "id")
        return rows.mapInArrow(_scan(k), "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    near = spool.put(scan(queries.select(cell("home", part).alias("cell"), F.lit(1).alias("kind"), "id", "raw", F.lit(None).cast("double").alias("floor"), "dim")))
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    sent = queries.join(kth, queries.id == kth.query_id, "left").select("id", "raw", "dim", "home", "floor")
    sent = sent.mapInArrow(_routes(balls), "id long, raw binary, dim int, floor double, s int")
    far = scan(sent.select(cell("s", part).alias("cell"), F.lit(1).alias("kind"), "id", "raw", "floor", "dim"))
    return best(near.unionByName(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"))
