"""Sampled subword segmentations without replacement: Gumbel top-k by perturbed A-star search over the lattice."""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, code_points, length_chunks, mix, prefix_sums, range_hashes

SAMPLES = 2
#: Characters of the texts that share a lattice; more of them repeat more words.
CHUNK_CHARS = 500_000
SEED = 5
SPACE = 0x2581
_GOLD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MODELS: dict = {}


class Vocabulary:
    """Pieces of a model file with log-probabilities.

    A BPE file scores pieces by merge rank only, so the unigram distribution of the lattice is Zipf's over the
    ranks: p(piece) in proportion to (1 + rank) ** -power.
    """

    def __init__(self, path: str, power: float = 1.0):
        import sentencepiece

        sp = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes = {}
        names, ids = [], []
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names.append(sp.id_to_piece(i))
                ids.append(i)
        order = sorted(range(len(ids)), key=lambda k: (-sp.get_score(ids[k]), ids[k]))
        weight = np.empty(len(ids))
        weight[order] = (1.0 + np.arange(len(ids))) ** -power
        logp = np.log(weight / weight.sum())
        self.floor = float(logp.min()) - 1.0  # of one byte of a character that no piece holds
        self.longest = max(map(len, names))
        points = code_points("".join(names)).astype(np.uint64)
        end = np.cumsum([len(n) for n in names])
        hashes = range_hashes(points, end - np.array([len(n) for n in names]), end)
        at = np.argsort(hashes)
        self.hashes, self.ids, self.logp = hashes[at], np.array(ids)[at], logp[at]
        slot = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.slots = np.full(1 << 22, -1, np.int32)  # the piece by its hash's first bits; -2: of several
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -2
        self.unknown = sp.unk_id()
        self.id_type = "<u2" if size <= 1 << 16 else "<u4"
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        said = [spelled.get(i) or sp.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_end = np.cumsum([len(x) for x in said])
        self.said_size = np.diff(np.concatenate(([0], self.said_end)))
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)])

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space that each text begins with."""
        size = self.said_size[ids]
        skip = np.repeat(self.said_end[ids] - np.cumsum(size), size)
        return self.said[skip + np.arange(len(skip))].tobytes()[1:]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        hit = self.slots[(h >> np.uint64(42)).astype(np.int64)].astype(np.int64)
        if (crowd := np.flatnonzero(hit == -2)).size:
            hit[crowd] = np.minimum(np.searchsorted(self.hashes, h[crowd]), len(self.hashes) - 1)
        some = np.flatnonzero(hit >= 0)
        hit[some[self.hashes[hit[some]] != h[some]]] = -1
        return hit


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


class Lattice:
    """The lattices of all distinct chunks of some texts.

    Spaces become U+2581 and a text begins with one; a chunk is a run of them with the characters up to the next
    one. No piece holds one after another character, so a text's lattice is the chain of its chunks' lattices.
    """

    def __init__(self, texts: list[str], v: Vocabulary):
        self.v = v
        joined = code_points("".join("▁" + t.replace(" ", "▁") for t in texts)).astype(np.uint64)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        base = np.concatenate(([0], np.cumsum(size)))
        mark = joined == SPACE
        cut = mark & np.concatenate(([True], ~mark[:-1]))
        cut[base[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.concatenate((start[1:], [len(joined)]))
        self.first = np.searchsorted(start, base)  # chunks of each text
        _, one, self.of = np.unique(range_hashes(joined, start, end), return_index=True, return_inverse=True)
        self._build(joined, start[one], end[one])

    def _build(self, joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        v, n = self.v, end - start
        self.length = n
        self.base = np.concatenate(([0], np.cumsum(n + 1)[:-1]))  # the node of position p of chunk d is base[d] + p
        total = int(n.sum())
        flat = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        chars = joined[flat]
        self.chars = chars
        self.char0 = np.concatenate(([0], np.cumsum(n)[:-1]))
        room = np.repeat(np.cumsum(n), n) - np.arange(total)
        node = np.arange(total) + np.repeat(np.arange(len(n)), n)  # of the position before each character
        tail, span, piece, score = [], [], [], []
        sums = prefix_sums(chars)
        for k in range(1, v.longest + 1):
            at = np.flatnonzero(room >= k)
            if not len(at):
                break
            hit = v.find(range_hashes(chars, at, at + k, sums))
            ok = hit >= 0
            at, hit = at[ok], hit[ok]
            if k == 1:
                lone = np.ones(total, bool)
                lone[at] = False
                lone = np.flatnonzero(lone)
                c = chars[lone]
                width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                tail.append(node[lone])
                span.append(np.ones(len(lone), np.int64))
                piece.append(-1 - c.astype(np.int64))  # spelled in bytes
                score.append(width * v.floor)
            tail.append(node[at])
            span.append(np.full(len(at), k))
            piece.append(v.ids[hit])
            score.append(v.logp[hit])
        tail, span, piece, score = (np.concatenate(x) for x in (tail, span, piece, score))
        head = tail + span
        place = np.zeros(total + len(n), np.int64)
        place[node + 1] = np.arange(total) - np.repeat(self.char0, n) + 1
        order = np.argsort(place[head] * (total + len(n)) + head, kind="stable")
        tail, head, span, piece, score = tail[order], head[order], span[order], piece[order], score[order]
        new = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else np.zeros(0, np.int64)
        level = place[head]
        bounds = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
        alpha = np.zeros(total + len(n))
        mass = np.empty(len(tail))
        for a, b in zip(bounds[:-1], bounds[1:]):
            x = alpha[tail[a:b]] + score[a:b]
            cuts = new[np.searchsorted(new, a) : np.searchsorted(new, b)] - a
            top = np.maximum.reduceat(x, cuts)
            many = np.diff(np.concatenate((cuts, [b - a])))
            e = np.exp(x - np.repeat(top, many))
            s = np.add.reduceat(e, cuts)
            alpha[head[a:b][cuts]] = top + np.log(s)
            mass[a:b] = e / np.repeat(s, many)
        self.tail, self.span, self.piece, self.score, self.prob, self.alpha = tail, span, piece, score, mass, alpha
        number = np.full(total + len(n), -1)
        number[head[new]] = np.arange(len(new))
        self.number = number
        self.steps = mass.copy()  # running sums inside each node, so no other node's digits are in them
        many = np.diff(np.concatenate((new, [len(mass)])))
        for j in range(1, int(many.max()) if len(many) else 0):
            at = new[many > j] + j
            self.steps[at] += self.steps[at - 1]
        self.last = np.concatenate((new[1:], [len(mass)])) - 1
        self.edge0 = new
        self.total = alpha[self.base + n]

    def sample(self, of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges in order, number of edges of each chunk, log-probability of each chunk's path), by backward sampling."""
        m = len(of)
        left, at = np.arange(m), self.base[of] + self.length[of]
        logp = -self.total[of]
        who, what, t = [], [], 0
        count = np.zeros(m, np.int64)
        while len(left):
            k = self.number[at]
            u = uniform(keys[left] + np.uint64(t * _GOLD & _ALL))
            e, low = self.last[k], self.edge0[k]
            down = np.flatnonzero(e > low)  # from the longest piece, which is the likeliest
            while len(down := down[u[down] < self.steps[e[down] - 1]]):
                e[down] -= 1
                down = down[e[down] > low[down]]
            who.append(left)
            what.append(e)
            logp[left] += self.score[e]
            count[left] += 1
            at = self.tail[e]
            go = self.number[at] >= 0
            left, at = left[go], at[go]
            t += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if m else 0, np.int64)
        for t, (w, e) in enumerate(zip(who, what)):
            out[ends[w] - 1 - t] = e
        return out, count, np.minimum(logp, 0.0)

    def another(self, d: int, out: list[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float] | None:
        """A path of chunk d that isn't in ``out``, drawn from the rest of the distribution; None if there is none."""
        at = int(self.base[d] + self.length[d])
        done: list[int] = []
        logq = -float(self.total[d])
        left = [tuple(reversed(p)) for p in out]
        t = 0
        while self.number[at] >= 0:
            k = self.number[at]
            edges = range(int(self.edge0[k]), int(self.last[k]) + 1)
            weights = []
            for e in edges:
                w = math.exp(float(self.score[e]) + float(self.alpha[self.tail[e]]) - float(self.alpha[at]))
                for p in left:
                    if p[t] == e:
                        w -= math.exp(sum(float(self.score[x]) for x in p[t:]) - float(self.alpha[at]))
                weights.append(w if w > 1e-15 else 0.0)
            total = sum(weights)
            if total <= 0:
                return None
            u = float(uniform(np.array([key + t * _GOLD & _ALL], np.uint64))[0]) * total
            pick = max(i for i, w in enumerate(weights) if w > 0)
            for i, w in enumerate(weights):
                u -= w
                if u < 0 and w > 0:
                    pick = i
                    break
            e = edges[pick]
            done.append(e)
            logq += float(self.score[e])
            left = [p for p in left if p[t] == e]
            at = int(self.tail[e])
            t += 1
        return tuple(reversed(done)), min(logq, 0.0)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; a character without a piece is spelled by its bytes."""
        p = self.piece[edges]
        odd = np.flatnonzero(p < 0)
        if not len(odd):
            return p
        points = -1 - p[odd]
        if points.max() < 0x80 and len(self.v.bytes) == 256:  # a line end, mostly
            p[odd] = self.v.byte_ids[points]
            return p
        out: list[int] = []
        for x in p.tolist():
            out += [x] if x >= 0 else [self.v.bytes.get(b, self.v.unknown) for b in chr(-1 - x).encode("utf-8", "replace")]
        return np.array(out, np.int64)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated_gumbel(phi: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with locations phi, given that they are below top."""
    with np.errstate(divide="ignore"):
        return phi - np.logaddexp(phi - top, np.log(-np.log(u)))


class _Path:
    __slots__ = ("edges", "ends", "logp", "g")

    def __init__(self, edges, ends, logp, g):
        self.edges, self.ends, self.logp, self.g = edges, ends, logp, g


def top_k(texts: list[str], row_keys: list[int], v: Vocabulary, k: int = SAMPLES, seed: int = SEED):
    """For each text its k best segmentations by perturbed log-probability: (ids, log p, perturbed, log inclusion).

    A search node is a set of segmentations: those that share the paths of the first chunks and leave out some
    paths of the next. Its perturbed value, the largest of its members', is drawn top-down (a Gumbel variable
    below its parent's value), so it is an exact bound and the search opens nodes in the order of the results.
    Opening a node draws the rest of its best member and splits off one node for each chunk that could differ.
    """
    lat = Lattice(texts, v)
    n = len(texts)
    keys = mix(np.array([(x * 0x9E3779B97F4A7C15 + seed) & _ALL for x in row_keys], np.uint64))
    heaps: list[list] = [[] for _ in range(n)]
    found: list[list[_Path]] = [[] for _ in range(n)]
    tick = 0
    g0 = -np.log(-np.log(uniform(keys)))  # the total mass is 1, so the root has location 0
    begin = [(0, None, None, float(g), 0.0) for g in g0]  # (chunk from which to draw, parent, own chunk's path, value, location)
    live = list(range(n))
    for turn in range(k):
        spans = [np.arange(lat.first[d] + begin[d][0], lat.first[d + 1]) for d in live]
        where = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        many = np.array([len(s) for s in spans], np.int64)
        own = np.repeat(keys[live], many) if len(live) else np.zeros(0, np.uint64)
        salt = mix(own ^ mix(where.astype(np.uint64) - np.repeat(lat.first[live].astype(np.uint64), many) + np.uint64((turn + 1) * _GOLD & _ALL)))
        edges, count, logp = lat.sample(lat.of[where], salt)
        ends = np.concatenate(([0], np.cumsum(count)))
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(np.minimum(logp, -1e-300)))
        rest[logp > -1e-12] = -np.inf
        noise = uniform(salt + np.uint64(0x5851F42D4C957F2D))
        at = 0
        for d, m in zip(live, many.tolist()):
            j, parent, path, g, _ = begin[d]
            e = edges[ends[at] : ends[at + m]]
            new_ends = np.cumsum(count[at : at + m])
            new_logp = logp[at : at + m]
            if parent is None:
                full = _Path(e, new_ends, new_logp, g)
            else:
                keep = int(parent.ends[j - 2]) if j > 1 else 0
                head = parent.edges[:keep]
                mine = np.array(path[0], np.int64)
                full = _Path(np.concatenate((head, mine, e)), np.concatenate((parent.ends[: j - 1], [keep + len(mine)], new_ends + keep + len(mine))), np.concatenate((parent.logp[: j - 1], [path[1]], new_logp)), g)
            found[d].append(full)
            if m:
                phi = np.concatenate(([0.0], np.cumsum(full.logp)))[j : j + m] + rest[at : at + m]
                value = truncated_gumbel(phi, g, noise[at : at + m])
                value[np.isneginf(phi)] = -np.inf
                best = np.argpartition(-value, k)[: k + 1] if m > k + 1 else np.arange(m)
                for b in best.tolist():
                    if value[b] > -np.inf:
                        tick += 1
                        c = j + b
                        lo = int(full.ends[c - 1]) if c else 0
                        heapq.heappush(heaps[d], (-float(value[b]), tick, c, full, [tuple(full.edges[lo : full.ends[c]].tolist())], [float(full.logp[c])]))
            at += m
        if turn == k - 1:
            break
        still = []
        for d in live:
            while heaps[d]:
                minus, _, c, parent, out, outp = heapq.heappop(heaps[d])
                g = -minus
                key = int(mix(np.array([int(keys[d]) ^ (c * 0x632BE59BD9B4E019 + turn * 0x2545F4914F6CDD1D + len(out)) & _ALL], np.uint64))[0])
                path = lat.another(int(lat.of[lat.first[d] + c]), out, key)
                if path is None:
                    continue
                before = float(parent.logp[:c].sum())
                left = 1.0 - sum(map(math.exp, outp)) - math.exp(path[1])
                if left > 1e-12:
                    tick += 1
                    u = uniform(np.array([key ^ 0x1D8E4E27C47D124F], np.uint64))
                    value = float(truncated_gumbel(np.array([before + math.log(left)]), g, u)[0])
                    heapq.heappush(heaps[d], (-value, tick, c, parent, [*out, path[0]], [*outp, path[1]]))
                begin[d] = (c + 1, parent, path, g, before)
                still.append(d)
                break
        live = still
    results = []
    for d in range(n):
        kappa = -heaps[d][0][0] if heaps[d] and len(found[d]) == k else -math.inf
        rows = []
        for p in found[d]:
            lp = float(p.logp.sum())
            x = lp - kappa
            incl = 0.0 if x > 30 else math.log(max(-math.expm1(-math.exp(x)), 5e-324))
            rows.append((lat.ids(p.edges), lp, p.g, incl))
        results.append(rows)
    return results


def decode(ids, path: str) -> str:
    """The text of piece ids: bytes joined, U+2581 back to spaces, without the first one."""
    return vocabulary(path).decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def decoded(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the text of each row's ids (binary, as ``segment`` returns them). Null ids: null."""
    bounded_batches(rows.sparkSession)

    def of(ids: pd.Series) -> pd.Series:
        v = vocabulary(model)
        return pd.Series([None if x is None else v.decoded(np.frombuffer(x, v.id_type).astype(np.int64)).decode("utf-8", "replace") for x in ids], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(of, "string")(F.col(ids_col)))


def segment(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k rows per document: id, sample (from 1), ids (binary, unsigned little-endian, 16-bit where the vocabulary allows, else 32), log_prob, perturbed, log_inclusion, decoded_crc32.

    decoded_crc32 is that of the bytes the ids decode to, for a round trip: the text's own, but that a literal U+2581
    comes back as a space.
    The samples of a text are distinct segmentations, drawn without replacement in the order of their perturbed
    log-probabilities; log_inclusion is the log-probability that one exceeds the first value left out. Draws
    depend on the seed and the row's key only, not on partitions, so a lost task gives the same again and repeated
    rows agree. A text with fewer segmentations has fewer rows. Null and empty texts are the single piece of the
    leading space, once. A null id is a key like any other. Empty table: no rows.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for at in length_chunks(texts, CHUNK_CHARS):
                rows = []
                for name, found in zip([names[i] for i in at], top_k([texts[i] for i in at], [int(names[i] or 0) for i in at], v, k, seed)):
                    rows += [(name, i + 1, ids.astype(v.id_type).tobytes(), lp, g, incl, zlib.crc32(v.decoded(ids))) for i, (ids, lp, g, incl) in enumerate(found)]
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "decoded_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, sample int, ids binary, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    out = segment(table(spark, sf_dir, "documents"), default_model())
    return out.select(F.col("id").alias("doc_id"), "sample", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion", "decoded_crc32")
