"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals aggregate to a score."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool, Words, bounded_batches, bucket_of, length_chunks, range_hashes, share

#: Labelled rows of each class that are used for fitting, at most about.
TRAIN_ROWS = 6000
#: Hashed feature weights.
BUCKETS = 1 << 18
#: A token feature marks its tokens as toxic if its document counts by label are this unlikely by chance
#: (log-likelihood ratio; the first level that any feature reaches) and this share of its documents is labelled toxic.
EVIDENCE, PURITY = (24.0, 12.0, 6.0), 0.9
#: Prefix lengths that are token features besides the word itself.
PREFIXES = (3, 4, 5)
#: Words on each side of a tagged word that belong to its training sequence.
CONTEXT = 6
#: Words added to a text's length in the share of toxic words, so that a few words alone don't make a high one.
PAD = 50
#: Training sequences at most (a hash sample beyond), and features that mark tokens at most (those of the most documents beyond).
SEQUENCES, MARKS = 40_000, 100_000


def features(w: Words) -> np.ndarray:
    """(words, 1 + len(PREFIXES)) 64-bit hashes: of the word, and of its prefixes if it is longer than them."""
    local = w.chars.astype(np.uint64)
    whole = range_hashes(local, w.start, w.end)
    out = [whole]
    for n in PREFIXES:
        end = np.minimum(w.start + n, w.end)
        h = range_hashes(local, w.start, end) ^ np.uint64(n << 56 | 1)
        out.append(np.where(w.end - w.start > n, h, whole))
    return np.stack(out, 1)


@dataclass
class Model:
    """weights of hashed features for the tag toxic (the other tag has none); bias; trans[from, to]; calibration."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros(0, np.float64)
        f = (features(w) & np.uint64(BUCKETS - 1)).astype(np.int64)
        return self.weights[f].sum(1).astype(np.float64) + self.bias


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each word by forward-backward. first[d]:first[d+1] are the words of text d.

    With two tags a message is one log-ratio, so all texts advance together, a word at a time.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    (oo, ot), (to, tt) = np.exp(trans)
    forward, backward = np.empty(len(emit)), np.empty(len(emit))
    last = start + size - 1
    for into, begin, sign, (a, b, c, d) in ((forward, start, 1, (tt, ot, to, oo)), (backward, last, -1, (tt, to, ot, oo))):
        r = np.zeros(len(size))
        for t in range(longest):
            n = active[t]
            at = begin[:n] + sign * t
            if t:
                x = np.exp(np.minimum(r[:n], 500.0))
                r[:n] = np.log((x * a + b) / (x * c + d))
            into[at] = r[:n]
            r[:n] += emit[at]
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(forward + backward + emit)))


def _fit_crf(seqs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent (AdaGrad) on the conditional likelihood of padded tag sequences."""
    long = max(len(y) for _, y in seqs)
    n, k = len(seqs), seqs[0][0].shape[1]
    f, y, on = np.zeros((n, long, k), np.int64), np.zeros((n, long), np.int64), np.zeros((n, long), bool)
    for i, (a, b) in enumerate(seqs):
        f[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
    used, slot = np.unique(f, return_inverse=True)
    slot = slot.reshape(f.shape)
    wt, bias, trans = np.zeros(len(used)), -2.0, np.zeros((2, 2))
    g_w, g_b, g_t = np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    pair_on = on[:, 1:] & on[:, :-1]
    for _ in range(rounds):
        e = np.zeros((n, long, 2))
        e[..., 1] = wt[slot].sum(2) + bias
        fw, bw = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fw[:, 0] = e[:, 0]
        for t in range(1, long):
            fw[:, t] = np.logaddexp(fw[:, t - 1, :1] + trans[0], fw[:, t - 1, 1:] + trans[1]) + e[:, t]
            fw[:, t] = np.where(on[:, t, None], fw[:, t], fw[:, t - 1])
        z = np.logaddexp(fw[:, -1, 0], fw[:, -1, 1])
        for t in range(long - 2, -1, -1):
            x = bw[:, t + 1] + e[:, t + 1]
            back = np.logaddexp(trans[:, 0] + x[:, :1], trans[:, 1] + x[:, 1:])
            bw[:, t] = np.where(on[:, t + 1, None], back, 0)
        p = np.exp(fw[..., 1] + bw[..., 1] - z[:, None])
        d = np.where(on, y - p, 0.0)
        grad = np.bincount(slot.ravel(), np.repeat(d.ravel(), k), len(used)) / n - 1e-5 * wt
        both = fw[:, :-1, :, None] + trans + (e + bw)[:, 1:, None, :] - z[:, None, None, None]
        expect = np.where(pair_on[..., None, None], np.exp(np.minimum(both, 0)), 0).sum((0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair_on], y[:, 1:][pair_on]), 1)
        g_t += ((seen - expect) / n) ** 2
        trans = trans + 0.2 * ((seen - expect) / n - 1e-4 * trans) / np.sqrt(g_t)
        g_w += grad**2
        wt += 0.5 * grad / np.sqrt(g_w)
        g_b += (d.sum() / n) ** 2
        bias += 0.2 * d.sum() / n / np.sqrt(g_b)
    full = np.zeros(BUCKETS, np.float32)
    full[used] = wt
    return full, float(bias), trans


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 3): the largest marginal as a clipped log-odds; logs of the expected toxic words, plus one, and of their share."""
    out = np.zeros((len(first) - 1, 3))
    out[:, 0] = -12
    out[:, 2] = -8
    some = np.flatnonzero(np.diff(first))
    if len(some):
        top = np.maximum.reduceat(p, first[some])
        out[some, 0] = np.log(np.clip(top, 6e-6, 1 - 6e-6) / (1 - np.clip(top, 6e-6, 1 - 6e-6)))
        total = np.add.reduceat(p, first[some])
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.log(np.clip(total / (np.diff(first)[some] + PAD), math.exp(-8), 1))
    return out


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge, with the sample's weights w."""
    a = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = w / w.sum()
    c = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-5 * np.eye(len(c))
        c = c + np.linalg.solve(h, a.T @ (w * (y - p)) - 1e-5 * c)
    return c


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a hash sample of about ``rows`` labelled rows of each class (twice that of the clean), or all, if fewer.

    The sample is drawn from the labels, so only its ids, at most about 3 * rows, meet the texts (as a broadcast),
    and its texts are written to the shared folder once. An id with labels that disagree is left out.

    The labels are of documents. A first pass counts, for each token feature, the documents of either class that
    hold it; features of which an unlikely share is toxic tag their tokens. A second pass cuts training sequences
    around such tokens, of clean documents too, for the random field. A third scores the sample for calibration.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    agreed = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("z")).filter("y = z").select("id", "y")
    counts = {int(r[0]): r[1] for r in agreed.groupBy("y").count().collect()}
    none = Model(np.zeros(BUCKETS, np.float32), -10.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))]))  # the rate of the label, for every text
    if not counts.get(0) or not counts.get(1):
        return none
    part = F.when(F.col("y") == 1, rows / counts[1]).otherwise(2 * rows / counts[0])
    draw = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1_000_000)) / 1e6
    chosen = F.broadcast(agreed.filter(draw < part))  # about 3 * rows ids at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = Spool(spark, "labelled").put(texts.join(chosen, "id").select("y", "text"))

    def tally(batches):
        import pyarrow as pa

        for b in batches:
            labels, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            parts = []
            for rows in length_chunks(texts):
                w = Words([texts[i] for i in rows])
                if len(w.start):
                    f = features(w)
                    doc = np.repeat(w.doc, f.shape[1]).astype(np.uint64)
                    pair = np.unique(np.stack((f.ravel(), doc)), axis=1)
                    parts.append((pair[0], labels[rows][pair[1].astype(np.int64)]))
            if parts:
                f, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                keys, at = np.unique(f, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, y).astype(np.int64)), pa.array(np.bincount(at, 1 - y).astype(np.int64))], names=["f", "bad", "good"])

    n1, n0 = (r := sample.groupBy().agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first())[0], r[1]
    base = n1 / max(1, n0 + n1)
    tall = sample.mapInArrow(tally, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = F.col("bad") / (F.col("bad") + F.col("good"))
    ratio = 2 * (F.col("bad") * F.log(rate / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    strong = tall.filter((F.col("bad") >= 3) & (rate >= PURITY) & (ratio >= EVIDENCE[-1])).orderBy(F.desc("bad"), "f").limit(MARKS)
    seen = strong.select("f", ratio.alias("ratio")).collect()  # from a bounded sample
    level = next((e for e in EVIDENCE if any(x.ratio >= e for x in seen)), 0.0)
    marks = np.array([x.f for x in seen if x.ratio >= level], np.int64).view(np.uint64)
    marks.sort()
    if not len(marks):
        return none

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            labels, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            out = []
            for rows in length_chunks(texts):
                w = Words([texts[i] for i in rows])
                if not len(w.start):
                    continue
                f = features(w)
                near = np.isin(f, marks).any(1)
                hit = near & (labels[rows][w.doc] == 1)
                small = (f & np.uint64(BUCKETS - 1)).astype(np.int32)
                for d in range(len(rows)):
                    a, e = int(w.first[d]), int(w.first[d + 1])
                    if a == e:
                        continue
                    spots = (np.flatnonzero(near[a:e]) + a).tolist()  # of a clean text too: they teach what isn't toxic
                    for c in [*spots, a + int(f[a, 0] % np.uint64(e - a))]:  # and one place that any text has
                        x, z = max(a, c - CONTEXT), min(e, c + CONTEXT + 1)
                        out.append((small[x:z].tobytes(), hit[x:z].astype(np.int8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out])], names=["f", "y"])

    width = 1 + len(PREFIXES)
    got = sample.mapInArrow(cut, "f binary, y binary").orderBy(F.xxhash64("f", "y"), "f", "y").limit(SEQUENCES).collect()
    seqs = [(np.frombuffer(r.f, np.int32).reshape(-1, width).astype(np.int64), np.frombuffer(r.y, np.int8).astype(np.int64)) for r in got]
    model = Model(*_fit_crf(seqs), np.zeros(4))
    shared = share(spark, model)

    def score(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.zeros((len(texts), 3))
            for rows in length_chunks(texts):
                w = Words([texts[i] for i in rows])
                x[rows] = _summary(marginals(shared.value.emissions(w), w.first, shared.value.trans), w.first)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(3))], names=["y", "top", "sum", "share"])

    seen = sample.mapInArrow(score, "y int, top double, sum double, share double").toPandas()
    weight = np.where(seen.y == 1, max(1.0, counts[1] / rows), max(1.0, counts[0] / (2 * rows)))  # back to the rates before sampling
    model.calibration = _calibrate(seen[["top", "sum", "share"]].to_numpy(float), seen.y.to_numpy(), weight)
    return model


def _score(texts: list, m: Model) -> tuple[list[float], list[list[dict]]]:
    scores = np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    for rows in length_chunks(texts):
        w = Words([texts[i] or "" for i in rows])
        p = marginals(m.emissions(w), w.first, m.trans)
        x = np.concatenate((_summary(p, w.first), np.ones((len(rows), 1))), 1) @ m.calibration
        scores[rows] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        edge = np.diff(np.concatenate(([False], p >= 0.5, [False])).astype(np.int8))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            while i < j:  # a run may pass the end of a text
                d = int(w.doc[i])
                e = min(j, int(w.first[d + 1]))
                spans[rows[d]].append({"start": int(w.start[i] - w.base[d]), "end": int(w.end[e - 1] - w.base[d]), "p": float(p[i:e].max())})
                i = e
    return scores.tolist(), spans


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> struct of score and spans."""
    shared = share(spark, model)  # fixed size: BUCKETS floats

    def run(texts: pd.Series) -> pd.DataFrame:
        scores, spans = _score(texts.tolist(), shared.value)
        return pd.DataFrame({"score": pd.Series(scores, dtype=float), "spans": pd.Series(spans, dtype=object)})

    bounded_batches(spark)
    return F.pandas_udf(run, "score double, spans array<struct<start:long,end:long,p:double>>")


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, spans.

    score (0 to 1) is a calibrated sum of the tag marginals of all words of the text; spans are the (start, end,
    p) runs of words whose marginal is at least a half, as character offsets in the text. Null texts and texts
    without letters get the score of a text without a toxic word, and no spans. Each row is judged alone. Empty
    table: no rows. Only the id and the text are read.
    """
    score = scorer(docs.sparkSession, model)
    return docs.select(F.col(id_col).alias("id"), score(F.col(text_col)).alias("found")).select("id", "found.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(bucket_of(F.col("doc_id"), 5) != 0))
    out = detect(docs, model)
    return out.select(F.col("id").alias("doc_id"), (bucket_of(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.to_json(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
