"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Words, bounded_batches, bucket_of, length_chunks, mix, script_of, share

#: Training rows per language, at most about; the model is fitted on this many whole texts.
TRAIN_ROWS = 2000
#: Languages that are learned at most: those of the most rows. Bounds the model.
LANGUAGES = 512
BUCKETS = 1 << 16
#: Log-probability lost by changing the language between two words.
SWITCH = 12.0
EDGE = 1  # a code point that no letter has: the border of a word


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each 2-gram, bucket of each 3-gram) per letter: the letters of a word with one border each side."""
    inside = np.zeros(len(w.chars) + 1, np.int32)
    np.add.at(inside, w.start, 1)
    np.subtract.at(inside, w.end, 1)
    letter = np.cumsum(inside[:-1]) > 0
    c = np.where(letter, w.chars, EDGE).astype(np.uint64)
    before = np.concatenate(([EDGE], c[:-1])).astype(np.uint64)
    after = np.concatenate((c[1:], [EDGE])).astype(np.uint64)
    mask = np.uint64(BUCKETS - 1)
    two = mix(before << np.uint64(21) | c) & mask
    three = mix(before << np.uint64(42) | c << np.uint64(21) | after | np.uint64(1 << 63)) & mask
    return two.astype(np.int64), three.astype(np.int64)


@dataclass
class Model:
    """langs; table: log-probability of each gram bucket by language; scripts: which languages use a script."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        """(words, languages) log-likelihoods; languages that don't use the word's script are put out of reach."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        two, three = _grams(w)
        out = np.empty((len(w.start), len(self.langs)), np.float32)
        cuts = np.stack((w.start, w.end), 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(two) else cuts
        for k in range(len(self.langs)):
            col = self.table[:, k]
            out[:, k] = np.add.reduceat(col[two] + col[three], cuts)[::2]
        allowed = self.scripts[script_of(w.chars[w.start])]
        allowed |= ~allowed.any(1, keepdims=True)
        out[~allowed] -= 1e4
        return out


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> Model:
    """Gram counts by language over a hash sample of about ``rows`` rows of each language (all, if fewer), of at most LANGUAGES languages."""
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((16, 0), bool))
    part = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(rows / counts[lang]))])
    draw = F.pmod(F.xxhash64(id_col, F.lit(6)), F.lit(1_000_000)) / 1e6
    sample = known.filter(draw < part[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def tally(batches):
        import pyarrow as pa

        index = {x: k for k, x in enumerate(langs)}
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), 16), np.int64)
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for rows in length_chunks(texts):
                w = Words([texts[i] for i in rows])
                if not len(w.start):
                    continue
                two, three = _grams(w)
                lang = np.array([index[names[i]] for i in rows])
                of = np.repeat(lang[w.doc], w.end - w.start)
                at = np.arange(len(of)) + np.repeat(w.start - np.concatenate(([0], np.cumsum(w.end - w.start)[:-1])), w.end - w.start)
                for g in (two, three):
                    grams += np.bincount(of * BUCKETS + g[at], minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(lang[w.doc] * 16 + script_of(w.chars[w.start]), minlength=scripts.size).reshape(scripts.shape)
        both = np.concatenate((grams, scripts), 1)
        k, g = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(g), pa.array(both[k, g])], names=["lang", "slot", "n"])

    bounded_batches(docs.sparkSession)
    found = sample.mapInArrow(tally, "lang long, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x (BUCKETS + 16) at most
    both = np.zeros((len(langs), BUCKETS + 16))
    both[found.lang.to_numpy(np.int64), found.slot.to_numpy(np.int64)] = found.n.to_numpy(float)
    grams, scripts = both[:, :BUCKETS], both[:, BUCKETS:]
    prob = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)
    return Model(langs, np.log(prob).T.astype(np.float32), (scripts > 0.001 * np.maximum(scripts.sum(1, keepdims=True), 1)).T)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word. first[d]:first[d+1] are the words of text d; all texts advance together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    n, langs = scores.shape
    best_before = np.zeros(n, np.int16)
    switched = np.zeros((n, langs), bool)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    v = np.zeros((len(size), langs), np.float32)
    for t in range(longest):
        a = active[t]
        at = start[:a] + t
        if t:
            top = v[:a].argmax(1)
            floor = np.take_along_axis(v[:a], top[:, None], 1) - switch
            best_before[at] = top
            low = v[:a] < floor
            switched[at] = low
            v[:a] = np.where(low, floor, v[:a]) - floor
        v[:a] += scores[at]
    out = np.zeros(n, np.int16)
    state = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        out[at] = state[:a]
        state[:a] = np.where(switched[at, state[:a]], best_before[at], state[:a])
    return out


def _label(texts: list, model: Model, switch: float):
    """(label, score, spans) of each text; spans are (first char, end char, language) runs of words."""
    out: list = [("und", 0.0, [])] * len(texts)
    for rows in length_chunks(texts):
        w = Words([texts[i] or "" for i in rows])
        tags = viterbi(model.word_scores(w), w.first, switch) if model.langs else np.zeros(len(w.start), np.int16)
        size = w.end - w.start
        for d, i in enumerate(rows):
            a, b = w.first[d], w.first[d + 1]
            if a == b or not model.langs:
                continue
            share = np.bincount(tags[a:b], size[a:b], len(model.langs))
            k = int(share.argmax())
            cut = np.flatnonzero(np.diff(tags[a:b])) + 1
            left, right = np.concatenate(([0], cut)) + a, np.concatenate((cut, [b - a])) + a - 1
            spans = list(zip((w.start[left] - w.base[d]).tolist(), (w.end[right] - w.base[d]).tolist(), [model.langs[x] for x in tags[left]]))
            out[i] = (model.langs[k], float(share[k] / share.sum()), spans)
    return out


def labeller(spark: SparkSession, model: Model, switch: float = SWITCH):
    """A column function: text -> struct of lang_pred, score and spans."""
    shared = share(spark, model)  # fixed size: at most LANGUAGES x BUCKETS floats

    def run(texts: pd.Series) -> pd.DataFrame:
        found = _label(texts.tolist(), shared.value, switch)
        spans = [[{"start": s, "end": e, "lang": g} for s, e, g in x[2]] for x in found]
        return pd.DataFrame({"lang_pred": pd.Series([x[0] for x in found], dtype=object), "score": pd.Series([x[1] for x in found], dtype=float), "spans": pd.Series(spans, dtype=object)})

    bounded_batches(spark)
    return F.pandas_udf(run, "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per document: id, lang_pred, score, spans.

    lang_pred is the language of most letters on the Viterbi path of the whole text, score its share of the
    letters, spans its runs as (start, end, lang) over the characters of the text. Null texts, texts
    without letters and an empty model give ``und``, 0 and no spans. Each row is judged alone: repeated rows get
    equal answers. Empty table: no rows. Only the id and the text are read.
    """
    label = labeller(docs.sparkSession, model, switch)
    return docs.select(F.col(id_col).alias("id"), label(F.col(text_col)).alias("found")).select("id", "found.*")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(bucket_of(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), (bucket_of(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))
