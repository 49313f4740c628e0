"""Maximal periodic runs of words by the Ellert-Fischer method: Lyndon edges of two orders and their extensions."""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, table

#: A run has at least so many words, and at least two periods.
LEAST = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lyndon_edges(words: list, larger: bool, work: list | None = None) -> tuple[list[int], list[int]]:
    """For each position the start of the next smaller suffix, and how many words both suffixes share from there.

    The words between a position and its next smaller suffix are the longest Lyndon word that starts there. Words
    are only compared; ``larger`` turns their order round (a suffix that ends first is smaller in both orders). A
    position with no smaller suffix after it has the end, and shares nothing.

    The previous smaller suffixes are a chain of links, so position i walks i-1, its link, and so on. What two
    neighbours on the chain share and what i shares with the first of them decide what i shares with the second, but
    for a tie. At a tie, words up to the rightmost one matched so far are not compared again: inside the block
    matched last (it repeats ``shift`` words earlier) the answer is that of the earlier pair, and everything else
    goes on from the block's end. So each match moves the rightmost word on, and all matches together are at most as
    many as the words. work[0], if given, counts the comparisons of words that go on from a tie.
    """
    n = len(words)
    words = [*words, None]
    link, shared = [-1] * (n + 1), [0] * (n + 1)  # to the previous smaller suffix, and what both share
    nxt, common = [n] * n, [0] * n
    reach = block = shift = 0
    equal_to = 0  # end of the stretch of equal words around i
    looked = 0
    for i in range(1, n):
        j, same = i - 1, 0
        if words[j] == words[i]:
            if i >= equal_to:
                equal_to = i + 1
                while words[equal_to] == words[i]:
                    equal_to += 1
            same = equal_to - i
        while True:
            at = i + same
            if at < n and (words[j + same] > words[at]) is larger:
                link[i], shared[i] = j, same
                break
            nxt[j], common[j] = i, same  # the suffix at i is smaller
            above = link[j]
            if above < 0:
                break
            tie = shared[j]
            j = above
            if tie < same:
                link[i], shared[i] = j, tie
                break
            if tie > same:
                continue
            if j >= block and at < reach:
                a, b = j - shift, i - shift
                known = common[a] if nxt[a] == b else shared[b] if link[b] == a else same
                same = min(known, reach - i) if known > same else same
                if i + same < reach and known > tie:
                    continue
            begun = same
            while words[j + same] == words[i + same]:
                same += 1
            looked += same - begun + 1
            if i + same > reach:
                reach, block, shift = i + same, i, i - j
    if work is not None:
        work[0] += looked
    return nxt, common


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two periods, by start and period.

    A run has a Lyndon root in one of the two orders, followed by its repetition: an edge whose shared words to the
    right and left of it are a period or more. Of a run's roots only the leftmost is looked at; fewer words than the
    period stand before it, so those that it needs are compared as one slice.
    """
    found = set()
    for larger in (False, True):
        nxt, common = lyndon_edges(words, larger)
        for i, right in enumerate(common):
            if not right:
                continue
            c = nxt[i]
            period = c - i
            if right + 2 * period <= least:
                continue
            before = i - period
            if before >= 0 and nxt[before] == i and common[before] >= period:
                continue  # not the leftmost root
            need = period - right
            if need > 0 and (need > i or words[i - need : i] != words[c - need : c]):
                continue
            left = max(need, 0)
            while left < i and words[i - left - 1] == words[c - left - 1]:
                left += 1
            if left + period + right >= least:
                found.add((i - left, left + period + right, period))
    return sorted(found, key=lambda x: (x[0], x[2]))


def kept_words(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: what it holds after its first period."""
    if not found:
        return words
    out, done = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in found):
        if lo > done:
            out += words[done:lo]
        done = max(done, hi)
    return out + words[done:]


def rewound(words: list, key: int | None) -> list:
    """The words as the audit takes them: in a tenth of the documents, told by the checksum of their id, the end repeats.

    From word a on, word i is word a + (i - a) mod p of the text. A document without an id stays as it is.
    """
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * turns + words[a : a + rest]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, planted: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text as an array of (start, length, period), and its text without repetitions.

    ``planted``: texts are taken as ``rewound``. One row for each row, each by its own text, so repeated rows and ids
    give repeated results; no shuffle. A null text has no words, no runs and collapses to the empty text, as does one
    of white space. Words are parted by the six ASCII white-space characters only. Columns of other names are not read.
    A text's words are held at once, at about 250 bytes a word in a worker; time is linear in its words.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            counts, all_runs, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORD.findall(text.as_py() or "")
                words = rewound(words, key) if planted else words
                found = runs(words, least)
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, run_type), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, f"id {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), planted=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("top", longest)
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.expr("1000 * -top.l div top.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
