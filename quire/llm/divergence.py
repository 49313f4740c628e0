"""Source divergence audit: how far the word use of each source of a language lies from the others and from the language."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import Spool, bounded_batches, table

#: Documents of a language that a term has to occur in, and terms reported for a source.
DOCUMENTS, REPORTED = 30, 50
#: Shares are whole numbers of so many parts; each count is raised by SMOOTH.
PARTS, SMOOTH = 1_000_000_000, 5
#: Terms of a bucket and sources of a block: what a task of the pair comparison holds.
BUCKET_TERMS, BLOCK_SOURCES = 512, 256


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a term, and its lower case (A-Z only). Bytes beyond ASCII belong to terms."""
    b = np.arange(256)
    upper = (b >= 0x41) & (b <= 0x5A)
    inside = upper | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    return inside, np.where(upper, b + 0x20, b).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, text of each) of the terms of texts that lie one behind another in a buffer."""
    inside, lower = byte_tables()
    mask = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = mask[edges]  # a term ends with its text
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = mask
    stops[:-1] &= ~mask
    stops[edges] |= mask[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    return lower[data], start, end, np.searchsorted(offsets, start, side="right") - 1


def groups(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): slices of equal bytes. Hashes propose, the bytes decide."""
    whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(whole[s:e]) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = end - start, first[group]
    wrong = size != size[like]
    same = np.flatnonzero(~wrong & (like != np.arange(len(start))))
    if len(same):
        at = np.repeat(np.concatenate(([0], np.cumsum(size[same])[:-1])), size[same])
        step = np.arange(len(at)) - at
        differ = data[np.repeat(start[same], size[same]) + step] != data[np.repeat(start[like[same]], size[same]) + step]
        wrong[same] = np.add.reduceat(differ, np.concatenate(([0], np.cumsum(size[same])[:-1]))) > 0
    if wrong.any():  # two terms of one hash: by their bytes
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(wrong).tolist():
            term = whole[start[k] : end[k]]
            if term not in known:
                known[term] = len(first)
                first = np.append(first, k)
            group[k] = known[term]
    return group, first


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text); a row without a term for each (lang, source)."""
    keys = pd.DataFrame({"lang": batch.column(0).to_pandas(), "source": batch.column(1).to_pandas()})
    group_of, named = keys.groupby(["lang", "source"], sort=False).ngroup().to_numpy(), keys.drop_duplicates()
    texts = batch.column(2).cast(pa.string())
    sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[sizes[0] : sizes[-1]] if raw else np.zeros(0, np.uint8)
    data, start, end, doc = tokens(data, sizes - sizes[0])
    term, first = groups(data, start, end)
    t = max(len(first), 1)
    at, n = np.unique(group_of[doc] * t + term, return_counts=True)
    in_docs = np.unique(doc * t + term)
    docs = np.bincount(np.searchsorted(at, group_of[in_docs // t] * t + in_docs % t), minlength=len(at))
    whole = data.tobytes()
    words = [whole[start[k] : end[k]].decode("utf-8", "replace") for k in first.tolist()]
    pick = np.concatenate([at // t, np.arange(len(named))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(named["lang"].to_numpy()[pick], pa.string()), pa.array(named["source"].to_numpy()[pick], pa.string()),
            pa.array([words[k] for k in (at % t).tolist()] + [None] * len(named), pa.string()),
            pa.array(np.concatenate([n, np.zeros(len(named), np.int64)]), pa.int64()), pa.array(np.concatenate([docs, np.zeros(len(named), np.int64)]), pa.int64()),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it; a row without a term for each (lang, source)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(lambda batches: (_counted(b) for b in batches if b.num_rows), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def distances(indptr: np.ndarray, cols: np.ndarray, data: np.ndarray, base: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
    """sum over ``width`` columns of |a - b| between each of ``rows`` and every row of a CSR matrix whose absent entries are ``base`` of the row.

    With the row a laid out over all columns, reduceat over the entries of the rows b gives what they have, less what
    they would give were they absent; the sum over all columns against a constant comes from a's sorted values. Exact
    in 64-bit integers.
    """
    out = np.zeros((len(rows), len(base)), np.int64)
    filled = np.flatnonzero(np.diff(indptr))
    of_row = np.repeat(base, np.diff(indptr))
    for k, r in enumerate(rows.tolist()):
        a = np.full(width, base[r], np.int64)
        a[cols[indptr[r] : indptr[r + 1]]] = data[indptr[r] : indptr[r + 1]]
        if len(data):
            entry = np.abs(a[cols] - data) - np.abs(a[cols] - of_row)
            out[k, filled] = np.add.reduceat(entry, indptr[filled])
        ordered = np.sort(a)
        sums = np.concatenate(([0], np.cumsum(ordered)))
        below = np.searchsorted(ordered, base)
        out[k] += base * below - sums[below] + (sums[-1] - sums[below]) - base * (width - below)
    return out


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of terms and two blocks of sources: (lang, a, b, value, seen) for each pair a < b of theirs."""
    lang, left, right = rows["lang"].iloc[0], int(rows["left"].iloc[0]), int(rows["right"].iloc[0])
    heads = rows[rows["term"].isna()].sort_values("s")
    sources, base = heads["s"].to_numpy(), heads["p"].to_numpy(np.int64)
    body = rows[rows["term"].notna()]
    col, names = pd.factorize(body["term"])
    row = np.searchsorted(sources, body["s"].to_numpy())
    order = np.lexsort((col, row))
    indptr = np.searchsorted(row[order], np.arange(len(sources) + 1))
    block = sources // BLOCK_SOURCES
    mine = np.flatnonzero(block == left)
    d = distances(indptr, col[order], body["p"].to_numpy(np.int64)[order], base, len(names), mine)
    wanted = (sources[mine][:, None] < sources[None, :]) & (block == right)[None, :]
    i, j = np.nonzero(wanted)
    return pd.DataFrame({"lang": lang, "a": sources[mine][i], "b": sources[j], "value": d[i, j], "seen": len(names)})


def audit(docs: DataFrame, documents: int = DOCUMENTS, reported: int = REPORTED) -> DataFrame:
    """(lang, source, part, item, value, rank), value descending within a group and part, ties by the item's UTF-8 bytes.

    Part ``pair``: each other source of the language, with the sum over its kept terms of the shares' distances. Part
    ``term``: the first ``reported`` terms that a source uses more than its language. A language keeps the terms of at least
    ``documents`` of its rows; a share is 1 + floor(PARTS * (n + SMOOTH) / (N + SMOOTH * V)). Null lang, source and text
    are empty strings; an empty string is a group like any other. A group without terms has its pairs (0 where the
    language keeps no term) and no term rows. Repeated rows count each. Other columns are not read. Empty table: no rows.

    Terms are counted inside a task's batches and merged before the shuffle, so a frequent term or a source with most
    rows is a few rows a task. Pairs are compared by tiles: a bucket of terms with two blocks of sources, at most
    about BUCKET_TERMS * 2 * BLOCK_SOURCES shares in a task; a language's pairs are what the result holds.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "divergence")
    counted = spool.put(term_counts(docs))
    of_term = W.partitionBy("lang", "term")
    seen = counted.filter("term is not null").withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    one = F.row_number().over(of_term.orderBy("source")) == 1
    kept = spool.put(seen.withColumn("one", one).filter(F.col("lang_docs") >= documents).select("lang", "source", "term", "n", "lang_n", "one"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("one").cast("long")).alias("terms"))
    heads = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0)
    of_lang = W.partitionBy("lang")
    heads = heads.withColumn("v", F.sum("terms").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang)).withColumn("s", F.row_number().over(of_lang.orderBy("source")) - 1)
    heads = spool.put(heads.withColumn("last_s", F.max("s").over(of_lang)).drop("terms"))

    def share(n, total):
        """Exact at any count: in decimals, as counts times PARTS pass 64 bits."""
        whole = (n.cast("decimal(20,0)") + F.lit(SMOOTH)) * F.lit(PARTS).cast("decimal(10,0)")
        below = total.cast("decimal(20,0)") + F.col("v").cast("decimal(16,0)") * F.lit(SMOOTH)
        return F.call_function("div", whole, F.nullif(below, F.lit(0).cast("decimal(1,0)"))).cast("long") + 1

    shares = kept.join(heads, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))
    over = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"))).filter("p > q")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= reported)

    tiles = F.expr(f"transform(sequence(0, last_s div {BLOCK_SOURCES}), b -> struct(least(b, s div {BLOCK_SOURCES}) as left, greatest(b, s div {BLOCK_SOURCES}) as right))")
    buckets = F.expr(f"cast(v div {BUCKET_TERMS} as int)")  # the last bucket's number
    body = shares.select("lang", "s", "term", "p", F.pmod(F.xxhash64("term"), buckets + 1).cast("int").alias("bucket"), F.explode(tiles).alias("t"))
    empty = heads.filter("v > 0").withColumn("p", share(F.lit(0), F.col("total"))).withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets)))
    empty = empty.select("lang", "s", F.lit(None).cast("string").alias("term"), "p", "bucket", F.explode(tiles).alias("t"))
    parts = body.unionByName(empty).select("lang", F.col("s").cast("long").alias("s"), "term", "p", "bucket", F.col("t.left").cast("long").alias("left"), F.col("t.right").cast("long").alias("right"))
    sums = parts.groupBy("lang", "bucket", "left", "right").applyInPandas(_compared, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    named = heads.select("lang", F.col("s").cast("long").alias("s"), "source", "v", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"))).alias("base"))
    a = named.select("lang", F.col("s").alias("a"), F.col("source").alias("source_a"), F.col("base").alias("base_a"), "v")
    b = named.select("lang", F.col("s").alias("b"), F.col("source").alias("source_b"), F.col("base").alias("base_b"))
    # terms of the language that no source of a tile has are the same distance apart in each
    pairs = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).withColumn("value", F.col("value") + (F.col("v") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b")))
    alone = a.filter("v = 0").join(b, "lang").filter("a < b").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source_a", "source_b", "value").unionByName(alone.select("lang", "source_a", "source_b", "value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(best))
    return both.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


#: The same by brute force.
ORACLE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {DOCUMENTS}),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    full_n AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    p AS (SELECT lang, source, term, n, 1 + ({PARTS}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * count(*) OVER (PARTITION BY lang, source)) AS p FROM full_n),
    ln AS (SELECT lang, term, sum(n) AS n FROM full_n GROUP BY ALL),
    q AS (SELECT lang, term, 1 + ({PARTS}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * count(*) OVER (PARTITION BY lang)) AS q FROM ln),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) x ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source),
    term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {REPORTED}
"""
