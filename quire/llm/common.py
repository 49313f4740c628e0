"""What the operators share: table access, the shared work folder, vectorised text helpers."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to a Python worker; keeps a batch of long texts within a small worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A key that holds more than this part of all rows is hot.
HOT_SHARE = 1000
#: Bytes of a table that is dealt to all cores at once.
SMALL_TABLE = 64 << 20
#: Characters of the texts that are worked on together in a worker.
CHUNK_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores, and small, is dealt to all of them, as a file may be one row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_TABLE
    return df.repartition(cores, df.columns[0]) if small and len(df.inputFiles()) < cores else df


def bounded_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and bytes; texts are wide, so the default of 10,000 rows needs much memory.

    All operators set the same bounds, so a plan that runs later keeps them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local folder is used in local mode (tests); on a cluster it is an error, as no
    machine-local folder would do.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quire-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


_HELD: list = []


def share(spark: SparkSession, value):
    """A broadcast that ``release`` takes back."""
    made = spark.sparkContext.broadcast(value)
    _HELD.append(lambda: made.unpersist())
    return made


def release(since: int = 0) -> int:
    """Takes back the broadcasts and deletes the spooled tables made since a mark; the number of those left is a mark.

    Only for what nothing reads any more: a caller that has written an operator's result.
    """
    while len(_HELD) > since:
        _HELD.pop()()
    return len(_HELD)


def mark() -> int:
    return len(_HELD)


class Spool:
    """Intermediate tables in the shared folder: each cuts the lineage and survives a lost executor.

    They stay until ``release``, as the DataFrames that read them are lazy.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        _HELD.append(self.clear)
        self.base = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
        self.count = itertools.count()

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{next(self.count)}"
        df.write.parquet(path)
        self.spark._jvm.java.lang.System.gc()  # lets Spark delete the shuffles behind it, which nothing reads any more
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.spool_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        if path := getattr(df, "spool_path", None):
            self._delete(path)

    def clear(self) -> None:
        """Deletes all its tables."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(column, modulus: int):
    """crc32 of the decimal text of a key, modulo a small number: the folds of the learned operators. A null key has -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1))


def join_by_key(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with a table of one row for each key, whose ``count`` is the number of rows with that key.

    Keys of more than a HOT_SHARE-th of all rows, so at most HOT_SHARE, are broadcast: no task gets all rows of one.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    hot = named.filter(F.col(count) > total / HOT_SHARE).drop(count)
    rest = named.filter(F.col(count) <= total / HOT_SHARE).drop(count)
    if not hot.limit(1).count():
        return rows.join(rest, key)
    many = rows.join(F.broadcast(hot), key)
    return many.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key).select(many.columns))


_LETTER = None
_LOWER = None


def lower_table() -> np.ndarray:
    """The lower case of each code point that has a single one, so places in a text stay what they are."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i).lower()
            if len(c) == 1:
                _LOWER[i] = ord(c)
    return _LOWER


def letter_table() -> np.ndarray:
    """True at each code point that is a letter; built once in a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Words:
    """The letter runs of a batch of texts, as flat arrays.

    chars: code points of the texts, each in lower case, one separator after each; start, end: of each word in chars;
    doc: the text of each word; first: index of each text's first word, with the total at the end; base: where
    each text starts in chars.
    """

    def __init__(self, texts: list[str]):
        self.chars = lower_table()[code_points("\n".join(texts) + "\n")]
        is_letter = letter_table()[self.chars]
        step = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(size)))
        self.first = np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def length_chunks(texts: list, limit: int = CHUNK_CHARS):
    """Lists of indices of texts with about so many characters together (a longer text is alone), shorter texts first.

    Steps over the words of all texts of a chunk at once take as many turns as its longest has words, so texts of
    like length go together.
    """
    out, total = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
        n = len(texts[i] or "")
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(i)
        total += n
    if out:
        yield out


_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS = out[0], out[1]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over mixed values, modulo 2**64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * _powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of values[start:end] for many ranges at once; sums: prefix_sums(values), if at hand."""
    down = _powers(len(values) + 1)[1]
    sums = prefix_sums(values) if sums is None else sums
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def script_ranges() -> list[tuple[int, int, int]]:
    """(first, last, script) code point ranges of the common scripts."""
    # Unicode block limits.
    return [
        (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2), (0x0400, 0x052F, 3),
        (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x0900, 0x097F, 7),
        (0x0980, 0x09FF, 8), (0x0A00, 0x0DFF, 9), (0x0E00, 0x0E7F, 10), (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12),
        (0xAC00, 0xD7AF, 12), (0x3040, 0x30FF, 13), (0x3400, 0x9FFF, 14), (0x20000, 0x3134F, 14),
    ]


def script_of(points: np.ndarray) -> np.ndarray:
    """The script number of each code point; 0 for any other."""
    out = np.zeros(len(points), np.int8)
    for lo, hi, script in script_ranges():
        out[(points >= lo) & (points <= hi)] = script
    return out
