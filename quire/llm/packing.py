"""Cost-balanced packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import bounded_batches

LENGTH = 1024
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Tokens held and packed together in a task; bounds its memory. Each pool leaves at most one sequence unfilled.
POOL = 2_000_000
SEPARATOR = 0
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_ENCODER = {}


def encoder(path: str):
    """text -> ids of a byte-level BPE vocabulary file, as ``Tokenizer.encode(text, add_special_tokens=False)``.

    The rank file of the same name holds the same vocabulary for a faster library that gives the same ids; it is
    used where it exists, but for texts that hold the literal of a special token.
    """
    if path not in _ENCODER:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        try:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            fast = None

        def encode(text: str) -> list[int]:
            if fast is None or any(s in text for s in special):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODER[path] = encode
    return _ENCODER[path]


class Open:
    """The sequences with room, by room: finds the cheapest with room for a piece among all of them.

    A heap of (cost, sequence) for each room from 1 to the length, and a tree of minima over the rooms.
    """

    def __init__(self, rooms: list[int], length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.size)]
        self.best: list = [(math.inf, -1)] * (2 * self.size)
        for s, r in enumerate(rooms):
            self.heaps[r].append((0.0, s))  # in order, so a heap already
        for r in set(rooms):
            self._settle(r)

    def _settle(self, room: int) -> None:
        i = room + self.size
        self.best[i] = self.heaps[room][0] if self.heaps[room] else (math.inf, -1)
        while i := i >> 1:
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def take(self, need: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with room for ``need`` tokens, taken out; None if there is none."""
        low, high, found = need + self.size, 2 * self.size, None
        while low < high:
            if low & 1:
                found = low if found is None or self.best[low] < self.best[found] else found
                low += 1
            low, high = low >> 1, high >> 1
        if found is None or self.best[found][1] < 0:
            return None
        while found < self.size:
            found = 2 * found + (self.best[2 * found + 1] < self.best[2 * found])
        room = found - self.size
        c, s = heapq.heappop(self.heaps[room])
        self._settle(room)
        return c, s, room

    def put(self, cost: float, s: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, s))
            self._settle(room)


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token lies in one piece.

    Whole sequences are cut off the front of documents that exceed one. What is left goes, longest first, to the
    sequence of the lowest estimated cost among all those with room for it. The number of sequences is the smallest
    that holds the tokens; a document that finds no room whole is cut over the cheapest sequences with any room, so
    all but the last one come out full.
    """
    out, rest, seq = [], [], 0
    for d, n in enumerate(sizes):
        at = 0
        while n - at >= length:
            out.append((d, at, length, seq, 0))
            at += length
            seq += 1
        if n > at:
            rest.append((n - at, d, at))
    total = sum(n for n, _, _ in rest)
    if not total:
        return out
    opened = -(-total // length)
    rooms = [length] * opened
    rooms[-1] = total - length * (opened - 1)
    free = Open(rooms, length)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(opened)]
    cut = []
    for whole in (True, False):
        for n, d, at in sorted(rest, key=lambda x: (-x[0], x[1])) if whole else cut:
            if whole and (found := free.take(n)) is None:
                cut.append((n, d, at))
                continue
            while n:
                c, s, room = found if whole else free.take(1)
                k = min(n, room)
                held[s].append((d, at, k))
                free.put(c + linear * k + quadratic * k * k, s, room - k)
                at, n = at + k, n - k
    for s, pieces in enumerate(held):
        at = 0
        for d, start, n in pieces:
            out.append((d, start, n, seq + s, at))
            at += n
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """One row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Packs inside each input partition in pools of at most ``pool`` tokens (a longer document is its own pool):
    no shuffle, and a lost task is redone alone with the same result. A null or empty text is its separator id
    alone. Repeated rows are documents of their own. Empty table: no rows. sequence_id holds the partition in its
    high bits; it names a sequence within one run.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(tokenizer)
        context = TaskContext.get()
        seq0 = (context.partitionId() if context else 0) << 36

        def flush(ids, names):
            nonlocal seq0
            cols = [[] for _ in SCHEMA]
            top = -1
            for d, start, n, s, at in assign([len(x) for x in ids], length):
                row = (names[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), seq0 + s, at)
                top = max(top, s)
                for c, v in zip(cols, row):
                    c.append(v)
            seq0 += top + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, SCHEMA)], schema=SCHEMA)

        ids, names, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u4")
                if ids and held + len(one) > pool:
                    yield flush(ids, names)
                    ids, names, held = [], [], 0
                ids.append(one)
                names.append(name)
                held += len(one)
        if ids:
            yield flush(ids, names)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
