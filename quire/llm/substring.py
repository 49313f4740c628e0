"""Near-duplicate passages by compact windows over token min-hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool, bounded_batches, code_points, length_chunks, lower_table, mix, range_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Least length of a passage in words, and so in shingles.
WORDS = 50
WIDTH = WORDS - SHINGLE + 1
#: Min-hash functions, in bands of two: a pair of near copies has to agree on one whole band.
BANDS, BAND = 4, 2
#: Words that a passage may have gained or lost since a matched minimum: shifts so near are tried too.
DRIFT = 8
#: Shingles in one piece of a text that is sent to be compared, and around a matched minimum that are compared.
CELL, REACH = 128, 64
#: Texts of one Arrow batch in which a group is heavy: its first member alone goes on to meet those of other batches.
HEAVY = 16
#: Members of a group that share one copy of the pieces of its representative.
SHARE = 4096
_IDX = 24
_SEED = 0xA24BAED4963EE407
_SPACE: list = []


def _space() -> np.ndarray:
    """Whether each code point is white space."""
    if not _SPACE:
        space = np.zeros(0x110000, bool)
        space[[i for i in range(0x3001) if chr(i).isspace()]] = True
        _SPACE.append(space)
    return _SPACE[0]


class Shingles:
    """Words and five-word shingles of a batch of texts, as flat arrays.

    start, end: character range of each word, from the start of its text; first: index of each text's first word,
    with the total at the end; hashes: 32 bits of the shingle that begins at each word; size: shingles of each text.
    """

    def __init__(self, texts: list[str]):
        raw = code_points("\n".join(texts) + "\n")
        word = ~_space()[raw]
        step = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        base = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
        self.first = np.searchsorted(start, base)
        doc = self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start, self.end = start - base[doc], end - base[doc]
        w = range_hashes(lower_table()[raw], start, end)
        n = len(w)
        padded = np.concatenate((w, np.zeros(SHINGLE, np.uint64)))
        h = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + n]
        self.hashes = mix(h) >> np.uint64(32)
        self.size = np.maximum(np.diff(self.first) - SHINGLE + 1, 0)
        self.at = np.arange(n) - self.first[doc]


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or best) of each window of ``width`` values, by doubling."""
    step, m = 1, values
    while step * 2 <= width:
        m = best(m[:-step], m[step:])
        step *= 2
    return best(m[: len(values) - width + 1], m[width - step :])


def min_hash(hashes: np.ndarray, function: int) -> np.ndarray:
    """The values of a hash function (high bits) with their places (low bits), so the leftmost of equals is the least."""
    low = np.uint64((1 << _IDX) - 1)
    return (mix(hashes ^ np.uint64(_SEED * (function + 1) % (1 << 64))) & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)


class Tree:
    """The Cartesian trees of some texts' min-hash values, as far as their nodes span ``width`` shingles.

    A node is a compact window: every passage within left..right that holds the place has its value as the minimum.
    least: the minimum of the passage of ``width`` shingles that begins at each shingle, 0 for none; up: parent node.
    A node's nearest smaller values on both sides span as much as itself, so the smaller ones needn't be built.
    """

    def __init__(self, s: Shingles, function: int, width: int = WIDTH):
        n = len(s.hashes)
        self.least = np.zeros(n, np.uint64)
        if n >= width:
            self.least[: n - width + 1] = sliding(min_hash(s.hashes, function), width)
            self.least[s.at + width > s.size[s.doc]] = 0
        new = np.flatnonzero((self.least > 0) & np.concatenate(([True], self.least[1:] != self.least[:-1]))[:n])
        self.value = self.least[new]
        self.place = place_of(self.value, new)
        doc = s.doc[self.place]
        low = s.first[doc]
        high = low + s.size[doc] - 1
        places, values, texts, lows = self.place.tolist(), self.value.tolist(), doc.tolist(), low.tolist()
        left, right, up = [0] * len(places), high.tolist(), [-1] * len(places)
        open_: list[int] = []  # the right spine of the tree so far
        at = -1
        for k, v in enumerate(values):
            if texts[k] != at:
                open_, at = [], texts[k]
            below = -1
            while open_ and values[open_[-1]] > v:
                below = open_.pop()
                right[below] = places[k] - 1
            if below >= 0:
                up[below] = k
            up[k] = open_[-1] if open_ else -1
            left[k] = places[open_[-1]] + 1 if open_ else lows[k]
            open_.append(k)
        self.left, self.right, self.up = np.array(left, np.int64), np.array(right, np.int64), np.array(up, np.int64)

    def deepest(self, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """The node of the smallest span that holds each place: the largest minimum of the passages around it."""
        around = sliding(np.concatenate((np.zeros(width - 1, np.uint64), self.least)), width, np.maximum)
        return np.searchsorted(self.place, place_of(around[places], places - width + 1))


def place_of(values: np.ndarray, from_: np.ndarray) -> np.ndarray:
    """The places in packed values; one that ran over the bits for it is the first at or after from_."""
    place = (values & np.uint64((1 << _IDX) - 1)).astype(np.int64)
    back = (from_ >> _IDX) << _IDX
    return place + back + np.where(place + back < from_, 1 << _IDX, 0)


def joint_windows(a: Tree, b: Tree, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of two trees: the node pairs whose windows share a passage of ``width`` shingles.

    A passage has the minima of both nodes if it lies in both spans and holds both places. From the deepest node of b
    that spans a node's place, all that do are its ancestors, so the join walks up, all nodes of a at once.
    Repeated longer passages hold repeated ones of the least length, so pairs whose places are further apart, which
    share longer passages only, aren't needed.
    """
    u = np.arange(len(a.place))
    v = b.deepest(a.place, width) if len(u) else u
    out = []
    while len(u):
        x, y = a.place[u], b.place[v]
        room = np.minimum(a.right[u], b.right[v]) - np.maximum(a.left[u], b.left[v]) + 1
        ok = (y >= a.left[u]) & (y <= a.right[u]) & (np.abs(x - y) < width) & (room >= width)
        out.append((u[ok], v[ok]))
        go = (b.up[v] >= 0) & ((b.left[v] > x - width) | (b.right[v] < x + width))  # else all ancestors' places are too far
        u, v = u[go], b.up[v[go]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (u, u)


def joint_keys(band: int, values: list[np.ndarray]) -> np.ndarray:
    """The key of passages by their packed minima in a band's functions: 47 bits of a hash, and one for the first band."""
    key = np.full(len(values[0]), band + 1, np.uint64)
    for v in values:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + (v >> np.uint64(_IDX)))
    return ((key >> np.uint64(17)) << np.uint64(1) | np.uint64(band == 0)).view(np.int64)


def window_groups(s: Shingles, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place): the groups of passages with equal minima in all hash functions of a band.

    place is that of the first function's minimum, so texts with the same passage hold it at the same distance from
    their places. The key of the first band is odd, of the others even. A stretch of passages with one key after the
    other, as repetitive texts have, counts once in as many shingles as comparisons reach.
    """
    out = []
    for band in range(BANDS):
        a, b = (Tree(s, band * BAND + i, width) for i in range(BAND))
        u, v = joint_windows(a, b, width)
        key = joint_keys(band, [a.value[u], b.value[v]])
        place = a.place[u]
        order = np.lexsort((b.place[v], place))
        key, place = key[order], place[order]
        doc = s.doc[place]
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            step = (place - place[np.flatnonzero(new)[np.cumsum(new) - 1]]) // max(1, REACH - width)
            keep = new | np.concatenate(([True], step[1:] != step[:-1]))
            key, place, doc = key[keep], place[keep], doc[keep]
        out.append((key, doc, s.at[place]))
    key, doc, place = (np.concatenate(x) for x in zip(*out))
    return key, doc, place


WINDOWS = "kind int, key long, salt long, doc long, h int, place int"
MEMBER, HEAD, HELD = 0, 1, 2


def _windows(batches):
    """Members of groups. Where a group is heavy in a batch, its first member goes on as HEAD, the others as HELD."""
    import pyarrow as pa

    for b in batches:
        names, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
        parts = []
        for rows in length_chunks(texts):
            key, doc, place = window_groups(Shingles([texts[i] for i in rows]))
            rows = np.array(rows)
            parts.append((key, names[rows][doc], marks[rows][doc], place))
        if not parts:
            continue
        key, doc, h, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, h, doc, key))
        key, doc, h, place = key[order], doc[order], h[order], place[order]
        if not len(key):
            continue
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        texts_of = np.bincount(group, np.concatenate(([True], new[1:] | (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))))
        heavy = texts_of[group] >= HEAVY
        head = np.flatnonzero(new)[group]
        salt = mix(mix(doc[head].view(np.uint64) ^ h[head].astype(np.uint64)) ^ place[head].astype(np.uint64)).view(np.int64)
        kind = np.where(heavy, np.where(new, HEAD, HELD), MEMBER)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))  # text by text, so that neighbours compress
        kind, key, salt, heavy, doc, h, place = (x[back] for x in (kind, key, salt, heavy, doc, h, place))
        cols = [pa.array(kind, pa.int32()), pa.array(key), pa.array(salt, mask=~heavy), pa.array(doc), pa.array(h), pa.array(place, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "key", "salt", "doc", "h", "place"])


LINKS = "kind int, key long, salt long, doc long, h int, place int, rep long, rep_h int, rep_place int, crowd boolean"


def _meet(batches):
    """Over rows sorted by (key, doc, h, place): each member with the first of its group; a HEAD comes with it too.

    HELD rows pass through. Of a group with one text nothing comes out; of the first text itself only its further
    places in the first band, for the comparison of exact windows. crowd: the group may have members beside the first
    that match each other, so there are three texts or more, or it isn't known yet. Keeps the first text's rows of one group.
    """
    import pyarrow as pa

    names = ["kind", "key", "salt", "doc", "h", "place"]
    kept, seen, other = None, 0, False  # the first text's rows of the group that goes on; its rows so far; whether another text came
    for b in batches:
        if not b.num_rows:
            continue
        salt = b.column("salt").fill_null(0).to_numpy(zero_copy_only=False)
        cols = [salt if c == "salt" else b.column(c).to_numpy() for c in names]
        held = cols[0] == HELD
        out = [[c[held] for c in cols] + [np.zeros(held.sum(), np.int64)] * 3 + [np.ones(held.sum(), bool)]]
        cols = [c[~held] for c in cols]
        if len(cols[0]):
            fresh = np.ones(len(cols[0]), bool)
            base = 0
            if kept is not None and kept[1][0] == cols[1][0]:
                fresh = np.concatenate((np.full(len(kept[0]), not other), fresh))  # of a lone text nothing has come out yet
                cols, base = [np.concatenate(x) for x in zip(kept, cols)], seen - len(kept[0])
            else:
                other = False
            kind, key, salt, doc, h, place = cols
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            first = heads[group]
            mine = (doc == doc[first]) & (h == h[first])
            many = np.bincount(group, ~mine, len(heads)) > 0
            many[0] |= other
            rank = np.arange(len(key)) - first
            rank[group == 0] += base
            fresh_text = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | new[1:]))
            crowd = np.bincount(group, fresh_text | (kind == HEAD), len(heads)) + np.bincount(group, (kind == HEAD), len(heads)) > 2
            crowd |= np.bincount(group, mine & ~new, len(heads)) > 0  # places of the first text match others too
            crowd[0] |= other
            crowd[-1] = True  # goes on, perhaps
            link = fresh & many[group] & np.where(mine, (key & 1 == 1) & (place != place[first]), True)
            share = rank // SHARE
            out.append([np.full(link.sum(), MEMBER), key[link], share[link], doc[link], h[link], place[link], doc[first][link], h[first][link], place[first][link], crowd[group][link]])
            lead = (kind == HEAD) & (np.arange(len(key)) >= len(key) - (~held).sum())
            out.append([kind[lead], key[lead], salt[lead], doc[lead], h[lead], place[lead], doc[first][lead], h[first][lead], place[first][lead], np.ones(lead.sum(), bool)])
            last = group == len(heads) - 1
            seen, other = int(rank[-1]) + 1, bool(many[-1])
            kept = [c[last & mine] for c in cols]
        cols = [np.concatenate(x) for x in zip(*out)]
        if len(cols[0]):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds)], names=[*names, "rep", "rep_h", "rep_place", "crowd"])


CELLS = "doc long, h int, cell int, salt long, hashes binary, spots binary"


def pack_spots(start: np.ndarray, end: np.ndarray) -> bytes:
    """Character ranges of consecutive shingles, in 3 bytes each where they are as short as usual, else in 8."""
    away, long = start - start[0], end - start
    small = bool(away[-1] < 1 << 16 and long.max() < 1 << 8)
    return bytes([small]) + int(start[0]).to_bytes(8, "little") + away.astype("<u2" if small else "<u4").tobytes() + long.astype("u1" if small else "<u4").tobytes()


def unpack_spot(data: bytes, i: int) -> tuple[int, int]:
    """The character range of the i-th shingle."""
    wide, size = (2, 1) if data[0] else (4, 4)
    n = (len(data) - 9) // (wide + size)
    number = lambda at, k: int.from_bytes(data[at : at + k], "little")
    start = number(1, 8) + number(9 + i * wide, wide)
    return start, start + number(9 + n * wide + i * size, size)


def _cells(batches):
    """Over rows sorted by (doc, h, kind): a text (kind 0), then the pieces of it that are asked for (kind 1)."""
    import pyarrow as pa

    wait: list = []  # [doc, h, text, asked]
    chars = asks = 0

    def flush():
        nonlocal chars, asks
        todo = [w for w in wait if w[3] and w[2] is not None]
        cols: list[list] = [[] for _ in range(6)]
        s = Shingles([w[2] for w in todo])
        hashes = s.hashes.astype("<u4")
        for k, (doc, h, _, asked) in enumerate(todo):
            low, size = int(s.first[k]), int(s.size[k])
            for cell, salt in asked:
                a, z = low + cell * CELL, low + min((cell + 1) * CELL, size)
                if a < z:
                    spots = pack_spots(s.start[a:z], s.end[a + SHINGLE - 1 : z + SHINGLE - 1]) if salt < 0 else None  # a text's own pieces know where their words are
                    row = (doc, h, cell, salt, hashes[a:z].tobytes(), spots)
                    for c, x in zip(cols, row):
                        c.append(x)
        chars = asks = 0
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "h", "cell", "salt", "hashes", "spots"])

    for b in batches:
        texts = b.column("text")
        for i, (doc, h, kind, cell, salt) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", "h", "kind", "cell", "salt")))):
            if not wait or wait[-1][:2] != [doc, h]:
                if chars > 400_000 or asks > 4000:
                    yield flush()
                    wait = []
                if wait and not wait[-1][3]:
                    wait.pop()
                wait.append([doc, h, None, []])
            w = wait[-1]
            if kind == 0:
                w[2] = w[2] if w[2] is not None else texts[i].as_py()
            else:
                chars += 0 if w[3] else len(w[2] or "")
                w[3].append((cell, salt))
                asks += 1
                if asks > 20_000:
                    yield flush()
                    wait = [[doc, h, w[2], []]]
    if wait:
        yield flush()


def aligned(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]], reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(whether each shingle of a is matched, its shift to b) around pairs of places.

    Shingles are compared at the shift of each pair, as far as its places reach; those left are matched to an equal
    shingle of b within DRIFT of such a shift, as words put in or left out move the rest of a passage.
    """
    same, shift = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    near = np.zeros(len(a), bool)
    by: dict[int, list[int]] = {}
    for x, y in pairs:
        by.setdefault(x - y, []).append(x)
    for d, at in sorted(by.items()):
        lo, hi = max(0, d, min(at) - reach), min(len(a), len(b) + d, max(at) + reach + 1)
        if lo < hi:
            near[lo:hi] = True
            hit = (a[lo:hi] == b[lo - d : hi - d]) & ~same[lo:hi]
            same[lo:hi] |= hit
            shift[lo:hi][hit] = d
    rest = np.flatnonzero(near & ~same)
    if len(rest) and len(b):
        order = np.argsort(b, kind="stable")
        sorted_, shifts = b[order], np.array(sorted(by))
        for side in ("left", "right"):  # the first and the last place of each shingle in b
            at = np.searchsorted(sorted_, a[rest], side) - (side == "right")
            ok = (at >= 0) & (at < len(b))
            ok[ok] = sorted_[at[ok]] == a[rest[ok]]
            d = rest - order[np.clip(at, 0, len(b) - 1)]
            k = np.searchsorted(shifts, d)
            gap = np.minimum(np.abs(d - shifts[np.minimum(k, len(shifts) - 1)]), np.abs(d - shifts[np.maximum(k - 1, 0)]))
            hit = ok & (gap <= DRIFT) & ~same[rest]
            same[rest[hit]], shift[rest[hit]] = True, d[hit]
    return same, shift


def passages(same: np.ndarray, shift: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """(first shingle, end, similarity) of the passages that the matched shingles make up.

    Gaps that one or two changed words leave are bridged. A passage counts if it has at least ``width`` shingles
    and the Jaccard similarity of the two aligned passages reaches the threshold; one that doesn't is tried again
    as the runs between its gaps.
    """
    edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[tuple[int, int, float]] = []
    i = 0
    while i < len(start):
        j, equal, more = i, int(end[i] - start[i]), 0  # more: shingles by which b's passage is longer
        good = (i, equal, more)
        while j + 1 < len(start) and start[j + 1] - end[j] <= 2 * SHINGLE:
            j += 1
            equal += int(end[j] - start[j])
            moved = int(shift[end[j - 1] - 1] - shift[start[j]])
            more += moved if abs(moved) <= DRIFT else 0
            if equal / (2 * (end[j] - start[i]) + more - equal) >= similarity:
                good = (j, equal, more)
        j, equal, more = good
        n = int(end[j] - start[i])
        if n >= width:
            out.append((int(start[i]), int(end[j]), equal / (2 * n + more - equal)))
        i = j + 1 if n >= width else i + 1
    return out


class _Sparse:
    """Pieces of a text's shingles in their places; what lies between equals nothing."""

    def __init__(self, cells: list[tuple[int, bytes]], blank: int):
        cells = sorted(cells)
        self.base = cells[0][0] * CELL
        last, data = cells[-1]
        self.values = np.full(last * CELL + len(data) // 4 - self.base, blank, np.uint64)
        for cell, data in cells:
            at = cell * CELL - self.base
            self.values[at : at + len(data) // 4] = np.frombuffer(data, "<u4")


def exact_windows(own: np.ndarray, keys: np.ndarray, of_rep: np.ndarray, links: list[tuple[int, int, int]], width: int = WIDTH) -> set[tuple[int, int]]:
    """(start, key) of a text's passages of ``width`` shingles in a first-band group that don't equal the representative's.

    keys: the first band's key of the passage that begins at each shingle.
    """
    out = set()
    for x, y, key in links:
        lo, hi = max(0, x - width + 1), min(len(keys), x + width)
        i = np.flatnonzero(keys[lo:hi] == key) + lo
        if not len(i):
            continue
        a, z = int(i[0]), int(i[-1]) + width
        b, c = max(a, x - y), min(z, len(of_rep) + x - y)
        equal = np.zeros(z - a + 1, np.int64)
        if b < c:
            equal[b - a + 1 : c - a + 1] = own[b:c] == of_rep[b - x + y : c - x + y]
        equal = np.cumsum(equal)
        out.update((s, key) for s in i[equal[i - a + width] - equal[i - a] < width].tolist())
    return out


def first_keys(own: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first band's key of the passage of ``width`` shingles that begins at each; -1, which is no key, where one is not known whole."""
    if len(own) < width:
        return np.zeros(0, np.int64)
    key = joint_keys(0, [sliding(min_hash(own, k), width) for k in range(BAND)])
    return np.where(sliding((own < 1 << 32).astype(np.uint8), width) == 1, key, -1)


FOUND = "doc long, h int, rep long, rep_h int, word int, word_end int, start int, end int, similarity double, window long, key long"


def _verify(batches):
    """Over rows sorted by (doc, h, rep, rep_h, kind, cell): verified passages, and windows that differ from their representative's.

    A text's own pieces come first (rep null); for each representative its pieces (kind 1), then the pairs of places (kind 2).
    """
    import pyarrow as pa

    text = rep = None
    own: dict[int, tuple] = {}
    theirs: dict[int, bytes] = {}
    links: set = set()
    crowded: set = set()
    odd: set = set()
    a = keys = None
    rows: list[tuple] = []

    def judge():
        nonlocal a, keys
        if not (own and theirs and links):
            return
        if a is None:
            a = _Sparse([(c, x[0]) for c, x in own.items()], 1 << 33)
        b = _Sparse(list(theirs.items()), 1 << 34)
        at = [(x - a.base, y - b.base) for x, y in sorted(links)]
        spot = lambda w: unpack_spot(own[(w + a.base) // CELL][1], (w + a.base) % CELL)
        if rep != text:
            for x, z, sim in passages(*aligned(a.values, b.values, at)):
                rows.append((*text, *rep, x + a.base, z + a.base + SHINGLE - 1, spot(x)[0], spot(z - 1)[1], sim, None, None))
        if first := [(x - a.base, y - b.base, key) for x, y, key in sorted(crowded)]:
            if keys is None:
                keys = first_keys(a.values)
            odd.update(exact_windows(a.values, keys, b.values, first))

    def flush():
        """The windows of a text that differ from their representative's, once each."""
        if odd:
            found = sorted(odd)
            s = np.array([x for x, _ in found])
            spot = lambda w: unpack_spot(own[(w + a.base) // CELL][1], (w + a.base) % CELL)
            for (x, key), h in zip(found, range_hashes(a.values, s, s + WIDTH).view(np.int64).tolist()):
                rows.append((*text, None, None, x + a.base, x + a.base + WORDS, spot(x)[0], spot(x + WIDTH - 1)[1], 1.0, h, key))

    def batch():
        cols = list(zip(*rows)) if rows else [[]] * 11
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    for b in batches:
        for doc, h, r, rh, kind, cell, hashes, spots, place, rep_place, key, crowd in zip(*(b.column(c).to_pylist() for c in VERIFY)):
            if (doc, h) != text or (r, rh) != rep:
                judge()
                if (doc, h) != text:
                    flush()
                    own, a, keys, odd = {}, None, None, set()
                text, rep, theirs, links, crowded = (doc, h), (r, rh), {}, set(), set()
            if kind == 0:
                own[cell] = (hashes, spots)
            elif kind == 1:
                theirs[cell] = hashes
            else:
                links.add((place, rep_place))
                if crowd and key & 1:
                    crowded.add((place, rep_place, key))
        if len(rows) > 2000:
            yield batch()
            rows = []
    judge()
    flush()
    yield batch()


VERIFY = ["doc", "h", "rep", "rep_h", "kind", "cell", "hashes", "spots", "place", "rep_place", "key", "crowd"]


def _node(id_col: str, text_col: str):
    """(doc, h): a document by its id and a hash of its text, so rows of one id with different texts are apart; a row without an id goes by its text."""
    whole = F.xxhash64(F.col(text_col))
    return F.coalesce(F.col(id_col).cast("long"), whole).alias("doc"), F.shiftright(whole, 32).cast("int").alias("h")


def _led(held: DataFrame, lead: DataFrame) -> DataFrame:
    """Each held row with its HEAD's representative. A (key, salt) has one HEAD, so a window over both finds it, and rows stay as many."""
    from pyspark.sql import Window as W

    rep = F.struct("rep", "rep_h", "rep_place")
    both = held.withColumn("lead", F.lit(None).cast("struct<rep:long,rep_h:int,rep_place:int>")).unionByName(lead.select("key", "salt", rep.alias("lead")), allowMissingColumns=True)
    own = F.col("lead").isNull()
    found = both.withColumn("own", own).withColumn("lead", F.first("lead", ignorenulls=True).over(W.partitionBy("key", "salt")))
    return found.filter("own and lead is not null").select("key", "salt", "doc", "h", "place", "lead.*")


def found_passages(docs: DataFrame, spool: Spool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, rep, rep_h, word, word_end, start, end, similarity): the repeated passages by node (see _node)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    wide = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(*_node(id_col, text_col), F.col(text_col).alias("text")).filter(F.char_length("text") >= 2 * WORDS - 1)
    rows = base.mapInArrow(_windows, WINDOWS)
    spread = F.when(F.col("kind") == HELD, F.xxhash64("doc", "place")).otherwise(F.col("key"))  # a held row's key may be of very many
    met = spool.put(rows.repartition(wide, spread).sortWithinPartitions("key", "doc", "h", "place").mapInArrow(_meet, LINKS))

    lead = met.filter(F.col("kind") == HEAD).select("key", "salt", "rep", "rep_h", "rep_place").distinct()
    held = _led(met.filter(F.col("kind") == HELD).select("key", "salt", "doc", "h", "place"), lead).withColumn("crowd", F.lit(True))
    held = held.filter((F.col("doc") != F.col("rep")) | (F.col("h") != F.col("rep_h")) | ((F.col("key") % 2 != 0) & (F.col("place") != F.col("rep_place"))))
    link_cols = ["key", "salt", "doc", "h", "place", "rep", "rep_h", "rep_place", "crowd"]
    links = met.filter(F.col("kind") == MEMBER).select(link_cols).unionByName(held.select(link_cols))
    links = links.withColumn("salt", F.shiftrightunsigned("salt", 1))  # a text's own pieces have salt -1

    around = lambda place: F.explode(F.sequence(F.floor(F.greatest(F.col(place) - REACH, F.lit(0)) / CELL).cast("int"), F.floor((F.col(place) + REACH) / CELL).cast("int"))).alias("cell")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    of_rep = spool.put(links.select("doc", "h", "rep", "rep_h", "salt", around("rep_place")).distinct())
    ask = of_rep.select(F.col("rep").alias("doc"), F.col("rep_h").alias("h"), "cell", "salt")
    ask = ask.unionByName(links.select("doc", "h", around("place"), F.lit(-1).cast("long").alias("salt"))).distinct()
    both = base.select("doc", "h", F.lit(0).alias("kind"), none("cell", "int"), none("salt", "long"), "text")
    both = both.unionByName(ask.select("doc", "h", F.lit(1).alias("kind"), "cell", "salt", none("text", "string")))
    cells = spool.put(both.repartition(wide, "doc", "h").sortWithinPartitions("doc", "h", "kind", "cell", "salt").mapInArrow(_cells, CELLS))

    named = cells.filter("salt >= 0").select(F.col("doc").alias("rep"), F.col("h").alias("rep_h"), "cell", "salt", "hashes")
    no_place = [none("place", "int"), none("rep_place", "int"), none("key", "long"), none("crowd", "boolean")]
    own = cells.filter("salt < 0").select("doc", "h", none("rep", "long"), none("rep_h", "int"), F.lit(0).alias("kind"), "cell", "hashes", "spots", *no_place)
    theirs = of_rep.join(named, ["rep", "rep_h", "cell", "salt"]).select("doc", "h", "rep", "rep_h", F.lit(1).alias("kind"), "cell", "hashes", none("spots", "binary"), *no_place)
    places = links.select("doc", "h", "rep", "rep_h", F.lit(2).alias("kind"), none("cell", "int"), none("hashes", "binary"), none("spots", "binary"), "place", "rep_place", "key", "crowd")
    judged = own.unionByName(theirs).unionByName(places).select(VERIFY).repartition(wide, "doc", "h").sortWithinPartitions("doc", "h", F.asc_nulls_first("rep"), "rep_h", "kind", "cell")
    found = spool.put(judged.mapInArrow(_verify, FOUND))

    odd = found.filter("window is not null").select("window", "key", "doc", "h", "word", "word_end", "start", "end", F.pmod(F.xxhash64("doc", "h"), F.lit(16)).alias("part")).distinct()
    me = F.struct("doc", "h")
    first = odd.groupBy("window", "key").agg(F.min(me).alias("rep"), F.max(me).alias("last")).filter("rep <> last").select("window", "key", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"), F.col("rep.doc").alias("rep"), F.col("rep.h").alias("rep_h"))
    equal = odd.join(first, ["window", "key", "part"]).filter("doc <> rep or h <> rep_h").select("doc", "h", "rep", "rep_h", "word", "word_end", "start", "end").distinct()
    from pyspark.sql import Window as W

    by = W.partitionBy("doc", "h", "rep", "rep_h").orderBy("word")
    runs = equal.withColumn("new", (F.col("word") > F.coalesce(F.lag("word").over(by), F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("doc", "h", "rep", "rep_h", "run").agg(F.min("word").alias("word"), F.max("word_end").alias("word_end"), F.min("start").alias("start"), F.max("end").alias("end"))
    cols = ["doc", "h", "rep", "rep_h", "word", "word_end", "start", "end", "similarity"]
    return found.filter("window is null").select(cols).unionByName(runs.withColumn("similarity", F.lit(1.0)).select(cols)).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, rep, word, word_end, start, end, similarity: passages that an earlier document (smaller id) holds too.

    One row for each passage of ``doc`` and the document ``rep`` it was found in: the word and character ranges in
    doc's text, and the Jaccard similarity of the five-word shingles of the two aligned passages. Each member of a
    group is compared with the group's first, so work and rows grow with the members and not with their pairs.
    Passages of the least length that differ from their first's are grouped again by what they say, so every exact
    repeat is found; the first occurrence of a passage is never reported. The result doesn't depend on partitions.

    Null, empty and shorter texts (under 50 words) have no passages. Rows of one id with different texts are
    documents of their own, equal rows are one. A row without an id is a document by its text, its doc (or rep) is null;
    it stands among the others by a hash. A passage that repeats only inside its document isn't reported. Empty table:
    no rows. Only the id and the text are read.
    """
    found = found_passages(docs, Spool(docs.sparkSession, "passages"), id_col, text_col)
    if docs.schema[id_col].nullable:
        lone = docs.filter(F.col(id_col).isNull()).select(*_node(id_col, text_col)).distinct()
        found = found.join(lone.withColumn("lone", F.lit(True)), ["doc", "h"], "left")
        found = found.join(lone.select(F.col("doc").alias("rep"), F.col("h").alias("rep_h"), F.lit(True).alias("rep_lone")), ["rep", "rep_h"], "left")
        found = found.withColumn("doc", F.when(F.col("lone").isNull(), F.col("doc"))).withColumn("rep", F.when(F.col("rep_lone").isNull(), F.col("rep")))
    return found.select("doc", "rep", *[F.col(c).cast("long").alias(c) for c in ("word", "word_end", "start", "end")], "similarity")


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans):
        if t is None or found is None or not len(found):
            out.append(t)
            continue
        kept, at = [], 0
        for a, e in sorted((x["start"], x["end"]) for x in found):
            if a > at:
                kept.append(t[at:a].strip())
            at = max(at, e)
        kept.append(t[at:].strip())
        out.append("\n".join(x for x in kept if x))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each without its passages that an earlier document holds; all columns and rows stay.

    A text without such passages is unchanged, null included. What is left on both sides of a cut is joined by a
    line end. A text that consists of repeats becomes empty. Rows of one id are cut each by its own text's passages.
    """
    spark = docs.sparkSession
    found = found_passages(docs, Spool(spark, "passages"), id_col, text_col)
    cuts = found.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))
    at, row = "quire_node", "quire_row"
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.struct(*_node(id_col, text_col)).alias(at))
    joined = whole.join(cuts.select(F.struct("doc", "h").alias("cut_node"), "cuts"), F.col(at) == F.col("cut_node"), "left")
    text = F.pandas_udf(_cut, "string")(F.col(f"{row}.`{text_col}`"), F.col("cuts"))
    joined = joined.withColumn("cut_text", text)
    return joined.select(*[F.col("cut_text").alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("rep").alias("source_doc_id"), "word", "word_end", "start", "end", F.round("similarity", 6).alias("similarity"))
