"""Runs against all periods tried one by one, the comparisons counted, and odd tables."""

import hashlib
import random
import zlib

from quire.llm import periodic


def brute(words, least=12):
    """Every maximal run: each period in turn, smallest periods only."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            x = words[s : s + length]
            if length >= max(least, 2 * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                found.add((s, length, q))
            i += 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(0, 60)
        w = [rng.choice("abcd"[: rng.choice([1, 2, 2, 3, 4])]) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            p = rng.randint(1, 6)
            for i in range(rng.randint(0, n // 2) + p, n - rng.randint(0, 3)):
                w[i] = w[i - p]
        least = rng.choice([2, 4, 12])
        assert periodic.runs(w, least) == brute(w, least)


def test_lyndon_edges_by_definition():
    rng = random.Random(2)
    for _ in range(500):
        w = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        for larger in (False, True):
            flip = (lambda x: [-ord(c) for c in x]) if larger else (lambda x: [ord(c) for c in x])
            nxt, common = periodic.lyndon_edges(w, larger)
            for i in range(len(w)):
                j = next((j for j in range(i + 1, len(w)) if flip(w[j:]) < flip(w[i:])), len(w))
                assert nxt[i] == j
                assert common[i] == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)


def test_comparisons_stay_linear():
    n = 20_000
    for w in (fibonacci(n), ["a"] * n, list("ab" * (n // 2)), list(("ab" * 50 + "c") * (n // 101)), [str((i & -i).bit_length()) for i in range(1, n)], ["ab"[i.bit_count() & 1] for i in range(n)]):
        for larger in (False, True):
            work = [0]
            periodic.lyndon_edges(w, larger, work)
            assert work[0] <= 2 * len(w)


def test_collapsing_drops_what_runs_repeat():
    w = "x y".split() + "a b c".split() * 5 + ["z"]
    found = periodic.runs(w)
    assert found == [(2, 15, 3)]
    assert periodic.kept_words(w, found) == "x y a b c z".split()
    assert periodic.runs(["a"] * 12) == [(0, 12, 1)] and periodic.runs(["a"] * 11) == []
    assert periodic.runs(list("abcdef") * 2) == [(0, 12, 6)]  # two periods are enough


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 40, "one", " ".join("ab") + " c", "x y " * 30_000]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "a b " * 10, "r", 1), (3, "a " * 40, "r", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), *r[1:]) for r in periodic.op13_runs(spark, str(tmp_path)).collect())
    want = []
    for key, text, *_ in rows:
        w = [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", text or "") if x]
        h = zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = periodic.runs(w) if len(w) > 1000 else brute(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        top = min(((-n, s, q) for s, n, q in found), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        want.append((str(key), len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(want)
    assert sum(x[1] > 0 for x in want) > 10


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []
