"""The audit against plain counting, the tokenizer against a regex, and hash collisions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import divergence


def brute(rows, documents, reported):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [[x or "" for x in r] for r in rows]
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall(low(text))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, k in df[lang].items() if k >= documents]
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(count[s]) for s in sources}, p({t: sum(count[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= reported:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def corpus(seed, n, sources, langs=("en", "de", None)):
    rng = random.Random(seed)
    stock = ["the", "The", "of", "Über", "über", "naïve", "中文", "x", "don't", "a1b2", "É"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    return [(rng.choice(langs), rng.choice(["hot", *sources]) if rng.random() < 0.6 else "hot", " ".join(rng.choices(stock, k=rng.randint(0, 30)))) for _ in range(n)]


def test_audit_against_brute_force(spark, monkeypatch):
    rows = corpus(1, 400, ["a", "b", "", None, "é", "Z"]) + [("fr", "lone", "only a few words"), ("fr", "other", None), ("it", None, "")] + [("en", "hot", "same words here")] * 60
    d = spark.createDataFrame([(*r, "t", 1) for r in rows], "lang string, source string, text string, term string, n int")
    want = brute(rows, 20, 7)
    assert sorted(map(tuple, divergence.audit(d, 20, 7).collect())) == want
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 16)  # many buckets
    assert sorted(map(tuple, divergence.audit(d, 20, 7).collect())) == want


def test_blocks_of_sources(spark, monkeypatch):
    """More sources than a block holds."""
    rows = corpus(2, 3000, [f"s{i}" for i in range(290)], ("en",))
    d = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 40)
    assert sorted(map(tuple, divergence.audit(d, 30, 5).collect())) == brute(rows, 30, 5)


def test_odd_tables(spark):
    kind = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], kind)).collect() == []
    assert divergence.audit(spark.createDataFrame([(None, None, None)], kind)).collect() == []
    long = "word " * 300_000 + "y" * 1_000_000
    rows = [("en", "a", long)] * 3 + [("en", "b", "word z")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, kind), 3).collect())) == brute(rows, 3, 50)


def test_tokens_against_a_regex():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ @[`{é中\x00\x7f9-") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    data, start, end, doc = divergence.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [(int(k), data[s:e].tobytes()) for s, e, k in zip(start, end, doc)]
    assert got == [(k, m.lower()) for k, t in enumerate(raw) for m in re.findall(rb"[A-Za-z\x80-\xff]+", t)]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda x: len(x) % 2)
    words = [b"aa", b"bb", b"aa", b"c", b"ddd", b"c", b"bb", b"ccc"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    group, first = divergence.groups(data, end - [len(w) for w in words], end)
    assert [words[first[g]] for g in group] == words


def test_distances_by_definition():
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 50, (9, 30))
    base = rng.integers(0, 50, 9)
    absent = rng.random(dense.shape) < 0.6
    absent[3] = True
    dense[absent] = np.broadcast_to(base[:, None], dense.shape)[absent]
    indptr = np.concatenate(([0], np.cumsum((~absent).sum(1))))
    cols, data = np.nonzero(~absent)[1], dense[~absent]
    assert (divergence.distances(indptr, cols, data, base, 30, np.arange(9)) == np.abs(dense[:, None, :] - dense[None]).sum(2)).all()
