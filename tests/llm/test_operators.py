"""The training-data operators: brute force, round trips, and the cases that break careless code."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import balltree, langid, packing, projection, ring, segmentation, simhash, styletree, substring, toxicity

DOC = "doc_id long, text string, id string, score double, spans string, doc string, rep string, y string"
EXTRA = ("x", 1.0, "s", "d", "r", "y")


def docs(spark, *texts, start=1):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts, start)], DOC)


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{x}" for x in rng.integers(0, 5000, n))


ODD = (None, "", "  \n\t ", "one", "one", "é中 " * 50, "a " * 30_000, "123 !!")


@pytest.mark.parametrize("texts", [(), ODD])
def test_every_text_operator_takes_odd_tables(spark, texts):
    d = docs(spark, *texts)
    n = len(texts)
    assert simhash.near_duplicates(d).count() == n
    assert substring.repeated_passages(d).count() == 0
    assert substring.without_repeats(d).columns == d.columns and substring.without_repeats(d).count() == n
    packed = packing.pack(d, packing.default_tokenizer()).collect()
    assert {r.doc_id for r in packed} == {i + 1 for i in range(n)}
    assert ring.shard(d, 3).count() == n
    seg = segmentation.segment(d, segmentation.default_model()).collect()
    assert {r.id for r in seg} == {i + 1 for i in range(n)}
    for model in (langid.fit(d.limit(0).withColumn("lang", d.text), "doc_id", "text", "lang"),):
        assert {r.lang_pred for r in langid.identify(d, model).collect()} <= {"und"}
    bad = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.detect(d, toxicity.fit(d, bad)).count() == n


def test_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert Counter((r.id, r.component_id) for r in simhash.near_duplicates(d).collect()) == {(None, 2): 1, (2, 2): 2}
    assert ring.shard(d, 2).count() == 3
    assert substring.repeated_passages(d).count() == 0
    assert packing.pack(d, packing.default_tokenizer()).count() == 3


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [words(rng, 300) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(12):
            w = b.split()
            for k in rng.integers(0, 300, 2):
                w[k] = "edit%d" % rng.integers(9)
            texts.append(" ".join(w))
    texts += ["", None, "A B", "a b"]
    def naive(t):
        w = (t or "").lower().split()
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    fp = [naive(t) for t in texts]
    root = list(range(len(fp)))
    for _ in fp:
        root = [min(root[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(fp))]
    for dense in (simhash.DENSE, 3):
        got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs(spark, *texts), dense=dense).collect()}
        assert [got[i + 1] for i in range(len(fp))] == [(f, r + 1) for f, r in zip(fp, root)]


def test_byte_groups_cover_every_pair():
    from itertools import combinations

    for width in (3, 4):
        groups = [set(g) for g in simhash.byte_groups(width)]
        assert all(any(g <= set(c) for g in groups) for c in combinations(range(8), 4))


def test_passages_across_documents(spark):
    rng = np.random.default_rng(2)
    shared = words(rng, 60, "p")
    near = shared.split()
    near[30] = "changed"
    texts = [f"{words(rng, 80)} {shared} {words(rng, 40)}", f"{words(rng, 30)}\n{shared}", words(rng, 200), f"{' '.join(near)} {words(rng, 90)}", f"{words(rng, 90)} {' '.join(shared.split()[:45])}"]
    found = {r.doc: r for r in substring.repeated_passages(docs(spark, *texts)).collect() if r.rep == 1}
    assert set(found) == {2, 4}
    assert (found[2].word, found[2].word_end, found[2].similarity) == (30, 90, 1.0)
    assert found[4].word == 0 and found[4].word_end == 60 and found[4].similarity >= 0.8
    assert texts[1][found[2].start : found[2].end] == shared
    left = {r.doc_id: r.text for r in substring.without_repeats(docs(spark, *texts)).collect()}
    assert left[1] == texts[0] and left[3] == texts[2] and left[5] == texts[4]
    assert shared not in left[2] and left[2] == texts[1].split("\n")[0]


def test_all_repeats_of_fifty_words_are_covered(spark):
    rng = np.random.default_rng(3)
    pool = [words(rng, int(n), "q") for n in rng.integers(50, 90, 8)]
    texts = [" ".join([words(rng, int(rng.integers(5, 60))), pool[rng.integers(8)], words(rng, 20), pool[rng.integers(8)]]) for _ in range(60)]
    cover: dict = {}
    for r in substring.repeated_passages(docs(spark, *texts)).collect():
        cover.setdefault(r.doc, set()).update(range(r.word, r.word_end))
    seen: dict = {}
    for i, t in enumerate(texts, 1):
        w = t.split()
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k : k + 50]), i)
            assert first == i or set(range(k, k + 50)) <= cover[i]


def test_compact_windows_are_nodes_of_cartesian_trees():
    rng = np.random.default_rng(4)
    s = substring.Shingles([words(rng, 120), words(rng, 12), "", words(rng, 70), "a " * 60])
    width = 20
    trees = [substring.Tree(s, k, width) for k in (0, 1)]
    want: list[dict] = []
    for k, tree in enumerate(trees):
        v = substring.min_hash(s.hashes, k)
        nodes = {}
        for d in range(5):
            lo, n = int(s.first[d]), int(s.size[d])
            for x in range(lo, lo + n):
                left, right = x, x
                while left > lo and v[left - 1] > v[x]:
                    left -= 1
                while right < lo + n - 1 and v[right + 1] > v[x]:
                    right += 1
                if right - left + 1 >= width:
                    nodes[x] = (left, right)
        assert {int(c): (int(x), int(y)) for c, x, y in zip(tree.place, tree.left, tree.right)} == nodes
        for c, u in zip(tree.place, tree.up):
            if u >= 0:
                assert tree.left[u] <= c <= tree.right[u] and v[tree.place[u]] < v[c]
        want.append(nodes)
    u, w = substring.joint_windows(*trees, width)
    got = {(int(trees[0].place[i]), int(trees[1].place[j])) for i, j in zip(u, w)}
    cells = set()
    for d in range(5):
        lo, n = int(s.first[d]), int(s.size[d])
        for i in range(lo, lo + n - width + 1):
            cells.add(tuple(i + int(np.argmin(substring.min_hash(s.hashes, k)[i : i + width])) for k in (0, 1)))
    assert got == cells and len(got) == len(u)


def test_passages_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(substring, "HEAVY", 3)
    rng = np.random.default_rng(51)
    shared, line = words(rng, 60, "p"), words(rng, 30, "l")
    texts = [f"{words(rng, 40)} {shared if i % 2 else line} {words(rng, 40)}" for i in range(24)]
    d = docs(spark, *texts)
    got = [sorted(map(tuple, substring.repeated_passages(d.repartition(n)).collect())) for n in (1, 3, 17)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == set(range(4, 25, 2)) and all(r[1] < r[0] and r[1] % 2 == 0 for r in got[0])


def test_pairs_that_match_only_each_other_around_a_common_line(spark, monkeypatch):
    rng = np.random.default_rng(52)
    line = words(rng, 44, "l")
    texts = [f"{words(rng, 40)} {line} {words(rng, 40)}" for _ in range(40)]
    pairs = []
    for _ in range(10):
        a, z = words(rng, 3, "a"), words(rng, 4, "z")
        pairs.append((len(texts) + 1, len(texts) + 2))
        texts += [f"{words(rng, 40)} {a} {line} {z} {words(rng, 40)}" for _ in range(2)]
    for heavy in (substring.HEAVY, 4):
        monkeypatch.setattr(substring, "HEAVY", heavy)
        got = {(r.rep, r.doc) for r in substring.repeated_passages(docs(spark, *texts)).collect()}
        assert got == set(pairs)


def test_repeated_and_missing_ids_are_cut_by_their_own_text(spark):
    rng = np.random.default_rng(53)
    shared = words(rng, 60, "p")
    first, lone, alone = f"{words(rng, 80)} {shared}", words(rng, 91), f"{words(rng, 20)} {shared}"
    rows = [(1, first), (5, f"{shared} tail"), (5, lone), (5, lone), (None, alone), (None, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in substring.without_repeats(d).collect())
    assert sum(left.values()) == 7 and left[(5, lone)] == 2 and left[(None, None)] == 1 and left[(7, "")] == 1
    held = sum(shared in (t or "") for _, t in left)
    assert held == 1 and (1, first) in left or (None, alone) in left
    found = substring.repeated_passages(d).collect()
    assert len(found) == 2 and {r.doc for r in found} | {r.rep for r in found} == {1, 5, None}


def test_repetitive_texts_stay_linear(spark):
    found = substring.repeated_passages(docs(spark, "a " * 60_000, "b c " * 30_000, "x y z " + "a " * 300, "b c " * 40)).collect()
    cover: dict = {}
    for r in found:
        cover.setdefault((r.doc, r.rep), set()).update(range(r.word, r.word_end))
    assert cover[(3, 1)] >= set(range(3, 303)) and cover[(4, 2)] == set(range(80))


def test_packing_keeps_every_id(spark):
    rng = np.random.default_rng(5)
    texts = [words(rng, int(n)) for n in rng.integers(0, 900, 80)] + ["x " * 5000, "<|endoftext|> z"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs(spark, *texts).repartition(3), packing.default_tokenizer(), pool=20_000).collect()
    seqs: dict = {}
    for i, t in enumerate(texts, 1):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
    pad = 0
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 1024
        pad += 1024 - end
    assert pad < 0.12 * sum(n for s in seqs.values() for _, n in s)
    assert packing.assign([]) == []


def test_cost_balance():
    pieces = packing.assign([300] * 30 + [20] * 200)
    load: Counter = Counter()
    for _, _, n, s, _ in pieces:
        load[s] += n + n * n / 512
    assert max(load.values()) < 1.7 * sorted(load.values())[len(load) // 2]


def test_ring_is_balanced_and_moves_little(spark):
    d = spark.range(1, 2001).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    got = {n: {r.id: r for r in ring.shard(d, n).collect()} for n in (10, 11)}
    for n, rows in got.items():
        per = Counter(r.shard for r in rows.values())
        assert len(per) == n and max(per.values()) - min(per.values()) <= 1
        for s in per:
            assert sorted(r.slot for r in rows.values() if r.shard == s) == list(range(per[s]))
    assert got[10][3].size == 20 and got[10][3].text_crc32 == zlib.crc32(b"same")
    moved = sum(got[10][i].shard != got[11][i].shard for i in got[10])
    assert moved < 0.5 * 2000
    assert ring.plan({}, 3) == []


def test_segmentation_samples(spark):
    v = segmentation.vocabulary(segmentation.default_model())
    text = "ab the"
    chosen, n = Counter(), 2000
    for found in segmentation.top_k([text] * n, list(range(n)), v, 2):
        assert found[0][2] >= found[1][2] and tuple(found[0][0]) != tuple(found[1][0])
        chosen[tuple(found[0][0])] += 1
    (top, hits), = chosen.most_common(1)
    logp = next(f[0][1] for f in segmentation.top_k([text] * 50, list(range(50)), v, 1) if tuple(f[0][0]) == top)
    p = math.exp(logp)
    assert abs(hits / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9
    odd = ["日本語 x\n\ty\u0000", "", " a  b ", "é" * 300, "😀😀"]
    for t, found in zip(odd, segmentation.top_k(odd, [1] * 5, v, 3)):
        assert all(segmentation.decode(f[0], segmentation.default_model()) == t for f in found)
        assert len({tuple(f[0]) for f in found}) == len(found)
    assert len(segmentation.top_k([""], [1], v, 3)[0]) == 1
    one = segmentation.segment(docs(spark, *odd), segmentation.default_model()).orderBy("id", "sample").collect()
    two = segmentation.segment(docs(spark, *odd).repartition(4), segmentation.default_model()).orderBy("id", "sample").collect()
    assert one == two and all(r.log_inclusion <= 0 for r in one)


def test_language_spans(spark):
    rng = np.random.default_rng(6)
    alphabet = {"aa": "abcde", "bb": "fghij", "ru": "абвгд"}
    def make(lang, n):
        return " ".join("".join(rng.choice(list(alphabet[lang]), 5)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(list(alphabet) * 15)]
    train = spark.createDataFrame([*rows, (90, None, "aa"), (91, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(train, "doc_id", "text", "lang")
    mixed = make("aa", 30) + " " + make("bb", 20) + " " + make("ru", 10)
    r = {x.id: x for x in langid.identify(docs(spark, mixed, None, "12 !", make("ru", 3)), model).collect()}
    assert [s.lang for s in r[1].spans] == ["aa", "bb", "ru"] and r[1].lang_pred == "aa" and abs(r[1].score - 0.5) < 0.01
    assert mixed[r[1].spans[1].start : r[1].spans[1].end].split() == mixed.split()[30:50]
    assert (r[2].lang_pred, r[2].score, r[3].lang_pred, r[4].lang_pred) == ("und", 0.0, "und", "ru")


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(7)
    s = rng.normal(size=(11, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 9, 11])
    got = langid.viterbi(s, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        best = max(product(range(3), repeat=b - a), key=lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:])))
        assert tuple(got[a:b]) == best


def test_marginals_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(8)
    emit, first, trans = rng.normal(size=9), np.array([0, 4, 4, 9]), rng.normal(size=(2, 2))
    got = toxicity.marginals(emit, first, trans)
    for a, b in zip(first[:-1], first[1:]):
        total, on = 0.0, np.zeros(b - a)
        for p in product((0, 1), repeat=b - a):
            w = math.exp(sum(emit[a + i] * x for i, x in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:])))
            total += w
            on += w * np.array(p)
        assert np.allclose(got[a:b], on / total if b > a else [])


def test_toxic_words_are_found(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 80).split()
        bad = i % 4 == 0
        for k in rng.integers(0, 80, 3) if bad else ():
            w[k] = ["vilest", "vilely", "grubby"][k % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(0, 0), (None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 5 <> 0 or doc_id is null"))
    got = {r.id: r for r in toxicity.detect(d, model).collect()}
    held = [i for i in range(400) if i % 5 == 0 and i]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    text = dict(rows)[20]
    assert got[20].spans and {w for s in got[20].spans for w in text[s.start : s.end].split()} <= {"vilest", "vilely", "grubby"}


def test_page_text(spark):
    menu = '<nav><ul><li><a href="/x">m</a></ul></nav><header><h1>Site</h1></header><div class="ad">buy</div>'
    body = "<article><header><h1>T &amp; t</h1></header><p>one <b>b</b>old<p>two<br>lines<aside>no</aside><form>f</form><div id=comments><p>me too</div></article>"
    page = f"<html><head><title>x</title><script>'<p>bad</p>'</script></head><body><!-- c -->{menu}{body}<footer>&copy;</footer>"
    assert styletree.main_text(page) == "T & t one bold two lines"
    assert styletree.main_text(None) == styletree.main_text("") == ""
    assert styletree.main_text("<div>" * 4000 + "deep") == "deep"
    plain = [(i, "http://h.example/%d" % i, f"<body><div class=top>Welcome to us</div><div class=txt><p>story {i} {'w%d ' % i * 20}</div></body>") for i in range(12)]
    rows = plain + [(99, None, None), (100, "http://h.example/1", plain[1][2])]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r.id: r.text for r in styletree.extract(df).collect()}
    assert got[99] == "" and got[3].startswith("story 3 w3") and "Welcome" not in got[3] and got[100] == got[1]
    assert styletree.extract(df.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r") for i, v in rows], "vec_id long, embedding array<float>, id int, raw string")


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [1.0, None] * 4), (440, [float("nan")] * 8), (460, [1.0, 2.0]), (480, [])]
    want = {}
    g = np.floor(x.astype(float) * 64)
    for q in range(0, 300, 20):
        s = g @ g[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:7]
        want[q] = [(k + 1, i, int(s[i])) for k, i in enumerate(order)]
    for size in (1000, 60):
        got: dict = {}
        for r in balltree.top_k(vectors(spark, rows), k=7, shard_rows=size).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(v) for q, v in got.items()} == want
    assert balltree.top_k(vectors(spark, rows[:0])).count() == 0
    assert balltree.top_k(vectors(spark, rows[:5]), k=20).count() == 4


def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 16))
    for i in range(60, 100):
        x[i] = x[60] + 0.12 * rng.normal(size=16)
    x[100:110] = x[99]
    x[110] = 3 * x[99]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [None] * 16), (503, [float("inf")] * 16), (504, [1.0, 2.0])]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = np.arange(240)
    for _ in range(20):
        root = np.array([min([root[i], *root[hit[i]]]) for i in range(240)])
    got = {r.vec_id: r for r in projection.near_duplicates(vectors(spark, rows)).collect()}
    assert [got[i].n_links for i in range(240)] == hit.sum(1).tolist()
    assert [got[i].component_id for i in range(240)] == root.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 505))
    assert projection.near_duplicates(vectors(spark, rows[:0])).count() == 0
    assert projection.passes_for(10**9) > projection.passes_for(10**5)


@pytest.mark.parametrize("least", [projection.TILE_LEAST, 700])
def test_links_of_a_large_component_by_tiles(spark, monkeypatch, least):
    monkeypatch.setattr(projection, "TILE_LEAST", least)
    rng = np.random.default_rng(21)
    x = rng.standard_normal(16) + 0.25 * rng.standard_normal((1500, 16))
    x = np.concatenate((x, x[:3])).astype(np.float32)
    y = x.astype(np.float64)
    y /= np.sqrt((y**2).sum(1, keepdims=True))
    links = y @ y.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in projection.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    held = [i for i in range(len(x)) if got[i].component_id == 0]
    assert len(held) > 1400
    assert all(got[i].n_links == links[i, held].sum() for i in held)


def hot_cluster(n, pairs, seed=31, near=0.8, dim=64):
    """A third of the rows around one centre (cosine near), in it pairs at cosine 0.905 that have no other partner: row i and row i + pairs."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.sqrt((x**2).sum(-1, keepdims=True))
    c = unit(rng.standard_normal(dim))
    e = rng.standard_normal((n // 3, dim))
    e = unit(e - (e @ c)[:, None] * c)
    f = rng.standard_normal((pairs, dim))
    f -= (f @ c)[:, None] * c
    f = unit(f - (f * e[:pairs]).sum(1, keepdims=True) * e[:pairs])
    w = (0.905 - near**2) / (1 - near**2)
    e[pairs : 2 * pairs] = w * e[:pairs] + math.sqrt(1 - w * w) * f
    return np.concatenate((near * c + math.sqrt(1 - near**2) * e, unit(rng.standard_normal((n - len(e), dim))))).astype(np.float32)


def test_pairs_inside_a_dense_group_are_found(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, pairs = 36_000, 1000
    x = hot_cluster(n, pairs)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet")
    got = {r.vec_id: r for r in projection.near_duplicates(df).filter("n_links > 0").collect()}
    found = sum(i in got and i + pairs in got and got[i + pairs].component_id == got[i].component_id for i in range(pairs))
    assert found >= 0.98 * pairs, found


def test_vector_links_are_exact_at_any_size(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, pairs = 36_000, 5000
    x = hot_cluster(n, pairs)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), f"{tmp_path}/v.parquet")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [int(k) - 1 for at in range(0, n, 1000) for k in (u[at : at + 1000] @ u.T >= 0.9).sum(1)]
    got = {r.vec_id: r for r in projection.near_duplicates(spark.read.parquet(f"{tmp_path}/v.parquet")).collect()}
    assert [got[i].n_links for i in range(n)] == want and sum(want) >= 2 * pairs
    assert all(got[i + pairs].component_id == got[i].component_id for i in range(pairs))


@pytest.mark.parametrize("dim", [1, 2, 16, 64, 300])
@pytest.mark.parametrize("passes", [None, 1])
def test_projections_bound_pairs_and_lose_none(dim, passes):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((1500, dim)).astype(np.float32)
    x[500:900] = x[0] + 0.3 * rng.standard_normal((400, dim))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    mult, side = rng.integers(1, 4, 1500), rng.integers(0, 2, 1500)
    for sides, hit in ((np.full(1500, 2), (u @ u.T >= 0.9) & ~np.eye(1500, dtype=bool)), (side, (u @ u.T >= 0.9) & (side[:, None] != side))):
        n, i, j = projection.links(x, sides, mult, passes=passes)
        assert n.tolist() == (hit @ mult).tolist() and hit[i, j].all() and hit.any()
        root = np.arange(1500)
        for a, b in zip(i, j):  # a forest: each pair joins two parts
            assert root[a] != root[b]
            root[root == root[a]] = root[b]
        assert (root[:, None] == root)[hit].all()


@pytest.mark.parametrize("kind", ["inserted", "deleted", "changed"])
def test_near_copies_of_a_passage_are_found(spark, kind):
    rng = np.random.default_rng(41)
    texts = []
    for _ in range(40):
        p = words(rng, 60, "p").split()
        k = int(rng.integers(8, 52))
        near = p[:k] + {"inserted": ["new", p[k]], "deleted": [], "changed": ["new"]}[kind] + p[k + 1 :]
        texts += [f"{words(rng, 100)} {' '.join(p)} {words(rng, 100)}", f"{words(rng, 80)} {' '.join(near)} {words(rng, 90)}"]
    got = {(r.doc, r.rep): r for r in substring.repeated_passages(docs(spark, *texts)).collect()}
    assert set(got) == {(i + 1, i) for i in range(1, 80, 2)}
    assert all(r.word <= 82 and r.word_end >= 137 and r.similarity >= 0.8 for r in got.values())


@pytest.mark.parametrize("name", ["class='site has-sidebar'", "class=no-sidebar", "class=comments-open", "class='with-banner'", "id='ad-free'"])
def test_a_noise_word_on_a_wrapper_keeps_the_article(name):
    around = '<nav>menu</nav><div class="ad">buy</div>'
    assert styletree.main_text(f"<body><div {name}>{around}<article><p>one two<div id=comments>me too</div></article></div></body>") == "one two"
    assert styletree.main_text(f"<body><div {name}>{around}<p>one two three four five</p></div></body>") == "one two three four five"
    assert styletree.main_text(f"<body><article>one two</article><div {name}><article>me too</article></div></body>") == "one two"


def test_the_style_tree_decides_inside_and_outside_marked_articles(spark):
    rng = np.random.default_rng(61)
    def page(i, body, mark):
        return f"<body><div class=top>All news daily</div><{mark}><div class=lead>Read our terms</div><div class=txt><p>{body}</p><div class='related-work'><p>rw{i} {body[:9]}</p></div></div></{mark}></body>"
    rows = []
    for host, mark in (("a", "article"), ("b", "div")):
        for i in range(8):
            rows.append((len(rows), f"http://{host}.example/{i}", page(i, words(rng, 30), mark)))
    rows += [(90 + i, "http://a.example/0", rows[0][2]) for i in range(40)]  # copies of one page count once
    rows += [(200, "http://c.example/", page(0, "only page of its host", "article")), (201, None, page(1, "no host", "div"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in styletree.extract(df).collect()}
    for i, _, h in rows[:56]:
        body = h.split("<p>")[1].split("</p>")[0]
        assert got[i] == f"{body} {h.split('<p>')[2].split('</p>')[0]}", i
    assert got[200] == "Read our terms only page of its host rw0 only page"  # nothing to compare with
    off = styletree.main_text(rows[0][2], frozenset())
    assert "Read our terms" in off and "Read our terms" not in got[0]  # the tree decided


def test_broken_and_deep_pages_cost_one_pass():
    import time

    began = time.time()
    for page in ("<a " + '"' * 10_001 + " x>hi", "<a " + "='" * 10_001 + " x>hi", "<main>" * 5000 + "x", "<div>" * 5000 + "x" + "</div>" * 5000, "<a " * 20_000, "<b>" * 5000 + "</i>" * 5000 + "<p>" * 2000):
        styletree.style_rows(styletree.parse(page))
        styletree.main_text(page)
    assert time.time() - began < 20
    text = styletree.main_text('<article><p>aa</p><div class="related-work"><p>bb</p></div><section id="search"><p>cc</p></section><p class="alert">dd</p><div class="comments"><p>zz</p></div></article>')
    assert text == "aa bb cc dd"


def test_top_k_over_shards_with_copies_and_negative_ids(spark):
    rng = np.random.default_rng(71)
    x = np.concatenate((rng.normal(size=(200, 6)), rng.normal(size=(100, 6)) + 4)).astype(np.float32)
    x[50:150] = x[49]
    ids = np.arange(300) - 120
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(3, x[0].tolist())]
    g = np.floor(np.concatenate((x, x[:1])).astype(float) * 64)
    ids = np.append(ids, 3)
    want = {}
    for q in (i for i in range(-120, 180) if i % 20 == 0):
        s = g @ g[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        want[q] = [(n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)]
    for size, group in ((1000, 1000), (40, 3)):
        got: dict = {}
        for r in balltree.top_k(vectors(spark, rows), k=5, shard_rows=size, query_rows=group).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(v) for q, v in got.items()} == want


def test_queries_skip_shards_that_cannot_matter():
    rng = np.random.default_rng(72)
    x = np.concatenate([rng.normal(size=(500, 8)) + c for c in (0, 60, -60, 200)])
    ids = np.arange(len(x))
    cuts = balltree.Cuts(ids, x, 4)
    home = cuts.home(ids, x)
    assert sorted(np.bincount(home).tolist()) == [500] * 4
    copies = balltree.Cuts(ids, np.ones((2000, 8)), 4).home(ids, np.ones((2000, 8)))
    assert np.bincount(copies).min() > 400
    import pyarrow as pa

    radius = np.array([np.sqrt(((x[home == s] - cuts.centres[s]) ** 2).sum(1)).max() for s in range(4)])
    q = x[-20:]
    floor = np.sort(q @ x[home == home[-1]].T, axis=1)[:, -5]
    b = pa.RecordBatch.from_arrays([pa.array(ids[-20:]), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(np.full(20, 8, np.int32)), pa.array(home[-20:].astype(np.int32)), pa.array(floor)], names=["id", "raw", "dim", "home", "floor"])
    assert sum(x.num_rows for x in balltree._routes({8: (np.arange(4), cuts.centres, radius)})([b])) == 0


def test_one_id_with_two_vectors_and_null_ids(spark):
    e = np.eye(4, dtype=np.float32)
    rows = [(1, e[0]), (2, e[0] + 0.1 * e[3]), (5, e[1]), (5, e[2]), (6, e[1] + 0.1 * e[3]), (7, e[2] + 0.1 * e[3]), (None, e[0]), (8, None)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 0, None, True), (8, 0, 8, True)], key=repr)


def test_tally_keeps_only_pairs_with_the_minimum_of_shared_bytes(spark):
    rng = np.random.default_rng(73)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [int(x) for x in rng.integers(0, 2**63, 400)]
    fps = base + [f ^ (0xFF << 8 * k) for f in base[:60] for k in range(3)] + [(int(rng.integers(0, 2**40)) << 24) | (f & 0xFFFFFF) for f in base[:60]]
    fps = sorted({signed(f) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    agree = lambda a, b: sum(((a ^ b) >> 8 * k) & 255 == 0 for k in range(8))
    index = simhash.postings(df, 3)
    met = index.alias("a").join(index.alias("b"), ["g", "v"]).filter("a.fp < b.fp").select("a.fp", "b.fp").distinct().count()
    got = {(r.src, r.dst) for r in simhash.tallied(index, 3).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if agree(a, b) >= 4} and 0 < len(got) < met


def test_one_id_with_two_texts_in_near_dedup(spark):
    rng = np.random.default_rng(74)
    a, b = words(rng, 200), words(rng, 200)
    d = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (None, "x y z")], "doc_id long, text string")
    got = simhash.near_duplicates(d).collect()
    assert len({r.group for r in got}) == 3 and Counter((r.id, r.component_id) for r in got) == {(5, 5): 2, (7, 5): 1, (9, 5): 1, (None, None): 1}


def test_packing_takes_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(75)
    sizes = rng.integers(100, 1000, 3000).tolist()
    pieces = packing.assign(sizes)
    load, cost, cuts = Counter(), Counter(), Counter(d for d, *_ in pieces)
    for _, _, n, s, _ in pieces:
        load[s] += n
        cost[s] += n + n * n / 512
    assert sorted(load.values())[1] == 1024 and sum(load.values()) == sum(sizes)
    assert sum(c > 1 for c in cuts.values()) < 0.2 * len(sizes)
    # against a plain search over all sequences
    small = rng.integers(20, 400, 120).tolist()
    opened = -(-sum(small) // 1024)
    room, spent = [1024] * opened, [0.0] * opened
    room[-1] = sum(small) - 1024 * (opened - 1)
    whole = {}
    for n, d in sorted(((n, d) for d, n in enumerate(small)), key=lambda x: (-x[0], x[1])):
        fits = [(spent[s], s) for s in range(opened) if room[s] >= n]
        if fits:
            c, s = min(fits)
            spent[s], room[s], whole[d] = c + n + n * n / 512, room[s] - n, s
    got = {}
    for d, start, n, s, _ in packing.assign(small):
        if n == small[d]:
            got[d] = s
    assert all(got[d] == s for d, s in whole.items())


def test_ids_equal_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in ("", "<|endoftext|>", "a<|endoftext|>b", "\x00\x01\x7f\x85\u2028", "\r\n \t\n\n", "'s 'LL don't", "\u00a0\u3000x", "é" * 5000, "x" * 20_000, " " * 5000, "\ud7ff\ufffd\U0010ffff", "123456789 " * 300):
        assert list(encode(t)) == tok.encode(t, add_special_tokens=False).ids, t[:20]


def test_second_samples_and_inclusion_follow_their_law():
    v = segmentation.vocabulary(segmentation.default_model())
    text, n = "ab c", 6000
    every = {tuple(f[0]): math.exp(f[1]) for f in segmentation.top_k([text], [0], v, 200)[0]}
    assert abs(sum(every.values()) - 1) < 1e-6
    first, pair, included, weight = Counter(), Counter(), Counter(), Counter()
    for found in segmentation.top_k([text] * n, list(range(n)), v, 2):
        a, b = (tuple(f[0]) for f in found)
        first[a] += 1
        pair[a, b] += 1
        for f in found:
            included[tuple(f[0])] += 1
            weight[tuple(f[0])] += math.exp(f[1] - f[3])  # p over inclusion: its mean over draws is p
    for (a, b), hits in pair.most_common(5):
        p = every[a] * every[b] / (1 - every[a])
        assert abs(hits / n - p) < 5 * math.sqrt(p * (1 - p) / n)
    for s, _ in included.most_common(3):
        assert abs(weight[s] / n - every[s]) < 0.1 * every[s] + 0.01
    lone = segmentation.top_k([text, "other words", text], [3, 4, 3], v, 2)
    alone = segmentation.top_k([text], [3], v, 2)[0]
    assert [tuple(f[0]) for f in lone[0]] == [tuple(f[0]) for f in alone] == [tuple(f[0]) for f in lone[2]]


def test_decoding_restores_every_text(spark):
    texts = ["日本語 x\n\ty\u0000", "", " a  b ", "é" * 300, "😀😀", None, "plain words " * 50]
    rows = segmentation.decoded(segmentation.segment(docs(spark, *texts), segmentation.default_model()), segmentation.default_model()).collect()
    for r in rows:
        t = texts[r.id - 1] or ""
        assert r.decoded == t and r.decoded_crc32 == zlib.crc32(t.encode())


def test_few_rows_move_to_a_new_shard(spark):
    counts = Counter(int(c) for c in np.random.default_rng(76).integers(0, ring.CELLS, 200_000))
    owner = []
    for n in (40, 41):
        at: dict = {}
        for cell, lo, hi, s, _ in ring.plan(counts, n):
            at.setdefault(cell, []).append((lo, hi, s))
        owner.append(at)
    moved = 0
    for cell in counts:
        for r in range(counts[cell]):
            a, b = (next(s for lo, hi, s in o[cell] if lo <= r < hi) for o in owner)
            moved += a != b
    assert moved < 0.08 * 200_000  # 1 of 41 is the least


def test_ring_places_rows_as_a_walk_does():
    rng = np.random.default_rng(77)
    cells = rng.integers(0, ring.CELLS, 500).tolist()
    counts = Counter(cells)
    nodes, room = ring.ring(7, 5), [500 // 7 + (s < 500 % 7) for s in range(7)]
    want = Counter()
    for cell in sorted(cells):
        i = next((k for k, (p, _) in enumerate(nodes) if p >= cell), 0)
        while not room[nodes[i % len(nodes)][1]]:
            i += 1
        s = nodes[i % len(nodes)][1]
        room[s] -= 1
        want[cell, s] += 1
    got = Counter()
    for cell, lo, hi, s, _ in ring.plan(counts, 7, 5):
        got[cell, s] += hi - lo
    assert got == want


def test_null_ids_in_the_learned_queries(spark, tmp_path):
    rng = np.random.default_rng(78)
    rows = [(i if i % 7 else None, words(rng, 40, "ab"[i % 2]), "xy"[i % 2], "s", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (langid.op6_langid, toxicity.op10_toxicity):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 60 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_held_rows_find_their_lead_without_a_join(spark):
    from quire.llm import substring
    from quire.plans import checks

    held = spark.createDataFrame([(k, k % 2, n, 0, n) for k in (1, 2, 3) for n in range(5)], "key long, salt long, doc long, h int, place int")
    lead = spark.createDataFrame([(1, 1, 7, 1, 3), (2, 0, 8, 2, 4), (9, 0, 9, 9, 9)], "key long, salt long, rep long, rep_h int, rep_place int")
    led = substring._led(held, lead)
    assert not [n for n in checks.nodes(led) if "Join" in n]
    assert sorted(map(tuple, led.collect())) == sorted(map(tuple, held.join(lead, ["key", "salt"]).collect())) and led.count() == 10
