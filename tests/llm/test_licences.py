"""The automaton against all substrings, chains against their definition, phrases against a plain search."""

import random
import re

from quire.llm import licences
from quire.llm.licences import Automaton, Scanner, chain, words_of


def test_automaton_against_all_substrings():
    rng = random.Random(1)
    letters = [b"a", b"b", b"c", b"d"]
    for _ in range(400):
        texts = [[rng.choice(letters[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 3))]
        spoken = [x[i : i + rng.randint(1, 3)] for x in texts for i in [rng.randrange(len(x))]]
        a, every = Automaton(texts + spoken, spoken, 2), texts + spoken
        known = {tuple(x[i:j]) for x in every for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        doc = [rng.choice([*letters, b"z"]) for _ in range(30)]
        got = {end: (state, n) for end, state, n in a.matches(doc)}
        for end in range(1, 31):
            longest = max(n for n in range(end + 1) if not n or tuple(doc[end - n : end]) in known)
            assert got.get(end, (0, 0))[1] == longest
            if longest:
                state = got[end][0]
                assert [p for p in a.marks[state] if a.phrase_length[p] <= longest] == sorted((p for p, s in enumerate(spoken) if doc[max(0, end - len(s)) : end] == s), key=lambda p: (len(spoken[p]), p))
            if longest >= 2:
                assert a.ends[state] == sorted((t, j) for t, x in enumerate(every) for j in range(longest, len(x) + 1) if x[j - longest : j] == doc[end - longest : end])


def test_states_grow_with_the_templates_only():
    s = Scanner()
    assert len(s.automaton.next) <= 2 * (sum(s.sizes) + sum(s.automaton.phrase_length)) + 1


def test_chains():
    assert chain([(10, 10, 10), (25, 24, 12)]) == [(0, 25, 0, 24, 22)]  # small gaps
    assert chain([(10, 10, 10), (60, 24, 12)]) == [(0, 10, 0, 10, 10), (48, 60, 12, 24, 12)]  # too far in the text
    assert chain([(10, 20, 10), (25, 10, 10)]) == [(0, 10, 10, 20, 10), (15, 25, 0, 10, 10)]  # backwards in the template
    assert chain([(10, 10, 10), (16, 16, 8)]) == [(0, 16, 0, 16, 16)]  # overlapping: cut at its head
    assert chain([]) == []


def test_near_copies_of_a_template_are_one_span():
    s = Scanner()
    template = words_of(licences.TEMPLATES[1][1])
    for k in range(len(template)):  # one word left out, one changed
        for words in (template[:k] + template[k + 1 :], template[:k] + [b"zzz"] + template[k + 1 :]):
            spans = [x for x in s.scan([b"before", *words, b"after"])[1] if x[0] == 1]
            assert max(x[5] for x in spans) >= len(template) - 6
    assert s.scan(words_of("The rest of this text says that the licensed pilot may not use it without warranties."))[1] == []


def test_query_against_a_plain_search(spark, tmp_path):
    rng = random.Random(2)
    parts = ["MIT License", "the Apache  License, 2.0", "general PUBLIC-license", "mit", "license", "İ", "foo", "Über", "general public", "Licensed under CC BY-NC 4.0.", "x_y", "7"]
    texts = [None, "", "--- \n", "MIT LICENSE " * 20_000] + [rng.choice(" ,\n").join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [(i, t, "p", 2) for i, t in enumerate(texts)] + [(None, "mit license", "p", 2), (5, texts[5], "p", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, places string, id int").write.parquet(str(tmp_path / "documents.parquet"))
    got = licences.op12_licences(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_key = {(r.doc_id if r.doc_id is not None else -1): r for r in got}
    for key, text, *_ in rows:
        r = by_key[-1 if key is None else key]
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        hits = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for n in [len(phrase.split())] for i in range(len(w) - n + 1) if w[i : i + n] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(hits)
        if "CC BY-NC" in (text or ""):
            assert "cc-by-nc" in r.labels.split(",")


def test_empty_table(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id string, text string")).collect() == []
