"""Folds and chains against one document after another."""

import random

from quire.functions import markdown as M
from quire.operators import folds
from quire.plans import lineage


def frame(spark, docs):
    return spark.createDataFrame([(k, n, x) for k, d in enumerate(docs) for n, x in enumerate(d)], "doc_id long, line_no int, line string")


def test_repeats_by_window_level_text_and_parent(spark):
    rng = random.Random(1)
    docs = []
    for _ in range(300):
        d = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            title = rng.choice(["A", "B", "A ", "Notes"])
            d += [f"{'#' * rng.randint(1, 4)} {title}"] if kind < 0.5 else [f"<!-- heading-level: {rng.randint(7, 9)} -->", f"###### {title}"] if kind < 0.7 else ["text"] * rng.randint(1, 4)
        docs.append(d)
    for window in (0, 3, 10, 60):
        got = {}
        for r in folds.repeated_headings(frame(spark, docs), window).collect():
            got.setdefault(r.doc_id, set()).add(r.line_no)
        assert {k: got.get(k, set()) for k in range(len(docs))} == {k: M.repeated_headings(d, window) for k, d in enumerate(docs)}
    left = {}
    for r in folds.drop_repeated_headings(frame(spark, docs), 10).orderBy("doc_id", "line_no").collect():
        left.setdefault(r.doc_id, []).append(r.line)
    assert left == {k: kept for k, d in enumerate(docs) if (kept := [x for i, x in enumerate(d) if i not in M.repeated_headings(d, 10)])}


def test_repeats_fold_in_the_jvm(spark):
    plan = folds.drop_repeated_headings(frame(spark, [["# A"]]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_many_headings_of_one_level_are_one_pass():
    lines = [f"# {i}" for i in range(20_000)]
    assert M.repeated_headings(lines) == set()


def test_ranges_are_cut_at_blank_lines(spark):
    rng = random.Random(2)
    docs = [[rng.choice(["", "", " ", "a", "a b c", " lead", "one two three four five"]) for _ in range(rng.randint(1, 60))] for _ in range(150)] + [[""], ["a"], ["a", ""], ["", "", ""]]
    for most in (1, 2, 7, 30, 20_000):
        got = {}
        for r in folds.correction_ranges(frame(spark, docs), most).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert got == {k: M.correction_ranges(d, most) for k, d in enumerate(docs)}


def test_chains_by_doubling(spark):
    rng = random.Random(3)
    links, want = [], set()
    for k in range(30):
        n = rng.choice([1, 2, 3, 64, 65, 200])
        nodes = sorted(rng.sample(range(1000), n))
        links += [(k, a, b) for a, b in zip(nodes, [*nodes[1:], None])] + [(k, 2000 + i, rng.choice(nodes)) for i in range(5)]
        want |= {(k, x) for x in nodes}
    df = spark.createDataFrame(links, "k int, a long, b long")
    first = df.groupBy("k").min("a").withColumnRenamed("min(a)", "a")
    got = [tuple(r) for r in lineage.chained(df, first, ["k"], "a", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    assert lineage.chained(df.limit(0), first.limit(0), ["k"], "a", "b").count() == 0
