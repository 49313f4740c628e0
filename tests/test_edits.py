"""The relational editor against the commands one after another, the guards, and points in ranges."""

import random

from pyspark.sql import functions as F

from quire.operators import edits, headings, intervals
from quire.plans import checks
from tests import edits_model

TITLES = ["Alpha", "Beta", "Gamma", "Intro", "##", "New One", "Alpha Beta", "Beta Gamma", "x", "Über"]


def frame(spark, docs):
    return spark.createDataFrame([(k, n, x) for k, lines in docs for n, x in enumerate(lines)], "doc_id long, line_no int, line string")


def document(rng):
    out = []
    for _ in range(rng.randint(0, 22)):
        t, deep = rng.choice(TITLES), f"<!-- heading-level: {rng.randint(7, 9)} -->"
        out += rng.choices(
            [["#" * rng.randint(1, 9) + " " + t], [deep, "#" * rng.randint(1, 8) + " " + t], [rng.choice(["", " "])], [f"<!-- page: {rng.choice(['3', 'iv', '7', 'V'])} -->"], [rng.choice(["```", "~~~"])], [f"**{t}**"], [t], [deep], [rng.choice(["[^1]: x", "> q", "| a |", "- li"])], ["text"]],
            [30, 10, 20, 5, 5, 5, 5, 3, 4, 13],
        )[0]
    return out or [""]


def outline(rng):
    return [rng.choice(["# ", "## ", "- ", "  - "]) + rng.choice(TITLES) + rng.choice(["", " (3)", " ..... 7", ", p. iv", ""]) for _ in range(rng.choice([0, rng.randint(1, 6)]))]


def commands(rng, n):
    at = lambda: f"{rng.randint(1, n + 4)}"
    kinds = [lambda: f"RETITLE|{at()}|{rng.choice(TITLES)}", lambda: f"RELEVEL|{at()}|{rng.randint(1, 9)}", lambda: f"MERGE|{at()}", lambda: f"MERGE|{at()}", lambda: f"DEMOTE|{at()}", lambda: f"PROMOTE|{at()}|{rng.randint(1, 9)}", lambda: f"INSERT|{at()}|{rng.randint(1, 9)}|{rng.choice(TITLES)}"]
    return [rng.choice(kinds)() for _ in range(rng.randint(0, 16))]


def test_commands_that_meet_give_what_one_after_another_gives(spark):
    rng = random.Random(11)
    docs = [(k, document(rng), outline(rng)) for k in range(600)]
    asked = [(k, commands(rng, len(d))) for k, d, _ in docs]
    parsed = edits.parse_commands(frame(spark, asked)).cache()
    in_order = {}
    for r in parsed.orderBy("doc_id", "seq").collect():
        in_order.setdefault(r.doc_id, []).append((r.action, r.line, r.level, r.text))
    got = {r.doc_id: r for r in edits.apply_commands(frame(spark, [x[:2] for x in docs]), parsed, frame(spark, [x[::2] for x in docs])).collect()}
    total = 0
    for k, d, o in docs:
        text, counts = edits_model.edited(d, in_order.get(k, []), o)
        assert got[k].text == text, (d, o, in_order.get(k))
        assert {c: got[k][c] for c in counts} == counts, (d, o, in_order.get(k))
        total += sum(counts.values())
    assert total > 2500 and len(got) == len(docs)


def test_lines_are_shuffled_once_and_stay_in_the_jvm(spark):
    lines, o = frame(spark, [(1, ["# A", "text"])]), frame(spark, [(1, ["# B"])])
    plan = edits.apply_commands(lines, edits.parse_commands(frame(spark, [(1, ["DEMOTE|1"])])), o)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "SortMergeJoin" not in plan.split("Union")[0]  # from the result down to where the small sides come in
    assert plan.split("Union")[0].count("Exchange") == 0


def test_commands_and_outlines_are_read_once(spark):
    asked = edits.parse_commands(frame(spark, [(1, ["DEMOTE | 1", "INSERT|2|3|B|c", "- retitle|1| a ", "RELEVEL|1|0", "MERGE"])]))
    assert sorted(map(tuple, asked.collect())) == [(1, 0, "demote", 1, None, None), (1, 1, "insert", 2, 3, "B|c"), (1, 2, "retitle", 1, None, "a")]
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    done = edits.apply_commands(frame(spark, [(1, ["# A", "", "text", ""])]), asked, frame(spark, [(1, ["# A", "- B|c (4)"])]))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "split(line" in plan and r"\.{3,}" not in plan and "upper(" not in plan
    assert [(r.text, r.demote, r.insert, r.retitle, r.rejected) for r in done.collect()] == [("**a**\n\ntext\n\n### B|c\n", 1, 1, 1, 0)]  # behind the first blank line from the one after the named


def test_documents_whose_model_failed_stay(spark):
    lines = frame(spark, [(1, ["# A", "####### B"]), (2, ["# A"]), (3, ["plain"]), (4, ["plain"])])
    asked = edits.parse_commands(frame(spark, [(1, ["DEMOTE|1"]), (2, ["DEMOTE|1"]), (3, ["PROMOTE|1|2"]), (4, ["PROMOTE|1|2"])]))
    o = frame(spark, [(4, ["# plain"])])
    failed = spark.createDataFrame([(1,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in edits.apply_commands(lines, asked, o, failed).collect()}
    assert got[1].text.split("\n") == ["# A", "<!-- heading-level: 7 -->", "###### B"] and got[1].demote == got[1].rejected == 0
    assert got[2].text == "**A**" and got[2].demote == 1
    assert got[3].text == "plain" and got[3].rejected == 0  # neither headings nor an outline: nothing is asked
    assert got[4].text == "## plain" and got[4].promote == 1


def test_summary(spark):
    lines = frame(spark, [(1, ["# A", "", "#### B"]), (2, ["x"])])
    done = edits.apply_commands(lines, edits.parse_commands(frame(spark, [(1, ["RELEVEL|3|5", "DEMOTE|9"])])), frame(spark, []))
    after = headings.structural_report(headings.collect_headings(headings.split_lines(done)))
    assert {r.doc_id: r.summary for r in edits.correction_summary(done, after).collect()} == {
        1: "Heading correction: 1 releveled, 1 rejected — 2 headings, 1 level jump(s), deepest H5",
        2: "Heading correction: no changes needed — 0 headings, 0 level jump(s), deepest H0",
    }


def test_no_documents(spark):
    none = frame(spark, [])
    assert edits.apply_commands(none, edits.parse_commands(none), none).collect() == []


def test_points_in_ranges_against_all_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice([1, 2, None]), rng.choice([None, *range(-50, 3000, 7)])) for _ in range(400)]
    bounds = [(rng.choice([1, 2, None]), lo, lo + rng.choice([-3, 0, 1, 2, 15, 16, 17, 300, 100_000])) for lo in (rng.choice([-40, 0, 5, 255, 256, 2000]) for _ in range(300))] + [(1, None, 5), (1, 5, None)]
    got = intervals.contained(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(bounds, "k int, start long, end long"), ["k"], "at")
    want = sorted((k, p, lo, hi) for k, p in points for k2, lo, hi in bounds if k is not None and k == k2 and None not in (p, lo, hi) and lo <= p < hi)
    assert sorted((r.k, r.at, r.start, r.end) for r in got.collect()) == want and len(want) > 3000


def test_a_range_is_in_two_bins_at_most(spark):
    long = spark.createDataFrame([(1, 15, 15 + n) for n in (1, 2, 16, 17, 4096, 2**31)], "k int, start long, end long")
    low, high = F.col("start"), F.col("end")
    bins = F.floor((high - 1) / intervals._width(intervals._level(high - low))) - F.floor(low / intervals._width(intervals._level(high - low))) + 1
    assert {r.n <= 2 for r in long.select(bins.alias("n")).collect()} == {True}


def test_page_spans_and_the_guard_of_insertions(spark):
    lines = frame(spark, [(1, ["a", "<!-- page: IV -->", "b", "<!-- page: 2 -->", "c", "<!-- page: iv -->", "d"]), (2, ["x"])])
    assert sorted(tuple(r) for r in intervals.page_spans(lines).collect()) == [(1, "2", 3, 5), (1, "iv", 1, 3)]
    places = spark.createDataFrame([(1, 2, "iv"), (1, 3, "Iv"), (1, 6, "iv"), (1, 4, "2"), (1, 0, "9"), (2, 0, "1")], "doc_id long, line_no int, page string")
    assert sorted(tuple(r) for r in intervals.inside_pages(places, lines).collect()) == [(1, 0, "9"), (1, 2, "iv"), (1, 4, "2"), (2, 0, "1")]


def test_pages_of_lines_take_one_shuffle(spark):
    text = ["a", "<!-- page: IV -->", "b", "<!-- page: 2 -->", "c", "<!-- page: iv -->", "d", "<!-- page: 3 -->"]
    lines = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(text[k - 1 :])] + [(None, 0, "<!-- page: 1 -->"), (3, None, "<!-- page: 1 -->"), (4, 0, "none")], "doc_id long, line_no int, line string")
    by_bins = intervals.contained(lines.select("doc_id", "line_no"), intervals.page_spans(lines.dropna()), ["doc_id"], "line_no").select("doc_id", "line_no", "page")
    got = intervals.pages_of(lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_bins.collect())) == [(1, 1, "iv"), (1, 2, "iv"), (1, 3, "2"), (1, 4, "2"), (1, 7, "3"), (2, 0, "iv"), (2, 1, "iv"), (2, 2, "2"), (2, 3, "2"), (2, 6, "3")]
    assert checks.shuffles(intervals.pages_of(lines)) == 1


def test_the_guard_of_insertions_deals_nothing_to_bins(spark):
    lines = spark.createDataFrame([(1, 0, "<!-- page: 1 -->"), (1, 1, "x"), (1, 2, "<!-- page: 2 -->")], "doc_id long, line_no int, line string")
    places = spark.createDataFrame([(1, 1, "1"), (1, 2, "1"), (1, 1, None), (None, 1, "1"), (1, None, "1"), (1, None, "8"), (2, 5, "1")], "doc_id long, line_no int, page string")
    inside = intervals.inside_pages(places, lines)
    assert sorted(map(str, map(tuple, inside.collect()))) == sorted(map(str, [(1, 1, "1"), (1, 1, None), (None, 1, "1"), (1, None, "8"), (2, 5, "1")]))
    plan = intervals.inside_pages(places, lines)
    assert checks.nodes(plan)["Generate"] == 0 and checks.shuffles(plan) <= 3, checks.physical(plan)
