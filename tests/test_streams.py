"""Streams that stop and go on: the same rows as at once, and no row twice where a batch is run again."""

import json
import os
import random

from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.operators import folds, jobs
from quire.streaming.answers import answers
from quire.streaming.batches import commit, run_available, upserted

PIECES = "doc_id long, seq long, piece string"


def answer(rng, k):
    words = [rng.choice(["a", " b", "é", "\n", '"q"', "中"]) for _ in range(rng.randint(0, 12))]
    lines = [f"data: {json.dumps({'choices': [{'delta': {'content': w}}]}, ensure_ascii=rng.random() < 0.5)}" for w in words]
    extra = ["data: {bad", ": ping", "", "data: {}", "data: 7", 'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":null}}]}', 'data: {"error":null}', "data:no"]
    for _ in range(rng.randint(0, 4)):
        lines.insert(rng.randint(0, len(lines)), rng.choice(extra))
    if k % 5 == 0:
        lines.insert(rng.randint(0, len(lines)), rng.choice(['data: {"error":{"message":"no"}}', 'data: {"error":{}, "choices":[]}', 'data: {"error":"x"}']))
    whole = "\n".join([*lines, "data: [DONE]"]) + rng.choice(["\n", ""])
    cuts = sorted(rng.sample(range(len(whole) + 1), min(4, len(whole))))
    return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]


def expected(pieces):
    try:
        return M.sse_text(pieces), None
    except RuntimeError as e:
        return None, str(e)


def write(spark, rows, kind, folder, name):
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    os.makedirs(f"{folder}/in", exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}/tmp-{name}") if f.startswith("part-") and f.endswith(".parquet"))
    os.rename(f"{folder}/tmp-{name}/{part}", f"{folder}/in/{name}.parquet")


def test_answers_put_together_in_columns(spark):
    rng = random.Random(1)
    docs = [answer(rng, k) for k in range(200)]
    got = {r.doc_id: (r.text, r.error) for r in folds.streamed_texts(spark.createDataFrame([(k, n, p) for k, d in enumerate(docs) for n, p in enumerate(d)], PIECES)).collect()}
    assert got == {k: expected(d) for k, d in enumerate(docs)}
    plan = folds.streamed_texts(spark.createDataFrame([(1, 0, "")], PIECES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_answers_as_a_stream_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    docs = {k: answer(rng, k) for k in range(40)}
    pieces = [(k, n, p) for k, d in docs.items() for n, p in enumerate(d)]
    rng.shuffle(pieces)  # pieces come early too
    third = len(pieces) // 3
    folder = str(tmp_path)
    for name, part in (("0", pieces[:third]), ("1", pieces[third : 2 * third] + pieces[:5]), ("2", pieces[2 * third :])):  # some come twice
        write(spark, part, PIECES, folder, name)
        run_available(spark, f"{folder}/in", PIECES, answers, f"{folder}/out", f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r.doc_id, r.seq) for r in rows) == sorted((k, n) for k, n, _ in pieces)
    for k, d in docs.items():
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.seq)
        text, error = expected(d)
        assert own[-1].error == error
        if error is None:
            assert "".join(r.text for r in own) == text
            assert [r.chars for r in own] == [sum(len(x.text) for x in own[: n + 1]) for n in range(len(own))]
            assert own[-1].done is "".join(d).endswith("[DONE]\n")  # noqa: F632
    assert len({r.epoch for r in rows}) == 3


def test_skipped_models_of_a_session_as_a_stream(spark, tmp_path):
    kind, folder = "session string, model string, reason string, at long", str(tmp_path)
    for name, part in (("0", [("s", "m", "first", 1), ("s", "n", "other", 2)]), ("1", [("s", "m", "second", 3), ("t", "m", "mine", 1)]), ("2", [("s", "m", "late but older", 0)])):
        write(spark, part, kind, folder, name)
        run_available(spark, f"{folder}/in", kind, jobs.session_skips, f"{folder}/out", f"{folder}/state", mode="update")
    got = sorted(tuple(r) for r in upserted(spark, f"{folder}/out", "session", "model").select("session", "model", "reason").collect())
    assert got == [("s", "m", "second"), ("s", "n", "other"), ("t", "m", "mine")]


def test_a_micro_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    kind, folder = "doc_id long, batch_no int, text string", str(tmp_path)
    for name, part in (("0", [(1, 0, "a"), (1, 1, "b")]), ("1", [(1, 1, "c"), (2, 0, "d")])):
        write(spark, part, kind, folder, name)
        run_available(spark, f"{folder}/in", kind, lambda d: d, f"{folder}/out", f"{folder}/state")
    once = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert len(once) == 4
    for f in ("1", ".1.crc"):  # as if the run had died between the write and its commit
        os.remove(f"{folder}/state/commits/{f}")
    run_available(spark, f"{folder}/in", kind, lambda d: d, f"{folder}/out", f"{folder}/state")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == once
    assert sorted(map(tuple, upserted(spark, f"{folder}/out", "doc_id", "batch_no").collect())) == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d")]
    commit(spark.createDataFrame([(1, 0, "z")], kind), 0, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").filter("epoch = 0").count() == 1


def test_progress_by_characters_is_that_of_the_batch_operator(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c")], PIECES)
    assert [r.chars for r in jobs.text_progress(rows).orderBy("seq").collect()] == [2, 3]
    assert rows.select(F.max("seq")).first()[0] == 1
