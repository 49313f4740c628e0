"""Settings of every version against the steps taken one after another."""

import json
import random

from quire.operators import settings as S


def stepwise(text):
    fresh = {"activeProvider": "gemini", "scanProvider": "gemini", "transcribeProvider": "gemini", "translateProvider": "gemini", "providerModelPriority": S.MODELS, "stageModelPriority": {}, "openrouterAutoFreeModels": True, "headingCorrectionEnabled": True, "headingCorrectionDefaultOnApplied": True, "translationLanguages": S.LANGUAGES, "customActiveConfigId": "manual"}
    try:
        p = json.loads(text)
        assert isinstance(p, dict)
    except (ValueError, TypeError, AssertionError):
        return fresh
    if "model" in p and "modelPriority" not in p:
        old = p.pop("model")
        p["modelPriority"] = [old, *(m for m in S.MODELS["gemini"] if m != old)]
    if "modelPriority" in p and "providerModelPriority" not in p:
        p["providerModelPriority"] = {"gemini": p["modelPriority"] or S.MODELS["gemini"], "anthropic": S.MODELS["anthropic"], "openrouter": []}
        del p["modelPriority"]
    p.setdefault("activeProvider", "gemini")
    if p.get("providerModelPriority"):
        for k, v in S.MODELS.items():
            if p["providerModelPriority"].get(k) is None:
                p["providerModelPriority"][k] = v
    p.setdefault("customActiveConfigId", "manual")
    p.setdefault("openrouterAutoFreeModels", True)
    if "scanProvider" not in p:
        for r in S.ROLES:
            p[r] = p["activeProvider"]
    own = (p.get("providerModelPriority") or {}).get("anthropic") or []
    if S.INVALID in own:
        kept = [m for m in own if m != S.INVALID]
        p["providerModelPriority"]["anthropic"] = S.MODELS["anthropic"] if kept in ([], [S.OUTDATED]) else kept
    for stage in (p.get("stageModelPriority") or {}).values():
        if S.INVALID in (stage.get("anthropic") or []):
            if kept := [m for m in stage["anthropic"] if m != S.INVALID]:
                stage["anthropic"] = kept
            else:
                del stage["anthropic"]
    if not p.get("headingCorrectionDefaultOnApplied"):
        p["headingCorrectionEnabled"] = p["headingCorrectionDefaultOnApplied"] = True
    if p.get("translationLanguages") is not None and "English" not in p["translationLanguages"]:
        p["translationLanguages"] = S.LANGUAGES
    return fresh | p


def some(rng):
    p = {}
    maybe = lambda k, *values: p.update({k: rng.choice(values)}) if rng.random() < 0.45 else None
    lists = lambda: rng.choice([[], [S.INVALID], [S.INVALID, S.OUTDATED], [S.OUTDATED], ["a", S.INVALID], ["b"]])
    maybe("model", "gemini-2.5-flash", "mine")
    maybe("modelPriority", [], ["x", "y"])
    if rng.random() < 0.5:
        p["providerModelPriority"] = {k: lists() for k in S.MODELS if rng.random() < 0.5}
        p["providerModelPriority"] |= {"openai": None} if rng.random() < 0.2 else {}
        p["providerModelPriority"] = p["providerModelPriority"] or {"other": ["z"]}
    maybe("activeProvider", "openai", "mistral")
    maybe("scanProvider", "custom")
    maybe("transcribeProvider", "custom")
    maybe("customActiveConfigId", "c1")
    maybe("openrouterAutoFreeModels", False, True)
    maybe("stageModelPriority", {}, {"scan": {"anthropic": lists(), "openai": ["q"]}, "translate": {"anthropic": lists()}})
    maybe("headingCorrectionEnabled", False, True)
    maybe("headingCorrectionDefaultOnApplied", False, True)
    maybe("translationLanguages", [], ["Spanish"], ["Latin", "English"])
    maybe("batchSize", 3, 7)
    maybe("outputNotes", "", 'a "quoted" one')
    return json.dumps(p)


def test_every_version_comes_up_to_date(spark):
    rng = random.Random(6)
    texts = [some(rng) for _ in range(500)] + ["{}", "", None, "[]", "7", "{bad", "null"]
    rows = S.up_to_date(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json string")).orderBy("id").collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        want, got = stepwise(text), row.asDict(recursive=True)
        for k in (k for k in S.FIELDS if k not in ("model", "modelPriority")):
            assert got[k] == want.get(k), (k, text)
        rest = {k: v if isinstance(v, str) else json.dumps(v) for k, v in want.items() if k not in S.FIELDS}
        assert (got["rest"] or {}) == rest, text


def test_up_to_date_settings_stay(spark):
    rng = random.Random(7)
    first = S.up_to_date(spark.createDataFrame([(i, some(rng)) for i in range(50)], "id int, json string")).drop("rest", "ok")
    again = first.selectExpr("id", "to_json(struct(* except (id)), map('ignoreNullFields', 'false')) AS json")
    second = S.up_to_date(again).drop("rest", "ok")
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_steps_are_columns(spark):
    plan = S.up_to_date(spark.createDataFrame([(1, "{}")], "id int, json string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
