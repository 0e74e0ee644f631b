"""Judges, prompts, audits, plans and report sinks on small tables with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import judging
from millrace.operators import audit, evaluate, resume
from millrace.sources import plan, sinks


def test_judges_and_errors(spark):
    rows = [("Mock:x", None, None), ("scripted:y", "Billing", "x:1"), ("a", "429 RATE_LIMIT", "deterministic-2"), (None, "HTTP 503", "z"), ("b", "who knows", None)]
    df = spark.createDataFrame(rows, "model string, error string, judge string")
    family = judging.judge_family(F.when(F.col("judge") == "z", "own").otherwise("unknown"), F.col("judge"))
    got = df.select(judging.is_mock(F.col("model")), judging.diagnosis(F.col("error")), family, judging.self_judged(family, F.lit("x"))).collect()
    assert [tuple(r) for r in got] == [
        (True, None, "unknown", None), (True, "BILLING", "x", True), (False, "RATE_LIMITED", "deterministic", None), (False, "INFRASTRUCTURE", "own", False), (False, "UNKNOWN_ERROR", "unknown", None),
    ]


def test_prompts_fill_their_places_once(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    got = df.select(judging.prompt("{a}-{b}-{c}-{a}", a=F.col("a"), b=F.col("b")), judging.prompt("", a=F.col("a"))).first()
    assert tuple(got) == ("{b}--{c}-{b}", "")
    history = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([([("user", " hi\n"), ("assistant", "so?")],), ([],), (None,)], f"h {history}")
    assert [r[0] for r in rows.select(judging.dialogue(F.col("h"))).collect()] == ["LEARNER: hi\n\nTUTOR: so?", judging.NO_TURNS, judging.NO_TURNS]


def test_evaluation_of_nulls_and_errors(spark):
    good = '{"spec_adherence": 0.9, "robustness": 1, "hint_relevance": 1, "pass": true, "failure_reasons": []}'
    rows = [("What do you see there?", good, None), ("What do you see there?", None, None), (None, good, None), ("What do you see there?", good, "503"), ("What do you see there?", "no json", None)]
    out = evaluate.evaluated(spark.createDataFrame(rows, "r string, a string, e string"), F.col("r"), F.lit(None).cast("boolean"), F.col("a"), F.col("e")).collect()
    assert [(r["passed"], r["failure_reasons"], r["error_kind"], r["warnings"]) for r in out] == [
        (True, [], "none", []), (False, ["LOW_QUALITY"], "none", ["judge_unavailable"]), (False, ["EMPTY_RESPONSE"], "none", []), (False, ["MODEL_ERROR"], "infrastructure", None),
        (False, ["LOW_QUALITY"], "none", ["no object"]),
    ]


def test_payloads(spark):
    whole = {"code": "```js\nx = 1\n```", "student_message": " m ", "expected_bug": "b", "expected_fix": "f", "tutor_response": "r", "conversation_history": [{"role": "User", "content": " q "}, {"role": "assistant", "content": "a"}]}
    odd = [whole | {"code": " "}, whole | {"conversation_history": []}, whole | {"conversation_history": whole["conversation_history"][:1]}, whole | {"conversation_history": [{"role": "x", "content": "y"}, {"role": "user", "content": ""}]}, whole | {"conversation_history": "text"}]
    rows = [(json.dumps(p),) for p in [whole, *odd]] + [("{",), (None,)]
    out = evaluate.built(spark.createDataFrame(rows, "p string"), F.col("p"), F.lit(1)).collect()
    assert [r["problems"] for r in out][:6] == [[], ["missing_code"], ["history_missing"], ["history_incomplete"], ["history_bad_turn"], ["history_no_list"]]
    assert all(r["problems"] for r in out[6:])
    first = out[0]["candidate"]
    assert (first["code"], first["student_message"], first["history"][0]["role"], first["history"][0]["content"]) == ("x = 1", "m", "user", "q")
    assert all(r["candidate"] is None for r in out[1:])


def test_audit_of_an_empty_set_and_moved_rows(spark):
    rows = spark.createDataFrame([(1, "rejected", ["X"], True), (2, "rejected", ["Y"], False), (3, "accepted", [], None)], "id long, status string, codes array<string>, away boolean")
    got = audit.gate_status(audit.reclassified(rows, F.col("away"))).first()
    assert (got["accepted"], got["rejected"], got["unjudged"], got["judged"], got["complete"], got["acceptance_rate"], got["conserved"]) == (1, 1, 1, 2, False, 0.5, True)
    none = audit.gate_status(rows.limit(0)).first()
    assert (none["candidates"], none["acceptance_rate"], none["complete"]) == (0, 0.0, True)
    members = spark.createDataFrame([(2, "a", 1), (2, "b", 2), (4, "a", 1), (4, "c", 2)], "subset long, id string, place long")
    assert [tuple(r) for r in audit.nesting_checks(members, [2, 4]).collect()] == [(2, 4, False, False)]


def test_caches_take_the_first(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", 2, 5), ("a", 1, 9), ("b", 1, None), ("b", 3, 7)], "k string, at int, v int")
    assert {r["k"]: r["v"] for r in resume.with_cached(df, cache, "k", "v", F.col("at")).collect()} == {"a": 9, "b": 7, "c": None}


def test_plans_are_stable_and_follow_their_weights(spark):
    rows = plan.sample_plan(spark, 6000).collect()
    assert rows[:50] == plan.sample_plan(spark, 50).collect()
    share = sum(r["pressure"] == "normal" for r in rows) / len(rows)
    assert abs(share - 0.191) < 0.02
    for r in rows:
        assert r["category"] in plan.CATEGORIES[r["language"]] and not (r["turns"] == 0 and r["pressure"] in plan.LATER)
        assert (r["progress"] == "solved") == (r["pressure"] == "solved")


def test_criteria_files(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "criteria.yaml"
    path.write_text("criteria:\n- {failure_code: A, applies_when: unsolved, blocking: true, weight: 0.5, kind: violation}\n- {failure_code: B, applies_when: always, weight: 0.5, kind: quality}\n")
    a, b = plan.load_criteria(str(path))
    assert (a.code, a.blocking, a.scored, b.state, b.blocking, b.scored) == ("A", True, False, "always", False, True)
    path.write_text("criteria:\n- {failure_code: A, applies_when: sometimes, weight: 2}\n")
    with pytest.raises(ValueError, match="known states"):
        plan.load_criteria(str(path))


def test_version_reports_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "accepted"), (2, "accepted"), (3, "rejected")], "id long, status string")
    report = sinks.write_version_report(rows, str(tmp_path / "v1"), {"version": "v1"})
    assert report == {"candidate_count": 3, "accepted_count": 2, "rejected_count": 1, "unjudged_count": 0, "acceptance_rate": 0.6667, "complete": True, "version": "v1"}
    assert json.loads(spark.read.text(str(tmp_path / "v1/report")).first()[0]) == report
    assert (tmp_path / "v1/unjudged").is_dir() and spark.read.json(str(tmp_path / "v1/accepted")).count() == 2
    cells = spark.createDataFrame([(1, (2, 3))], "a int, s struct<x:int,y:int>")
    both = sinks.together(sinks.flattened(cells), spark.createDataFrame([(5, 6)], "z int, a int"))
    assert both.columns == ["a", "s.x", "s.y", "z"] and [tuple(r) for r in both.collect()] == [(1, 2, 3, None), (6, None, None, 5)]
