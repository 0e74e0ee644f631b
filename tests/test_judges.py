"""Judges as plug-ins: what is asked, what is cached, what waits."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.functions.verdicts import verdict
from millrace.operators import judges

ANSWER = '{"spec_adherence": 0.95, "robustness": 1, "hint_relevance": 0.9, "pass": true, "note": "@"}'


class Counting(judges.Judge):
    """Writes down each batch that it gets."""

    name = family = "counting"

    def __init__(self, folder, fails=False):
        self.folder, self.fails = folder, fails

    def answers(self, prompts):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        if self.fails and any("bad" in p for p in prompts):
            raise TimeoutError
        return [None if "silent" in p else ANSWER.replace("@", p) for p in prompts]


judges.register("counting")(Counting)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this file


def asked(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().split("\n"))


def rows(spark, texts):
    return spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "n int, t string, answer_ int").repartition(3)


def run(spark, texts, who, **more):
    return {r["n"]: r for r in judges.answered(rows(spark, texts), who, F.sha2("t", 256), F.concat(F.lit("ask "), "t"), **more).collect()}


def test_each_key_once_and_in_batches(spark, tmp_path):
    got = run(spark, ["a", "b", "a", "silent", "c", "a"], judges.judge("counting", folder=str(tmp_path)), batch=2)
    assert asked(tmp_path) == ["ask a", "ask b", "ask c", "ask silent"]
    assert all(len(f.read_text().split("\n")) <= 2 for f in tmp_path.iterdir())
    assert len(got) == 6 and got[3]["answer"] is None and got[0]["answer"] == got[2]["answer"] == ANSWER.replace("@", "ask a")
    assert {(r["judge_model"], r["judge_family"], r["prompt_version"], r["from_cache"]) for r in got.values()} == {("counting", "counting", "1.0.0", False)}


def test_journal_keeps_answers_only(spark, tmp_path):
    first, second, journal = tmp_path / "1", tmp_path / "2", str(tmp_path / "journal")
    first.mkdir()
    second.mkdir()
    got = run(spark, ["a", "bad", "silent"], judges.judge("counting", folder=str(first), fails=True), batch=1, journal=journal)
    assert [got[k]["answer"] is None for k in range(3)] == [False, True, True]
    assert judges.read_journal(spark, journal).count() == 1
    got = run(spark, ["a", "bad", "silent", "new"], judges.judge("counting", folder=str(second)), journal=journal)
    assert asked(second) == ["ask bad", "ask new", "ask silent"]  # what failed is asked again, what was answered is not
    assert got[0]["from_cache"] and not got[1]["from_cache"] and got[2]["answer"] is None
    assert judges.read_journal(spark, journal).count() == 3
    assert judges.read_journal(spark, str(tmp_path / "nowhere")).count() == 0


def test_cache_first(spark, tmp_path):
    cache = spark.createDataFrame([("a", "kept"), ("b", None)], "t string, answer string").select(F.sha2("t", 256).alias("key"), "answer")
    got = run(spark, ["a", "b", None], judges.judge("counting", folder=str(tmp_path)), cache=cache)
    assert asked(tmp_path) == ["ask b"] and (got[0]["answer"], got[0]["from_cache"]) == ("kept", True)
    assert got[2]["answer"] is None  # a null text has no prompt


def test_codes_and_notes(spark):
    answers = [
        (ANSWER, "normal"), (ANSWER.replace("0.95", "0.5"), "normal"), (ANSWER.replace('s": 1,', 's": 0,'), "normal"), (ANSWER.replace('s": 1,', 's": 0,'), "frustrated"),
        (ANSWER.replace("0.9,", "0.1,"), "normal"), (ANSWER.replace("true", "false"), "normal"), (None, "normal"), ("no object", "normal"),
    ]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(answers)], "n int, answer string, p string")
    got = judges.judged_candidates(df, F.col("p")).orderBy("n").collect()
    assert [r["codes"] for r in got] == [[], ["LOW_QUALITY"], [], ["LOW_QUALITY"], ["IRRELEVANT_HINT"], ["LOW_QUALITY"], ["UNJUDGED"], ["LOW_QUALITY", "IRRELEVANT_HINT"]]
    assert got[0]["note"] == "judge adherence=0.95 robustness=1.00 relevance=0.90" and got[6]["note"] == "judge unavailable (infrastructure)"


def test_registry(spark):
    with pytest.raises(ValueError, match="registered already"):
        judges.register("scripted")(Counting)
    with pytest.raises(ValueError, match="no judge nobody"):
        judges.judge("nobody")
    who = judges.judge("scripted", rules=[(r"say (\w+)", r'{"pass": true, "failure_reasons": ["\1"]}'), ("quiet", None), ("!", None)])
    df = spark.createDataFrame([(1, "say solution_leak"), (2, "quiet"), (3, "else")], "key int, prompt string")
    got = {r["key"]: r["v"] for r in judges.ask(df, who, 1).select("key", verdict(F.col("answer")).alias("v")).collect()}
    assert got[1]["failure_reasons"] == ["SOLUTION_LEAK"] and got[2] is None and got[3] is None


def test_no_rows(spark, tmp_path):
    assert run(spark, [], judges.judge("counting", folder=str(tmp_path))) == {}


def test_an_answer_is_searched_for_its_object_once_a_use(spark):
    df = spark.createDataFrame([(1, '```json\n{"pass": true, "spec_adherence": 0.9}\n```'), (2, None), (3, "no object")], "id long, answer string")
    rows = judges.judged_candidates(df, F.lit("normal"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 8  # two patterns, for the verdict and for the warnings; each column may list them again
    assert {r["id"]: (r["codes"], r["note"]) for r in rows.collect()} == {
        1: (["IRRELEVANT_HINT"], "judge adherence=0.90 robustness=0.00 relevance=0.00"),
        2: (["UNJUDGED"], "judge unavailable (infrastructure)"),
        3: (["LOW_QUALITY", "IRRELEVANT_HINT"], "judge adherence=0.00 robustness=0.00 relevance=0.00"),
    }
